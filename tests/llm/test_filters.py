"""Quality, decontamination, vectors and the pipeline."""

import zlib

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from peerscope.llm.decontamination import contamination
from peerscope.llm.embedding_dedup import bucket_lists, hadamard, near_vectors, unit
from peerscope.llm.quality_classifier import fit, keep_good, quality_scores, train


def quality_of(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs, train(docs, labels)), labels


def test_held_out_quality(spark):
    scores, labels = quality_of(spark, "/root/testdata/sf0.01")
    rows = scores.join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.97


def test_risk_turns_back_below_zero():
    """More positives than the prior allows: the negatives' part would go below zero, and the fit stays finite."""
    r = np.random.default_rng(1)
    p, u = r.normal(1, 1, (300, 4)), np.r_[r.normal(1, 1, (150, 4)), r.normal(-2, 1, (50, 4))]
    model = fit(p, u, 0.75)
    assert np.isfinite(model.weights).all()
    assert model.score(np.full((1, 4), 1.0))[0] > 0.8 > 0.3 > model.score(np.full((1, 4), -2.0))[0]


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(d, int(d % 3 > 0)) for d in range(1, 30)] + [(None, 1), (4, None)], "doc_id bigint, quality int")
    model = train(odd, labels)
    assert quality_scores(odd, model).count() == odd.count()
    assert quality_scores(none, model).count() == 0
    assert keep_good(odd, model, 2.0).count() == 0 and keep_good(odd, None).count() == odd.count()
    assert train(odd, labels.where("quality = 0")) is None


def contaminated(docs, items, **more):
    return contamination(docs, items, **more).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated")


def same(df, want):
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


@pytest.mark.parametrize("pairs", [200_000, 40])
def test_contamination(spark, docs, plain, pairs):
    """Also with the items in many blocks."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    same(contaminated(docs, items, block_pairs=pairs), brute.contamination(plain(docs), [tuple(r) for r in items.select("item_id", "text").collect()]))


def test_contamination_of_odd_rows(spark, odd, none, plain):
    text = " ".join(f"w{i} x{i % 7}" for i in range(300))
    rows = [(1, text[:200]), (2, "One"), (3, "one two"), (4, ""), (5, None), (None, "one"), (6, text[40:120]), (6, "mixed case"), (10, "a a a"), (11, "日本 日本 日本"), (12, text)]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    same(contaminated(once, items), brute.contamination(plain(once), [r for r in rows if r[0] is not None]))
    assert contaminated(odd, items).count() == odd.count() and contaminated(none, items).count() == 0
    assert contaminated(once, items.limit(0)).where("n_hit > 0").count() == 0


def vectors(n, r):
    base = r.normal(size=(n // 5, 24))
    near = base[r.integers(0, len(base), n - len(base))] + r.normal(size=(n - len(base), 24)) * r.choice([0.02, 0.2, 0.35], (n - len(base), 1))
    return np.r_[base, near]


def plain_vectors(rows):
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[:k] if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.93]
    comp = brute.roots([r[0] for r in rows], links)
    return links, [(r[0], sum(r[0] in x for x in links), comp[r[0]], comp[r[0]] == r[0]) for r in rows]


def test_vectors(spark):
    r = np.random.default_rng(4)
    x = vectors(500, r)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(20)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] * 24, 1), (2004, [None, 1.0], 1), (2005, rows[0][1], None), (2006, [float("inf")] * 24, 1),
             (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, [1e-200, 2e-200], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("m", F.lit(1))
    links, want = plain_vectors(rows)
    got = [tuple(x) for x in near_vectors(df.repartition(6)).collect()]
    assert len(links) > 300 and sorted(got) == sorted(want)
    assert near_vectors(df.limit(0)).count() == 0


def test_big_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr("peerscope.llm.embedding_dedup.BLOCK", 7)
    r = np.random.default_rng(8)
    base = r.normal(size=16)
    rows = [(i, (base + 0.1 * r.normal(size=16)).tolist(), 1) for i in range(80)]
    assert sorted(tuple(x) for x in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()) == sorted(plain_vectors(rows)[1])


def test_recall_at_the_threshold():
    """Pairs just above the cosine share a bucket, with two hashes in a table and with three."""
    r = np.random.default_rng(9)
    a = unit(r.normal(size=(4000, 64)))
    g = r.normal(size=a.shape)
    g = unit(g - (g * a).sum(1, keepdims=True) * a)
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * g
    for k, tables in ((2, 6), (3, 12)):
        x, y = bucket_lists(a, k, tables), bucket_lists(b, k, tables)
        met = np.zeros(len(a), bool)
        for i in range(x.shape[1]):
            met |= (y == x[:, i:i + 1]).any(1)
        assert met.mean() > 0.999
    assert np.allclose(np.linalg.norm(hadamard(a), axis=1), 1)


def test_pipeline(spark):
    """The whole run against plain versions of its stages, from the classifier's decisions on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality_of(spark, SF)[0].where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    kept = {d: h for d, _, _, h in brute.lines(rows)}
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs.where(F.col("doc_id").isin(sorted(good))), SF).collect()}
    assert {d: brute.sha(t) for d, t in texts.items()} == kept
    stay = [(d, texts[d]) for d, _, _, k in brute.near(sorted(texts.items())) if k]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {x[0] for x in brute.contamination(stay, items) if not x[-1]}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == clean and 0 < len(clean) < len(rows)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got.values())


def test_stages_keep_the_columns(spark, none):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, None, 0), (2, "", None, None, 0), (None, "a b", "en", "s", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert out.columns == docs.columns and out.count() <= df.count()
