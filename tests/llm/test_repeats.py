"""Line, substring and near-duplicate removal against plain versions of their rules."""

import brute
import duckdb
import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerscope.llm import repeats
from peerscope.llm.components import components
from peerscope.llm.fm_substring import FmIndex, drop_repeated_words, match_groups
from peerscope.llm.line_dedup import HASH, LineRuns, drop_lines
from peerscope.llm.minhash_dedup import BINS, band_keys, fill_orders, near_duplicates, signatures
from peerscope.llm.queries import ORACLE, QUERIES
from peerscope.llm.suffix_dedup import drop_repeated_bytes, radix_groups


def same(df, want):
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def with_id(df):
    return df.where("doc_id IS NOT NULL")


def lines(df):
    return drop_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))


def near(df):
    return near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept")


def words(df):
    return drop_repeated_words(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))


def bytes_(df):
    return drop_repeated_bytes(df).select("doc_id", "n", "n_removed", "n_spans", F.sha2("kept", 256))


CASES = [(lines, brute.lines), (near, brute.near), (words, brute.repeated_words), (bytes_, brute.repeated_bytes)]


@pytest.mark.parametrize(("operator", "rule"), CASES)
def test_documents(docs, plain, operator, rule):
    same(operator(docs), rule(plain(docs)))


@pytest.mark.parametrize(("operator", "rule"), CASES)
def test_odd_rows(odd, plain, operator, rule):
    """A row for each input row; those with an id as the rule says, however the table is cut up."""
    once = with_id(odd).dropDuplicates(["doc_id"])
    same(operator(once.repartition(5)), rule(plain(once)))
    assert operator(odd).count() == odd.count()


@pytest.mark.parametrize(("operator", "rule"), CASES)
def test_no_rows(none, operator, rule):
    assert operator(none).count() == 0


@pytest.mark.parametrize("name", [n for n in ORACLE if n.startswith("op")])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall()
    same(got, want)


def test_runs_compact(spark):
    """Adding batches in falling order gives the counts and the largest holder of all rows, whatever is compacted."""
    rows = [(d, h, h * 3) for d in range(40) for h in range(d % 7 + 1)]
    runs = LineRuns(spark, buckets=3, fanout=2)
    for b in range(4, -1, -1):
        batch = spark.createDataFrame([r for r in rows if r[0] // 8 == b] * 2, "doc bigint, h1 bigint, h2 bigint")
        assert runs.new(batch.select(*HASH).distinct()).count() <= 7
        runs.add(batch)
        assert all(len(level) <= 2 for level in runs.levels)
    got = {r["h1"]: (r["docs"], r["last"]) for r in runs.totals().collect()}
    assert got == {h: (sum(r[1] == h for r in rows), max(r[0] for r in rows if r[1] == h)) for h in range(7)}


def test_hot_lines_and_cold_lines(spark, odd, plain, monkeypatch):
    """Lines above and below the broadcast bound are treated alike."""
    once = with_id(odd).dropDuplicates(["doc_id"])
    for bound in (1, 3):
        monkeypatch.setattr("peerscope.llm.line_dedup.HOT_LINES", bound)
        same(lines(once), brute.lines(plain(once)))


def test_hot_anchors_are_cut(docs, plain, monkeypatch):
    """With every anchor hot, and with tiny slices, the results stay."""
    monkeypatch.setattr(repeats, "hot_anchors", lambda table, total: np.unique(np.array([r[0] for r in table.select(F.explode("heavy")).collect()], np.int64).view(np.uint64)))
    monkeypatch.setattr(repeats, "HEAVY_IN_SLICE", 1)
    few = docs.where("doc_id < 60")
    same(bytes_(few), brute.repeated_bytes(plain(few)))
    same(words(few), brute.repeated_words(plain(few)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=6, max_size=25), min_size=1, max_size=6))
def test_groups_of_equal_windows(stretches):
    width = 6
    flat = np.concatenate([np.array(s) for s in stretches])
    begin = np.cumsum([0, *map(len, stretches)])[:-1]
    at = np.concatenate([b + np.arange(len(s) - width + 1) for b, s in zip(begin, stretches, strict=True)])
    windows = [tuple(flat[a:a + width].tolist()) for a in at]
    for groups in (match_groups(flat.astype(np.uint64), begin, at, width), radix_groups(flat.astype(np.uint8), begin, at, width)):
        for i, a in enumerate(windows):
            assert (groups[i] >= 0) == (windows.count(a) > 1)
            assert all((groups[i] == groups[j]) == (a == b) for j, b in enumerate(windows) if groups[i] >= 0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.integers(0, 4), min_size=1, max_size=4))
def test_backward_search_counts(text, pattern):
    text = [x + 1 for x in text] + [0]
    index = FmIndex(np.array(text), 6, 8)
    low, high = np.array([0]), np.array([len(text)])
    for x in reversed(pattern):
        low, high = index.extend(np.array([x + 1]), low, high)
    n = len(pattern)
    assert int((high - low)[0]) == sum(text[i:i + n] == [x + 1 for x in pattern] for i in range(len(text)))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (200, 200), (3, 2)] + [(500 + i, 500) for i in range(1, 60)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 105: 100, 103: 100, **dict.fromkeys(range(500, 560), 500)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_signatures_follow_similarity():
    """The share of equal bins is the similarity of the sets, also of sets much smaller than the number of bins."""
    r = np.random.default_rng(3)
    for size in (12, 400):
        shares = []
        for _ in range(150):
            pool = r.integers(0, 1 << 63, size * 8 // 7, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(pool[len(pool) - size:])
            x = signatures([a, b], fill_orders())
            shares.append((x[0] == x[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
            assert (band_keys(x)[0] == band_keys(x)[1]).any()
        assert x.shape == (2, BINS) and abs(np.mean(shares)) < 0.03


def test_near_links_beyond_the_stars(spark):
    """A chain whose ends are less similar than 0.75 is one component, whoever is a bucket's hub."""
    base = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(base[:400 - 30 * i] + [f"n{i}_{j}" for j in range(30 * i)])) for i in range(6)]
    rows += [(50 + i, " ".join([f"z{i}_{j}" for j in range(12 * i)] + base[12 * i:])) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(near(df), brute.near(rows))
