"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import low

from peerscope.llm import lexical_search as search
from peerscope.llm.lexical_search import Batch, build_index, ranked
from peerscope.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=10):
    terms = [(d, TERM.findall(low(t or ""))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    df = Counter(t for _, x in terms for t in {*x})
    out = []
    for item, text in items:
        want, scored = Counter(TERM.findall(low(text or ""))), []
        for d, x in terms:
            if x:
                m, tf = 25 + 75 * len(x) * n_docs // n_terms, Counter(x)
                s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, c in want.items() if tf[t])
                if s > 0:
                    scored.append((-s, d is not None, d, s))
        out += [(item, r, d, s) for r, (_, _, d, s) in enumerate(sorted(scored, key=lambda y: (y[0], y[1], y[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def table():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["The", "of", "É", "naïve", "日本", "x1", "it's", "A_B"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(d, " ".join(r.choices(words, weight, k=r.choice([1, 5, 40, 300])))) for d in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(30)] + [(500, "the " * 700 + "w1"), (501, ""), (502, None), (503, " .,;! "), (504, "w3\x00w4\nw5-w6"), (5, "w1 again"), (5, "w1 again"), (None, "w2 of nothing")]
    items = [(i, " ".join(r.choices(words, weight, k=12))) for i in range(25)] + [(90, None), (91, ""), (92, "unknownword"), (93, "THE the tHe"), (93, "w1"), (None, "w2 w2 of"), (94, docs[7][1]), (95, "w399 x1")]
    return docs, items


def frames(spark, docs, items):
    from pyspark.sql import functions as F

    extra = {n: F.lit(1) for n in ("n", "item", "score", "sketch", "rank", "wanted_id", "label")}
    return (spark.createDataFrame(docs, "doc_id bigint, text string").withColumns(extra),
            spark.createDataFrame(items, "item_id bigint, text string").withColumns(extra | {"doc_id": F.lit(2)}))


def test_all_scores(spark, table):
    """Ties, repeated and null ids, empty and null texts, terms beyond a full counter, clashing columns."""
    docs, items = table
    assert found(ranked(*frames(spark, docs, items))) == plain(docs, items)
    assert found(ranked(*frames(spark, docs, items), k=40)) == plain(docs, items, 40)


def test_blocks_of_items_and_a_kept_index(spark, table, monkeypatch):
    docs, items = table
    monkeypatch.setattr(search, "ITEMS", 12)
    d, i = frames(spark, docs, items)
    index = build_index(d)
    assert found(ranked(d, i, 3, index)) == plain(docs, items, 3)


def test_nothing(spark, table):
    docs, items = frames(spark, *table)
    assert ranked(docs.limit(0), items).count() == ranked(docs, items.limit(0)).count() == 0
    assert ranked(docs.where("doc_id IN (501, 502)"), items).count() == 0


@pytest.mark.parametrize("room", [4, 1])
def test_bounds_hold(table, monkeypatch, room):
    """Whatever falls together in a sketch, no score is above its bound, and most bounds are exact."""
    monkeypatch.setattr(search, "ROOM", room)
    docs, items = [t.encode() for _, t in table[0] if t and t.strip(" .,;!")], [(t or "").encode() for _, t in table[1]]
    batch = Batch(items)
    n = [sum(map(len, search.term_lists(t))) for t in docs]
    batch.weigh({v: 3 for v in range(len(batch.number))}, len(docs), sum(n))
    known = search.WordHashes()
    sketches = [search.sketch(*np.unique(np.concatenate([known.array(x) for x in search.term_lists(t) if x]), return_counts=True)).tobytes() for t in docs]
    equal = 0
    for which, bound in batch.bounds(sketches, n):
        for w, b in zip(which.tolist(), bound.tolist(), strict=True):
            exact = batch.scores(docs[w], list(range(len(items))))
            assert all(x <= y for x, y in zip(exact, b, strict=True))
            equal += sum(x == y for x, y in zip(exact, b, strict=True))
    assert equal > (0.9 if room == 4 else 0.2) * len(docs) * len(items)


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(search, "PART", 7)
    text = b"One two-three, FOUR five " * 9 + b"lastwordthatislong"
    assert [t for part in search.term_lists(text) for t in part] == [t.encode() for t in TERM.findall(low(text.decode()))]


def test_query(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(QUERIES["op13_lexical_search"](spark, "/root/testdata/sf0.001")) == plain(rows, items)
