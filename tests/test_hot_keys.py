"""Plans that split hot keys must give the plain plans' results, row by row."""

import random

import pytest
from pyspark.sql import functions as F

from peerscope.operators import history as H
from peerscope.operators import joins as J
from peerscope.operators import ordered as O
from peerscope.operators import quantiles as Q
from peerscope.operators import scale as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        key = "hot" if i % 3 else rng.choice("abcdefghij") + str(i % 40)
        data.append((key, rng.randrange(100_000), i, rng.choice([None, *range(50)]), rng.random() < 0.5))
    return spark.createDataFrame(data, "k string, t long, id long, v long, win boolean")


def both(spark, fn):
    spark.conf.set("spark.peerscope.hotRows", "100000")
    plain = sorted(map(str, fn().collect()))
    spark.conf.set("spark.peerscope.hotRows", "20")
    split = sorted(map(str, fn().collect()))
    spark.conf.unset("spark.peerscope.hotRows")
    return plain, split


KINDS = {f"{k}_{s}_{r}": (k, s, r) for k in ("sum", "count", "max", "min", "last", "first") for s in (False, True) for r in (False, True)}


@pytest.mark.parametrize("case", KINDS, ids=str)
def test_running(spark, rows, case):
    kind, strict, reverse = KINDS[case]
    plain, split = both(spark, lambda: O.running(rows, ["k"], ["t", "id"], {"x": (kind, F.col("v"))}, strict, reverse))
    assert plain == split


def test_hot_key_is_found_and_split(spark, rows):
    hot = S.hot_keys(rows, ["k"], "t", 20)
    assert hot.count == 1
    chunks = S.mark_hot(rows, hot, "t").where("_is_hot").groupBy("_chunk").count().collect()
    assert len(chunks) > 10 and max(c["count"] for c in chunks) < 120


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("steps", [1, 2])
def test_previous(spark, rows, steps, following):
    plain, split = both(spark, lambda: O.previous(rows, ["k"], ["t", "id"], {"p": F.col("v")}, steps, following))
    assert plain == split


def test_previous_is_lag(spark, rows):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("t", "id")
    want = sorted(map(str, rows.select("id", F.lag("v", 2).over(w).alias("p")).collect()))
    got = sorted(map(str, O.previous(rows, ["k"], ["t", "id"], {"p": F.col("v")}, 2).select("id", "p").collect()))
    assert got == want


def test_asof_sessions_streaks(spark, rows):
    left = rows.select("k", "t", "id")
    right = rows.where("win").groupBy("k", F.col("t").alias("rt")).agg(F.min("id").alias("rid"))
    for strict in (False, True):
        for direction in ("backward", "forward"):
            plain, split = both(spark, lambda: J.asof(left, right, ["k"], "t", "rt", {"rid": "rid"}, direction, strict, "mt"))
            assert plain == split
    plain, split = both(spark, lambda: H.streaks(rows, ["k"], ["t", "id"], "win"))
    assert plain == split
    games = rows.withColumn("end", F.col("t") + 10)
    plain, split = both(spark, lambda: H.sessions(games, ["k"], "t", "end", ["id"], 300, "win").select("id", "session", "index", "losses_before"))
    assert plain == split


def test_beside(spark, rows):
    plain, split = both(spark, lambda: S.beside(rows, ["k"], {"n": F.count(F.lit(1)), "m": F.max("v")}))
    assert plain == split


def test_exact_quantiles(spark, rows):
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    fn = lambda: Q.grouped_quantiles(rows, ["k"], "v", probs).select("k", "n", *[F.round(p, 9).alias(p) for p in probs])
    plain, split = both(spark, fn)
    assert plain == split


def test_exact_quantiles_of_distinct_values(spark, rows):
    probs = {"p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    fn = lambda: Q.grouped_quantiles(rows, ["k"], "t", probs).select("k", "n", *[F.round(p, 6).alias(p) for p in probs])
    plain, split = both(spark, fn)
    assert plain == split


def test_broadcast_is_checked(spark, rows):
    spark.conf.set("spark.peerscope.broadcastRows", "10")
    plan = rows.join(S.dimension(rows.select("id").distinct()), "id")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.peerscope.broadcastRows")
    assert "broadcast" not in plan.lower()


def test_rolling_range_against_brute_force(spark, rows):
    got = {r["id"]: r["m"] for r in O.rolling_range(rows, ["k"], "t", 500, {"m": F.max("v")}).collect()}
    data = [r.asDict() for r in rows.collect()]
    for r in data:
        reach = [x["v"] for x in data if x["k"] == r["k"] and r["t"] - 500 <= x["t"] <= r["t"] and x["v"] is not None]
        assert got[r["id"]] == (max(reach) if reach else None)
    assert len(got) == len(data)
