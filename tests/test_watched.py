"""Thinning, suppression, fits and items where SQL twins on the test tables don't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscope.operators import ensembles as E
from peerscope.operators import items as I
from peerscope.operators import moments as M
from peerscope.operators import sequence as Q
from peerscope.operators import situations as S


def greedy(times, apart):
    kept = []
    for t in sorted({*times}):
        if not kept or t - kept[-1] >= apart:
            kept.append(t)
    return kept


def test_spaced_of_a_dense_key(spark):
    """One key with an unbroken row of readings, one with gaps, ties and nulls."""
    dense = [("a", i * 3) for i in range(3000)]
    other = [("b", t) for t in (0, 0, 1, 9, 10, 11, 30, 39, 40)] + [("c", None), ("d", 5)]
    got = Q.spaced(spark.createDataFrame(dense + other, "k string, t bigint"), "k", "t", 10).collect()
    for k, rows in (("a", dense), ("b", other[:9]), ("d", [("d", 5)])):
        assert sorted(r["t"] for r in got if r["k"] == k) == greedy([t for _, t in rows], 10)
    assert not [r for r in got if r["k"] == "c"]


def test_recalls(spark):
    rows = [(t, 1.0 - t % 50 / 100, 100 + t, "x" if t < 100 else "y" if t < 120 else "z" if t < 300 else "w", 200 <= t < 230) for t in range(0, 400, 2)]
    rows[75] = (150, 0.25, 250, "new", False)  # a change for one reading: bought at 150 and changed back at 152
    df = spark.createDataFrame([("p", *r) for r in rows], "k string, t bigint, hp double, gold bigint, items string, dead boolean")
    got = sorted(Q.recalls(df, "k", "t", "hp", "gold", "items", "dead").collect(), key=lambda r: r["t"])
    assert [r["t"] for r in got] == [100, 150, 300]
    assert (got[0]["health"], got[0]["gold"]) == (1.0 - 86 % 50 / 100, 198.0)
    assert Q.recalls(df.limit(0), "k", "t", "hp", "gold", "items", "dead").count() == 0


def test_suppression_by_rounds(spark):
    rows = [("r", float(t), "k", "weakness", float(i)) for t, i in ((0, 9), (5, 8), (12, 7), (21, 7), (30, 1), (50, 6), (70, 5), (90, 4))] + [("r", 8.0, "g", "strength", 99.0), ("r", 200.0, "g", "strength", 1.0), ("q", 1.0, "k", "strength", 0.5)]
    got = M.separated(spark.createDataFrame(rows, "recording string, t double, kind string, polarity string, impact double"))
    assert sorted((r["recording"], r["t"]) for r in got.collect()) == [("q", 1.0), ("r", 0.0), ("r", 12.0), ("r", 50.0), ("r", 70.0), ("r", 90.0), ("r", 200.0)]
    assert M.separated(spark.createDataFrame([], "recording string, t double, kind string, polarity string, impact double")).count() == 0


def test_newton_equals_a_plain_fit(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 2))
    y = (r.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(int)
    w = r.integers(0, 3, 400)
    df = spark.createDataFrame([(float(a), float(b), int(c), int(d)) for (a, b), c, d in zip(x, y, w, strict=True)], "a double, b double, y int, w int")
    fits = E.newton(df, [F.col("a"), F.col("b")], "y", {"all": F.lit(1.0), "some": F.col("w"), "none": F.lit(0.0)}, steps=12)
    for k, weight in enumerate((np.ones(400), w)):
        beta, one = np.zeros(3), np.c_[np.ones(400), x]
        for _ in range(12):
            p = 1 / (1 + np.exp(-one @ beta))
            beta += np.linalg.solve((one * (weight * p * (1 - p))[:, None]).T @ one + np.diag([0, 1e-6, 1e-6]), one.T @ (weight * (y - p)) - np.array([0, 1e-6, 1e-6]) * beta)
        assert np.allclose(fits.beta[k], beta, atol=1e-8)
    assert not fits.beta[2].any()


def test_bags_are_poisson(spark):
    d = spark.range(20000).select(*[E.bag_times(F.col("id"), b).alias(f"b{b}") for b in range(3)])
    m = d.agg(*[f(f"b{b}").alias(f"{n}{b}") for b in range(3) for n, f in (("m", F.avg), ("v", F.var_samp))]).first()
    assert all(abs(m[f"m{b}"] - 1) < 0.03 and abs(m[f"v{b}"] - 1) < 0.05 for b in range(3))


def test_calibration_needs_both_outcomes(spark):
    df = spark.createDataFrame([(i % 3, 0.2 + i % 5 / 10, int(i < 20)) for i in range(90)], "fold int, p double, y int")
    assert E.cross_fitted(df, "p", "y", 3).where("calibrated <> p").count() == 0


@pytest.fixture(scope="module")
def match(spark):
    held = spark.createDataFrame([(1, p, 100 if p < 6 else 200, i, t, 0) for p, i, t in ((1, 10, 500), (1, 11, 500), (2, 10, 900), (7, 12, 100), (1, 99, 50))], "match_id int, player int, team int, item int, t bigint, pos int")
    flags = spark.createDataFrame([(10, "items"), (10, "ad"), (11, "items"), (11, "armor"), (12, "items"), (12, "ap"), (13, "items")], "item int, flag string")
    return I.finished(held, flags), flags


def test_items_at_a_moment(spark, match):
    own, _ = match
    asks = spark.createDataFrame([(1, t) for t in (0, 100, 499, 500, 1000)] + [(2, 1000)], "match_id int, item_cut bigint")
    got = {(r["match_id"], r["item_cut"]): (r["items_100"], r["ad_100"], r["armor_100"], r["items_200"], r["ap_200"]) for r in I.with_items(asks, own).collect()}
    assert got == {(1, 0): (0, 0, 0, 0, 0), (1, 100): (0, 0, 0, 1, 1), (1, 499): (0, 0, 0, 1, 1), (1, 500): (2, 1, 1, 1, 1), (1, 1000): (3, 2, 1, 1, 1), (2, 1000): (0, 0, 0, 0, 0)}
    more = I.with_extra(I.with_items(asks, own).withColumns({"f": F.array(F.lit("items"), F.lit("mr")), "side": F.lit(200)}), "f", "side").where("match_id = 2").first()
    assert (more["items_200"], more["mr_200"], more["items_100"]) == (1, 1, 0)


def test_items_not_bought(spark, match):
    own, flags = match
    players = spark.createDataFrame([(1, p, 100, "c") for p in (1, 2, 7)], "match_id int, player int, team int, champion string")
    popular = spark.createDataFrame([("c", 10, 1), ("c", 12, 2), ("c", 11, 3), ("c", 13, 4), ("c", 77, 5)], "champion string, item int, place int")
    got = {(r["player"], r["nth"], r["place"]): r["other"] for r in I.other_items(own, players, popular, flags, 2).collect()}
    assert got == {(1, 1, 1): 12, (1, 1, 2): 11, (1, 2, 1): 12, (1, 2, 2): 13, (2, 1, 1): 12, (2, 1, 2): 11, (7, 1, 1): 10, (7, 1, 2): 11}


def test_situations_know_nothing_of_later_rows(spark):
    """Removing all later frames and events leaves a minute's features as they are."""
    cells = [(1, p, 100 if p <= 5 else 200, S.ROLES[(p - 1) % 5], m, m * 60000, float(p * 1000 + m * 37), float(p * 900 + m * 91), 1 + m, 10 * m, 500 + m, m * p, m * (p % 3)) for p in range(1, 11) for m in range(12)]
    frames = spark.createDataFrame(cells, "match_id int, participant int, team int, role string, minute int, t bigint, x double, y double, level int, current_gold int, total_gold int, cs int, jungle_cs int")
    log = [(1, t * 17_000, i, ("kill", "monster", "plate", "tower", "ward")[i % 5], i % 10 + 1, 100 if i % 10 < 5 else 200, (i + 6) % 10 + 1, [i % 10 + 2 if i % 10 < 9 else 1], ("DRAGON", "HORDE", "RIFTHERALD", "BARON_NASHOR")[i // 5 % 4] if i % 5 == 1 else None,
            100 + 100 * (i % 2), float(i * 300), float(i * 210)) for i, t in enumerate(range(1, 38))]
    events = spark.createDataFrame(log, "match_id int, t bigint, pos int, kind string, killer int, killer_team int, victim int, assists array<int>, monster string, team int, x double, y double")
    for role in ("JUNGLE", "UTILITY"):
        full = {(r["participant"], r["minute"]): r for r in S.situations(frames, events, role).collect()}
        cut = {(r["participant"], r["minute"]): r for r in S.situations(frames.where("minute <= 6"), events.where("t <= 6 * 60000"), role).collect()}
        assert len(full) == 2 * 9 and len(cut) == 2 * 4 and all(full[k] == v for k, v in cut.items())
    with pytest.raises(ValueError):
        S.situations(frames, events, "COACH")
