"""Which rank a number matches, where the SQL twins don't reach."""

from pyspark.sql import functions as F

from peerscope.operators import baselines as B

TIERS = ("LOW", "MID", "HIGH", "TOP")
BENCH = "tier string, role string, metric string, p50 double"


def ladder(spark):
    rows = [(t, "mid", "cs_min", v) for t, v in zip(TIERS, (5.0, 6.0, 7.0, None), strict=True)]
    rows += [(t, "mid", "deaths_10", v) for t, v in zip(TIERS, (3.0, 2.0, 0.0, 0.0), strict=True)] + [("ALL", "mid", "cs_min", 1.0)]
    return spark.createDataFrame(rows, BENCH)


def test_match_and_next_step(spark):
    """Equal counts as reached; few deaths are good; tiers without a median and medians of zero are no goal."""
    rows = [("a", "mid", 9, "cs_min", 6.0), ("a", "mid", 9, "deaths_10", 2.5), ("b", "mid", 9, "cs_min", 4.9), ("b", "mid", 9, "deaths_10", 0.0),
            ("c", "mid", 9, "cs_min", 9.0), ("d", "top", 9, "cs_min", 9.0), ("e", "mid", 9, "cs_min", 5.0), ("e", "mid", 9, "deaths_10", 2.4)]
    stats = spark.createDataFrame(rows, "player string, role string, games int, metric string, value double")
    matched = B.ranks_matched(stats, ladder(spark), TIERS)
    got = {(r["player"], r["metric"]): (r["like"], r["n_met"]) for r in matched.collect()}
    assert got == {("a", "cs_min"): ("MID", 2), ("a", "deaths_10"): ("LOW", 1), ("b", "cs_min"): (None, 0), ("b", "deaths_10"): ("TOP", 4),
                   ("c", "cs_min"): ("HIGH", 3), ("e", "cs_min"): ("LOW", 1), ("e", "deaths_10"): ("LOW", 1)}
    own = spark.createDataFrame([("a", "MID"), ("b", "LOW"), ("c", "TOP"), ("e", "LOW"), ("x", "LOW"), ("d", None)], "player string, tier string")
    steps = {r["player"]: (r["next"], r["metric"], r["value"], r["wanted"], r["gap"]) for r in B.next_steps(matched, own).collect()}
    # a: the next median of deaths is zero, so only creeps count; e: creeps and deaths are both a fifth short, the later name counts
    assert steps == {"a": ("HIGH", "cs_min", 6.0, 7.0, 0.142857), "b": ("MID", "cs_min", 4.9, 6.0, 0.183333), "e": ("MID", "deaths_10", 2.4, 2.0, 0.2)}
    assert B.ranks_matched(stats.limit(0), ladder(spark), TIERS).count() == B.ranks_matched(stats, ladder(spark).limit(0), TIERS).count() == 0


def test_newest_games_of_a_role(spark):
    """Only the newest games count; a role without enough games, or without a name, says nothing."""
    rows = [("p", "mid", i, 60 * i, 0 if i <= 5 else 600, 1, 0, 0, 600) for i in range(1, 11)]
    rows += [("p", "top", i, 1, 1, 1, 1, 1, 600) for i in range(4)] + [("p", role, i, 1, 1, 1, 1, 1, 600) for role in ("", None) for i in range(9)]
    builds = spark.createDataFrame([(*r, 5) for r in rows], "player string, role string, at int, cs int, damage int, kills int, assists int, deaths int, duration_s int, team_kills int")
    got = B.role_stats(builds.withColumn("vision", F.lit(20)), [F.col("at").desc()], games=5).collect()
    assert {r["role"] for r in got} == {"mid"} and {r["games"] for r in got} == {5}
    assert {r["metric"]: r["value"] for r in got} == {"cs_min": 48.0, "dmg_min": 60.0, "vision_min": 2.0, "kp": 0.2, "deaths_10": 0.0}
