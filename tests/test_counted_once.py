"""Rows per match are counted in the lines they come from, and a match's credit is worked out where the match is."""

import re

from conftest import SF
from pyspark.sql import functions as F

from peerscope.operators import scale as S
from peerscope.operators import winprob as W
from peerscope.operators.joins import asof
from peerscope.plans import situated
from peerscope.plans.star import Star


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counted_keys_are_not_counted_again(spark, monkeypatch):
    """a plan was worked out in full only to count its rows per match."""
    lines = spark.createDataFrame([(i % 7, i) for i in range(70)] + [(1, 99)] * 20 + [(None, 1)] * 3, "k long, v long")
    monkeypatch.setattr(S, "input_bytes", lambda df: 1 << 40)
    most = S.most_rows(lines, "k")
    assert 30 <= most <= 93
    rows = lines.select(S.bounded(F.col("k"), "k", most), "v")
    joined = asof(rows, S.written(rows.groupBy("k").agg(F.max("v").alias("t"))), ["k"], "v", "t", {"x": "t"}, hot=None)
    for df in (rows, joined, rows.unionByName(rows), rows.select(F.col("k").alias("m"), F.explode(F.array("v", "v")).alias("v"))):
        key = df.columns[0]
        assert S.hot_keys(df, [key], None, most * most) is None
        # Keys that could reach the limit are still counted, and found.
        assert S.hot_keys(df, [key], None, 20) is not None
    assert S.hot_keys(lines, ["k"], None, 10_000) is None and S.hot_keys(rows.select(F.col("v").alias("k")), ["k"], None, 19) is not None


def test_small_tables_are_not_counted(spark):
    assert Star(spark, SF).most_lines is None


def test_a_players_line_is_run_by_the_match(spark):
    """ten lines a match were added up and sorted row by row; now a minute's players are one row, dealt by the match."""
    rows = [(m, 1 + i % 3, i % 4, 0.1 * i) for m in (1, 2) for i in range(10)] + [(2, 9, 5, None)]
    shares = spark.createDataFrame(rows, "match_id long, player int, minute int, amount double")
    line = W.running_line(shares)
    assert not re.findall(r"hashpartitioning\([^)]*player#", plan(line))
    want = {(m, p, t): sum(a for m2, p2, t2, a in rows if (m2, p2) == (m, p) and t2 <= t and a is not None) for m, p, t, _ in rows}
    got = {(r.match_id, r.player, r.minute): r.line for r in line.collect()}
    assert got.keys() == want.keys() and got.pop((2, 9, 5)) is None
    assert all(abs(v - 100 * want[k]) < 1e-9 for k, v in got.items())


def test_players_without_a_row_get_nothing(spark):
    curve = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6), (1, 3, 0.9)], "match_id long, minute int, p double")
    facts = spark.createDataFrame([(1, 1000, 3, 0.02)], "match_id long, t long, last int, d double")
    earned = spark.createDataFrame([(1, p, m, float(p), 1.0) for p in (1, 2, 6) for m in (0, 1, 2)], "match_id long, player int, minute int, gap double, got double")
    shares = W.drift_shares(curve, facts, earned)
    assert len(re.findall(r"Window \[", plan(shares))) == 1 and "Join" not in plan(shares)  # the curve's own; players were sorted three times
    got = {(r.player, r.minute): round(r.amount, 9) for r in shares.collect()}
    # 0.08 is left of the first minute; stakes are 1 and 2 of 3 on one side, none on the other. The third minute has no next point.
    assert got == {(1, 1): round(0.08 * (0.1 + 0.5 / 3), 9), (2, 1): round(0.08 * (0.1 + 0.5 * 2 / 3), 9), (6, 1): round(-0.08 * 0.2, 9)}


def test_situations_shuffle_narrow_lines_only(spark):
    """a minute's wide row was shuffled for its join and again for the last sighting."""
    for query in (situated.jungle_situations, situated.support_situations):
        text = plan(query(Star(spark, SF)))
        dealt = set(re.findall(r"hashpartitioning\(([^)]*)\)", text))
        assert dealt and all(len(d.split(",")) == 2 for d in dealt) and "Join" not in text
