"""Shuffles start with more parts when the tables grow, and with the session's number when they are small."""

from conftest import SF

from peerscope import session
from peerscope.plans import grouped
from peerscope.plans.star import Star


def test_parts_follow_the_tables(spark, monkeypatch):
    parts = lambda: grouped.champion_table(Star(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(session.INITIAL, None) is None
    assert ", 4)" in parts() and spark.conf.get(session.INITIAL, None) is None
    rows = sorted(map(str, grouped.champion_table(Star(spark, SF)).collect()))
    monkeypatch.setattr(session, "DEALT_BYTES", 10_000)
    try:
        plan = parts()
        n = int(spark.conf.get(session.INITIAL))
        assert n > 4 and f", {n})" in plan and ", 4)" not in plan
        assert sorted(map(str, grouped.champion_table(Star(spark, SF)).collect())) == rows
    finally:
        spark.conf.unset(session.INITIAL)
