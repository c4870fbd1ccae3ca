"""Tables that grow with the matches are never built in the driver, however small their files look."""

import re

import pytest
from conftest import SF

from peerscope.operators import winprob as W
from peerscope.operators.scale import grown, written
from peerscope.plans import chance, documents, equipped
from peerscope.plans.star import Star
from peerscope.sources import matches as M


@pytest.mark.parametrize("plan", [chance, equipped], ids=["chance", "equipped"])
def test_states_are_joined_without_broadcasts(spark, plan):
    s = Star(spark, SF)
    e = plan.events(s)
    state = W.game_state(W.event_asks(e), plan.frames(s), e)
    assert "Broadcast" not in state._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_merged(spark):
    a, b = (written(spark.range(100), n) for n in "ab")
    assert "SortMergeJoin" in a.join(grown(b), "id")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("plan", [chance, equipped], ids=["chance", "equipped"])
def test_states_are_dealt_by_the_match_alone(spark, plan):
    s = Star(spark, SF)
    e = plan.events(s)
    state = W.game_state(W.event_asks(e), plan.frames(s), e)
    text = state._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\(([^)]*)\)", text))
    assert dealt and all(len(d.split(",")) == 2 for d in dealt)  # one key and the number of partitions


def test_states_carry_only_what_is_read(spark):
    s = Star(spark, SF)
    plan = chance.state_at(s)._jdf.queryExecution().optimizedPlan().toString()
    assert "kills_lost_100" in plan and "heralds_100" not in plan and "xp_100" not in plan


def test_a_missing_minute_or_match_has_no_state(spark):
    s = Star(spark, SF)
    e, f = chance.events(s), chance.frames(s)
    some = f.where("minute <> 2 AND match_id % 7 <> 3")
    got = W.game_state(W.minute_asks(f, e), some, e).select("match_id", "ask")
    want = {(r.match_id, f"m:{r.minute}") for r in f.where("match_id % 7 <> 3 AND minute <> 2").select("match_id", "minute").distinct().collect()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_earnings_are_not_dealt_by_minute(spark):
    s = Star(spark, SF)
    f, curve, earned, _ = chance.facts(s)
    text = W.drift_shares(curve, f, earned)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\([^)]*(?:minute|player)#", text)


def test_document_joins_are_merged(spark):
    s = Star(spark, SF)
    p, t = written(M.participants(documents.matches(s)), "participants"), written(documents.timelines(s), "timelines")
    minutes = written(M.with_differences(M.minute_frames(t), p), "minutes")
    for df in (M.with_differences(M.minute_frames(t), p), M.deaths(M.events(t, ["CHAMPION_KILL"]), minutes, p), M.team_gold(minutes, p)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_parsed_once(spark):
    s = Star(spark, SF)
    for query in (documents.standing_purchases, documents.minute_counters, documents.death_details):
        assert "from_json" not in query(s)._jdf.queryExecution().optimizedPlan().toString()
