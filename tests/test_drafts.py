"""A draft is shuffled as one row: its candidates only meet tables of champions, in the row or by broadcast."""

import re

from conftest import SF

from peerscope.operators import ratings as R
from peerscope.plans import drafted, rated
from peerscope.plans.star import Star


def test_candidates_are_not_shuffled(spark):
    s = Star(spark, SF)
    for t in (drafted.parts(s), rated.draft_table(s)):
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("Generate explode")]  # what works on candidates
        assert "Aggregate" not in above and not re.findall(r"Join (?!LeftOuter|Cross|Inner)", above)
        physical = t._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in physical[:physical.index("Generate explode")]


def test_unknown_candidates_players_and_others(spark):
    drafts = spark.createDataFrame([(1, "r", "o", 7, ["a", "x"], ["o", None], ["c", "new"]), (2, None, None, None, None, None, ["c"])],
                                   "draft int, role string, opponent string, player int, allies array<string>, enemies array<string>, champions array<string>")
    strength = spark.createDataFrame([("r", "c", 100, 80)], "role string, champion string, games int, wins int")
    lane = spark.createDataFrame([("r", "c", "o", 80, 10)], "role string, champion string, opponent string, games int, wins int")
    pairs = spark.createDataFrame([("c", "a", 15, 15)], "champion string, other string, games int, wins int")
    pool = spark.createDataFrame([(7, "c", 10, 1)], "player int, champion string, games int, wins int")
    got = {(r.draft, r.champion): r for r in R.draft_scores(drafts, strength, lane, pairs, pairs, pool).collect()}
    assert set(got) == {(1, "c"), (1, "new"), (2, "c")}
    best = got[1, "c"]
    assert round(best.strength_x, 6) == 0.619039 and best.lane_x < 0 < best.allies_x <= 0.2 and best.enemies_x == 0.0 and -0.5 <= best.comfort_x < 0
    for key in ((1, "new"), (2, "c")):
        assert all(abs(got[key][f"{p}_x"]) < 1e-12 for p in ("strength", "lane", "allies", "enemies", "comfort")) and abs(got[key].win - 50) < 1e-9
