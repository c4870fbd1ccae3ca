"""A document's minutes meet their lane opponent's where the match is."""

import re

from peerscope.sources import matches as M


def test_differences_are_dealt_by_the_match(spark):
    """minutes were shuffled by participant, by opponent and minute, and once more as the opponent's."""
    rows = [("a", p, m, 100 * p + m, p * m, 2 * p) for p in (1, 2, 3) for m in (0, 1, 3) if (p, m) != (2, 1)] + [("b", 1, 0, 5, 6, 7)]
    minutes = spark.createDataFrame(rows, "match_id string, participant_id int, minute int, gold int, xp int, cs int")
    players = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("a", 3, None), ("c", 1, 2)], "match_id string, participant_id int, opponent_id int")
    out = M.with_differences(minutes, players)
    text = out._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\(([^)]*)\)", text))
    assert dealt and all(len(d.split(",")) == 2 for d in dealt) and "Join" not in text
    at, rival = {r[:3]: r[3:] for r in rows}, {("a", 1): 2, ("a", 2): 1}
    want = {}
    for (match, p, m), mine in at.items():
        other = at.get((match, rival.get((match, p)), m))
        want[match, p, m] = tuple(x - y for x, y in zip(mine, other)) if other else (None,) * 3
    assert {(r.match_id, r.participant_id, r.minute): (r.gold_diff, r.xp_diff, r.cs_diff) for r in out.collect()} == want
    assert out.columns == [*minutes.columns, "gold_diff", "xp_diff", "cs_diff"]
