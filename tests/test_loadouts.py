"""Runes, skills and places of choices where the SQL twins don't reach."""

import json
from collections import Counter

from pyspark.sql import functions as F

from peerscope.operators import statistics as G
from peerscope.sources import matches as M


def test_rune_pages_of_odd_documents(spark):
    """No runes, empty styles, a style without selections, missing shards."""
    person = lambda i, **perks: {"participantId": i, "teamId": 100, "championId": i, "win": True, **({"perks": perks} if perks else {})}
    people = [person(1), person(2, styles=[]), person(3, styles=[{"style": 8000}, {"style": 8100, "selections": [{"perk": 7}]}]),
              person(4, styles=[{"style": 8000, "selections": [{"perk": 1}, {"perk": 2}]}], statPerks={"flex": 9}),
              person(5, statPerks={"offense": 3, "defense": 4})]
    text = json.dumps({"metadata": {"matchId": "m"}, "info": {"participants": people}})
    docs, _ = M.parsed(spark.createDataFrame([(1, text)], "k int, text string"), "text", M.MATCH_SCHEMA, "k")
    got = {r["participant_id"]: (r["keystone"], r["primary_style"], r["sub_style"], r["perks"]) for r in M.participants(docs).collect()}
    assert got == {1: (None,) * 4, 2: (None,) * 4, 3: (None, 8000, 8100, [7]), 4: (1, 8000, None, [1, 2, 9]), 5: (None, None, None, [3, 4])}


def test_skill_orders_shown(spark):
    """The whole order counts from 15 level-ups on; one row of a kind is shown, ties go to more wins, then to the key."""
    full, other, short = "QWEQQRQWQWRWWEE", "EQWEERQEQEQRQQWW", "QWEQQRQWQ"
    rows = [(full, 1), (full, 0), (other, 1), (other, 1), (short, 0), ("QWE", 1), (None, 1)]
    orders = spark.createDataFrame([("mid", o, bool(w)) for o, w in rows], "role string, skill_order string, win boolean")
    got = {(r["kind"], r["place"]): r for r in G.top_shown(G.skill_choices(orders, ["role"]), ["role"]).collect()}
    assert {k: (r["key"], r["games"], r["wins"]) for k, r in got.items()} == {
        ("skill_order", 1): (other[:15], 2, 2), ("skill_max", 1): ("QWE", 3, 1), ("skill_max", 2): ("EQW", 2, 2)}
    assert got["skill_order", 1]["pick_rate"] == 100 * 2 / 7


def test_places_of_each_kind(spark):
    """Each kind has its own number of places, also if one choice holds most rows; empty tables give none."""
    keys = [f"k{i % 7}" if i % 3 else "k0" for i in range(300)]
    rows = spark.createDataFrame([(k, i % 2 == 0) for i, k in enumerate(keys)], "key string, win boolean")
    choices = rows.select(F.lit("r").alias("role"), F.explode(F.array(*map(F.lit, ["runes", "rune_pages", "nothing"]))).alias("kind"), "key", "win")
    got = G.top_shown(choices, ["role"]).collect()
    best = sorted(Counter(keys).items(), key=lambda kv: (-kv[1], -sum(k == kv[0] and i % 2 == 0 for i, k in enumerate(keys)), kv[0]))
    assert [r["key"] for r in sorted(got, key=lambda r: r["place"]) if r["kind"] == "runes"] == [k for k, _ in best[:3]]
    assert [r["key"] for r in got if r["kind"] == "rune_pages"] == [best[0][0]]
    assert {r["kind"] for r in got} == {"runes", "rune_pages"}
    assert G.top_shown(choices.limit(0), ["role"]).count() == 0
