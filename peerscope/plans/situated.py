"""Situation examples on the star binding: an order is a match of ten seats and eight minutes, its lines are the events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import BAND, BASE, EDGE, MAP_X, MAP_Y
from ..operators import situations as S
from ..operators.ordered import running
from .registry import query
from .star import Star

MINUTES = 8
KIND = "CASE WHEN (item + supplier) % 8 <= 2 THEN 'kill' WHEN (item + supplier) % 8 = 3 THEN 'monster' WHEN (item + supplier) % 8 = 4 THEN 'plate' WHEN (item + supplier) % 8 = 5 THEN 'tower' ELSE 'ward' END"
MONSTER = "CASE WHEN (item + supplier) % 8 = 3 THEN CASE supplier % 4 WHEN 0 THEN 'DRAGON' WHEN 1 THEN 'HORDE' WHEN 2 THEN 'RIFTHERALD' ELSE 'BARON_NASHOR' END END"
PLACE_X, PLACE_Y = "(match_id * 31 + participant * 1977 + minute * 1543) % 14870", "(match_id * 17 + participant * 2311 + minute * 977) % 14980"
#: The enemy jungler's seat is empty in some matches.
ROLE = "CASE WHEN match_id % 13 = 0 AND participant = 7 THEN '' WHEN participant % 5 = 1 THEN 'TOP' WHEN participant % 5 = 2 THEN 'JUNGLE' WHEN participant % 5 = 3 THEN 'MIDDLE' WHEN participant % 5 = 4 THEN 'BOTTOM' ELSE 'UTILITY' END"


def log(s: Star) -> DataFrame:
    p = s.played().select(F.col("game_id").alias("match_id"), ((F.col("slot") - 1) * 60000 + F.col("price") % 60000).cast("long").alias("t"), "item", "supplier", "quantity", "price", "discount", "flag")
    return p.withColumn("participant", (F.col("item") % 10 + 1).cast("int"))


def frames(s: Star) -> DataFrame:
    # Lines are dealt by their match once; the cells, empty ones among them, then need no other shuffle.
    p = log(s).select("match_id", "participant", F.ceil(F.col("t") / 60000).cast("int").alias("minute"), *[F.when(c, F.col("quantity")).alias(n) for n, c in (("a", F.col("flag") != "N"), ("b", F.col("flag") == "N"))],
                      F.col("discount").alias("d")).repartition("match_id")
    cells = p.select("match_id").distinct().select("match_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("participant"))
    cells = cells.select("match_id", "participant", F.explode(F.sequence(F.lit(0), F.lit(MINUTES - 1))).alias("minute"), *[F.lit(0).cast("long").alias(n) for n in "abd"])
    mine = p.where(F.col("match_id").isNotNull() & F.col("participant").between(1, 10) & F.col("minute").between(0, MINUTES - 1))
    per = mine.unionByName(cells).groupBy("match_id", "participant", "minute").agg(*[F.sum(n).alias(n) for n in "abd"])
    f = running(per, ["match_id", "participant"], ["minute"], {f"s{n}": ("sum", F.col(n)) for n in "abd"})
    return f.select("match_id", "participant", F.when(F.col("participant") <= 5, 100).otherwise(200).alias("team"), F.expr(ROLE).alias("role"), "minute", (F.col("minute") * 60000).cast("long").alias("t"),
                    F.expr(PLACE_X).cast("double").alias("x"), F.expr(PLACE_Y).cast("double").alias("y"), (1 + F.col("minute") + (F.col("match_id") + F.col("participant")) % 3).alias("level"),
                    (F.col("sd") * 10).alias("current_gold"), (500 + 100 * (F.col("sa") + F.col("sb"))).alias("total_gold"), F.col("sa").alias("cs"), F.col("sb").alias("jungle_cs"))


def events(s: Star) -> DataFrame:
    p = log(s)
    killer = F.when(F.col("quantity") == 50, 0).otherwise(F.col("participant"))
    here = F.col("quantity") % 11 != 0
    return p.select("match_id", "t", F.struct("item", "supplier", "price", "quantity").alias("pos"), F.expr(KIND).alias("kind"), F.expr(MONSTER).alias("monster"), killer.alias("killer"),
                    F.when(killer > 5, 200).when(killer > 0, 100).alias("killer_team"), (F.col("supplier") % 10 + 1).cast("int").alias("victim"),
                    F.when(F.col("quantity") > 25, F.array(((F.col("item") + 1) % 10 + 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("assists"), (100 + 100 * (F.col("supplier") % 2)).cast("int").alias("team"),
                    F.when(here, (F.col("price") * 7 % 14870).cast("double")).alias("x"), F.when(here, (F.col("price") * 13 % 14980).cast("double")).alias("y"))


def _zone(u: str, v: str) -> str:
    z = f"""CASE WHEN {u} < {BASE} AND {v} < {BASE} THEN 'own_base' WHEN {u} > 1 - {BASE} AND {v} > 1 - {BASE} THEN 'enemy_base' WHEN {u} < {EDGE} OR {v} > 1 - {EDGE} THEN 'top_lane' WHEN {v} < {EDGE} OR {u} > 1 - {EDGE} THEN 'bot_lane'
    WHEN abs({u} - {v}) < {BAND} THEN 'mid_lane' WHEN abs({u} + {v} - 1) < {BAND} THEN 'river' WHEN {u} + {v} < 1 THEN 'own_jungle' ELSE 'enemy_jungle' END"""
    return z


def _nudged(v: str) -> str:
    """Borders of a rounded feature go up, as in the operator."""
    m = re.fullmatch(r"round\((.*), (\d)\)", v, re.DOTALL)
    return f"round({m[1]} + 1e-9, {m[2]})" if m else v


def situation_sql(role: str) -> str:
    """Every feature counted anew for each example, from the events before it."""
    main = "jungle_cs" if role == "JUNGLE" else "cs"
    kills = lambda who: f"count(*) FILTER (e.kind = 'kill' AND e.killer = {who})"
    count = lambda cond: f"count(*) FILTER ({cond})"
    monster = lambda m, team: count(f"e.monster = '{m}' AND e.killer_team = {team}")
    last = lambda cond: f"max(e.t) FILTER ({cond})"
    side = lambda x, y, u: f"CASE b.team WHEN 200 THEN 1 - {y} / {MAP_Y} ELSE {x} / {MAP_X} END" if u else f"CASE b.team WHEN 200 THEN 1 - {x} / {MAP_X} ELSE {y} / {MAP_Y} END"
    f = {"u": "round(b.u, 4)", "v": "round(b.v, 4)", "level": "b.level", "current_gold": "b.current_gold", "total_gold": "b.total_gold", "main_cs": f"b.{main}", "level_diff_opp": "b.level - coalesce(opp.level, 0)",
         "cs_diff_opp": f"b.{main} - coalesce(opp.{main}, 0)", "kill_diff_opp": "k.kill_diff_opp", "deaths": "k.deaths", "team_kill_diff": "k.team_kill_diff", "own_dragons": "k.own_dragons", "enemy_dragons": "k.enemy_dragons",
         "own_grubs": "k.own_grubs", "minutes_since_dragon": "(b.t - coalesce(k.last_dragon, 0)) / 60000", "died_recently": "coalesce(b.t - k.my_death < 60000, false)::INT", "own_barons": "k.own_barons", "enemy_barons": "k.enemy_barons",
         "minutes_since_baron": "(b.t - coalesce(k.last_baron, 0)) / 60000", "own_plates": "k.own_plates", "enemy_plates": "k.enemy_plates", "own_towers": "k.own_towers", "enemy_towers": "k.enemy_towers"}
    for n, first, again in (("dragon", S.DRAGON, S.DRAGON_AGAIN), ("baron", S.BARON, S.BARON_AGAIN)):
        due = f"coalesce(k.last_{n} / 60000 + {again}, {first})"
        f |= {f"{n}_up_in": f"round(least(greatest({due} - b.t / 60000, -5), 10), 2)", f"{n}_up": f"({due} <= b.t / 60000)::INT"}
    for n, first, most in (("grubs", S.GRUBS, 10), ("herald", S.HERALD, 15)):
        f |= {f"{n}_up_in": f"round(least(greatest({first} - b.t / 60000, 0), {most}), 2)", f"{n}_up": f"(b.t / 60000 >= {first} AND k.{n}_taken = 0)::INT"}
    f |= {f"cs_gain_{n}m": f"b.{main} - (SELECT p.{main} FROM fr p WHERE p.match_id = b.match_id AND p.participant = b.participant AND p.minute = b.minute - {n})" for n in (1, 2)}
    f |= {f"in_{z}": f"(b.zone = '{z}')::INT" for z in S.ZONES}
    for lane in S.LANE_ROLES:
        n, key = lane.lower(), lane.lower()
        f |= {f"{key}_level_diff": f"coalesce(a_{n}.level, 0) - coalesce(f_{n}.level, 0)", f"{key}_cs_diff": f"coalesce(a_{n}.cs, 0) - coalesce(f_{n}.cs, 0)", f"{key}_kill_diff": f"k.{key}_kill_diff",
              f"{key}_ally_dead": f"coalesce(b.t - k.{key}_death < 30000, false)::INT", f"{key}_ally_push": f"round(coalesce(({side(f'a_{n}.x', f'a_{n}.y', True)}) + ({side(f'a_{n}.x', f'a_{n}.y', False)}), 0), 3)",
              f"{key}_ally_dist": f"round(coalesce(sqrt(pow(({side(f'a_{n}.x', f'a_{n}.y', True)}) - b.u, 2) + pow(({side(f'a_{n}.x', f'a_{n}.y', False)}) - b.v, 2)), 0), 3)"}
    if role != "JUNGLE":
        f |= {"ally_jg_u": f"round(coalesce({side('jg.x', 'jg.y', True)}, 0), 4)", "ally_jg_v": f"round(coalesce({side('jg.x', 'jg.y', False)}, 0), 4)",
              "ally_jg_dist": f"round(coalesce(sqrt(pow(({side('jg.x', 'jg.y', True)}) - b.u, 2) + pow(({side('jg.x', 'jg.y', False)}) - b.v, 2)), 0), 3)"}
    if role == "UTILITY":
        f |= {"duo_dist": "round(coalesce(sqrt(pow(b.x - a_bottom.x, 2) + pow(b.y - a_bottom.y, 2)), 1e9) / 1000, 3)", "duo_level_diff": "coalesce(a_bottom.level, 0) - coalesce(f_bottom.level, 0)", "wards_placed": "k.wards"}
    f |= {"enemy_jg_seen_minutes_ago": "coalesce(least((b.t - sn.t) / 60000, 15), 15)", "enemy_jg_seen_topside": "CASE WHEN sn.t IS NULL THEN 0.5 ELSE (sn.v > sn.u)::INT END",
          "enemy_jg_seen_on_our_half": "CASE WHEN sn.t IS NULL THEN 0.5 ELSE (sn.u + sn.v < 1)::INT END"}
    if role == "JUNGLE":
        f["minutes_since_farm"] = f"""b.minute - coalesce((SELECT max(p.minute) FROM fr p JOIN fr q ON q.match_id = p.match_id AND q.participant = p.participant AND q.minute = p.minute - 1
      WHERE p.match_id = b.match_id AND p.participant = b.participant AND p.minute <= b.minute AND p.{main} > q.{main}), 0)"""
    seat = lambda name, team, r: f"LEFT JOIN fr {name} ON {name}.match_id = b.match_id AND {name}.minute = b.minute AND {name}.team = {team} AND {name}.role = '{r}'"
    seats = "\n".join([seat("opp", "300 - b.team", role), seat("jg", "b.team", "JUNGLE"), seat("ejg", "300 - b.team", "JUNGLE"), *[seat(f"{w}_{r.lower()}", t, r) for r in S.LANE_ROLES for w, t in (("a", "b.team"), ("f", "300 - b.team"))]])
    counts = {"kill_diff_opp": f"{kills('b.participant')} - {kills('opp.participant')}", "deaths": count("e.kind = 'kill' AND e.victim = b.participant"), "team_kill_diff": f"{count('e.kind = ' + repr('kill') + ' AND e.killer_team = b.team')} - {count('e.kind = ' + repr('kill') + ' AND e.killer_team = 300 - b.team')}",
              "own_dragons": monster("DRAGON", "b.team"), "enemy_dragons": monster("DRAGON", "300 - b.team"), "own_grubs": monster("HORDE", "b.team"), "own_barons": monster("BARON_NASHOR", "b.team"), "enemy_barons": monster("BARON_NASHOR", "300 - b.team"),
              "grubs_taken": count("e.monster = 'HORDE'"), "herald_taken": count("e.monster = 'RIFTHERALD'"), "last_dragon": last("e.monster = 'DRAGON'"), "last_baron": last("e.monster = 'BARON_NASHOR'"),
              "my_death": last("e.kind = 'kill' AND e.victim = b.participant"), "wards": count("e.kind = 'ward' AND e.killer = b.participant")}
    for what in ("plate", "tower"):
        counts |= {f"own_{what}s": count(f"e.kind = '{what}' AND e.team = 300 - b.team"), f"enemy_{what}s": count(f"e.kind = '{what}' AND e.team = b.team")}
    for r in S.LANE_ROLES:
        n = r.lower()
        counts |= {f"{n}_kill_diff": f"{kills(f'a_{n}.participant')} - {kills(f'f_{n}.participant')}", f"{n}_death": last(f"e.kind = 'kill' AND e.victim = a_{n}.participant")}
    return f"""WITH p0 AS (SELECT l_orderkey AS match_id, (l_linenumber - 1) * 60000 + CAST(round(l_extendedprice) AS BIGINT) % 60000 AS t, l_partkey AS item, l_suppkey AS supplier, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(round(l_extendedprice) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS discount, l_returnflag AS flag, l_partkey % 10 + 1 AS participant FROM lineitem),
e AS (SELECT *, {KIND} AS kind, {MONSTER} AS monster, CASE WHEN quantity = 50 THEN 0 ELSE participant END AS killer, CASE WHEN quantity = 50 THEN NULL WHEN participant > 5 THEN 200 ELSE 100 END AS killer_team, supplier % 10 + 1 AS victim,
  CASE WHEN quantity > 25 THEN (item + 1) % 10 + 1 END AS helper, 100 + 100 * (supplier % 2) AS team, CASE WHEN quantity % 11 <> 0 THEN price * 7 % 14870 END AS x, CASE WHEN quantity % 11 <> 0 THEN price * 13 % 14980 END AS y FROM p0),
fr AS (SELECT m.match_id, q.participant, CASE WHEN q.participant <= 5 THEN 100 ELSE 200 END AS team, z.minute, {ROLE.replace("participant", "q.participant").replace("match_id", "m.match_id")} AS role, z.minute * 60000 AS t,
  {PLACE_X.replace("participant", "q.participant").replace("match_id", "m.match_id").replace("minute", "z.minute")} AS x, {PLACE_Y.replace("participant", "q.participant").replace("match_id", "m.match_id").replace("minute", "z.minute")} AS y,
  1 + z.minute + (m.match_id + q.participant) % 3 AS level, 10 * coalesce(sum(discount), 0) AS current_gold, 500 + 100 * coalesce(sum(quantity), 0) AS total_gold, coalesce(sum(quantity) FILTER (flag <> 'N'), 0) AS cs, coalesce(sum(quantity) FILTER (flag = 'N'), 0) AS jungle_cs
  FROM (SELECT DISTINCT match_id FROM p0) m CROSS JOIN generate_series(1, 10) q(participant) CROSS JOIN generate_series(0, {MINUTES - 1}) z(minute) LEFT JOIN p0 ON p0.match_id = m.match_id AND p0.participant = q.participant AND p0.t <= z.minute * 60000 GROUP BY ALL),
b0 AS (SELECT *, CASE team WHEN 200 THEN 1 - y / {MAP_Y} ELSE x / {MAP_X} END AS u, CASE team WHEN 200 THEN 1 - x / {MAP_X} ELSE y / {MAP_Y} END AS v FROM fr WHERE role = '{role}' AND minute BETWEEN {S.FIRST} AND {min(S.LAST, MINUTES - 2)}),
b AS (SELECT *, {_zone("u", "v")} AS zone FROM b0),
k AS (SELECT b.match_id, b.participant, b.minute, {", ".join(f"{v} AS {n}" for n, v in counts.items())} FROM b
{seats}
LEFT JOIN e ON e.match_id = b.match_id AND e.t <= b.t GROUP BY b.match_id, b.participant, b.minute),
sn AS (SELECT b.match_id, b.participant, b.minute, e.t, {side(f"coalesce(e.x, {MAP_X / 2})", f"coalesce(e.y, {MAP_Y / 2})", True)} AS u, {side(f"coalesce(e.x, {MAP_X / 2})", f"coalesce(e.y, {MAP_Y / 2})", False)} AS v
  FROM b {seat("ejg", "300 - b.team", "JUNGLE")} JOIN e ON e.match_id = b.match_id AND e.t <= b.t AND e.kind = 'kill' AND ejg.participant IN (e.killer, e.victim, e.helper)
  QUALIFY row_number() OVER (PARTITION BY b.match_id, b.participant, b.minute ORDER BY e.t DESC, e.item DESC, e.supplier DESC, e.price DESC, e.quantity DESC) = 1)
SELECT b.match_id, b.participant, b.team, b.minute, {", ".join(f"round(CAST({_nudged(v)} AS DOUBLE) + 1e-9, 6) + 0.0 AS {n}" for n, v in f.items())}
FROM b JOIN k ON k.match_id = b.match_id AND k.participant = b.participant AND k.minute = b.minute
LEFT JOIN sn ON sn.match_id = b.match_id AND sn.participant = b.participant AND sn.minute = b.minute
{seats}"""


@query("jungle_situations", situation_sql("JUNGLE"))
def jungle_situations(s: Star) -> DataFrame:
    """All features of the jungle role, for every minute."""
    return S.situations(frames(s), events(s), "JUNGLE")



@query("support_situations", situation_sql("UTILITY"))
def support_situations(s: Star) -> DataFrame:
    """The support's features with the lane partner and the ally jungler; the home lane has its own twin (lane_membership)."""
    return S.situations(frames(s), events(s), "UTILITY").drop("in_home_lane")
