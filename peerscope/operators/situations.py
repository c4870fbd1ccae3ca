"""What a player could know at each minute: one row of features per (match, participant, minute) of a role.

Inputs are tables:

* ``frames``: match_id, participant (1 to 10), team, role, minute (0, 1, ..), t (ms), x, y, level, current_gold, total_gold, cs, jungle_cs
* ``events``: match_id, t, pos (order of equal times), kind (kill, monster, plate, tower, ward), killer, killer_team, victim, assists,
  monster, team (that lost the plate or tower), x, y

Hidden positions stay hidden: of the enemy jungler only the last kill they were part of is known. Everything
is counted up to the frame's own time, so rows after a minute can't change its features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import MAP_X, MAP_Y, lane_at, own_fraction, own_zone
from .joins import asof
from .ordered import previous, running
from .scale import beside

# Roles, home lanes, first and last minute, spawn times (minutes) and how long things count as recent (ms).
ROLES = ("TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY")
LANE_ROLES = ("TOP", "MIDDLE", "BOTTOM")
HOME = {"TOP": "top", "MIDDLE": "mid", "BOTTOM": "bot", "UTILITY": "bot"}
FIRST, LAST = 2, 40
DRAGON, DRAGON_AGAIN, GRUBS, HERALD, BARON, BARON_AGAIN = 5.0, 5.0, 8.0, 15.0, 20.0, 6.0
RECENT, DEAD, UNSEEN = 60_000, 30_000, 15.0
ZONES = ("own_jungle", "enemy_jungle", "river", "top_lane", "mid_lane", "bot_lane", "own_base")
EPIC = {"DRAGON": "dragons", "HORDE": "grubs", "BARON_NASHOR": "barons"}
PLAYERS = range(1, 11)
FIELDS = ("participant", "level", "cs", "jungle_cs", "x", "y")


def seats(frames: DataFrame, *more: Column) -> DataFrame:
    """Each (match, minute) with a struct per (team, role): what the scoreboard and the minimap show; ``more``: other aggregates."""
    cell = F.struct(*FIELDS)
    return frames.groupBy("match_id", "minute").agg(
        F.min("t").alias("t0"), *more, *[F.max(F.when((F.col("team") == t) & (F.col("role") == r), cell)).alias(f"{r}_{t}") for t in (100, 200) for r in ROLES])


def counted(moments: DataFrame, events: DataFrame) -> DataFrame:
    """``moments`` (match_id, t0) with everything counted up to them: one running scan of a match's events."""
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0).cast("long")
    kind, c = F.col("kind"), F.col
    kill, epic = kind == "kill", kind == "monster"
    sums: dict[str, Column] = {}
    for p in PLAYERS:
        sums |= {f"kills_{p}": one(kill & (c("killer") == p)), f"deaths_{p}": one(kill & (c("victim") == p)), f"wards_{p}": one((kind == "ward") & (c("killer") == p))}
    for t in (100, 200):
        by = c("killer_team") == t
        sums |= {f"team_kills_{t}": one(kill & by), f"plates_lost_{t}": one((kind == "plate") & (c("team") == t)), f"towers_lost_{t}": one((kind == "tower") & (c("team") == t)),
                 **{f"{n}_{t}": one(epic & (c("monster") == m) & by) for m, n in EPIC.items()}}
    sums |= {"grubs_taken": one(epic & (c("monster") == "HORDE")), "herald_taken": one(epic & (c("monster") == "RIFTHERALD"))}
    when = lambda cond: F.when(F.coalesce(cond, F.lit(False)), c("t"))
    lasts = {f"died_{p}": when(kill & (c("victim") == p)) for p in PLAYERS} | {"last_dragon": when(epic & (c("monster") == "DRAGON")), "last_baron": when(epic & (c("monster") == "BARON_NASHOR"))}
    rows = events.select("match_id", c("t").alias("_t"), *[v.alias(n) for n, v in (sums | lasts).items()])
    kinds = dict.fromkeys(sums, "sum") | dict.fromkeys(lasts, "max")
    out = asof(moments, rows, ["match_id"], "t0", "_t", {n: n for n in kinds}, kinds=kinds)
    return out.select(*moments.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in sums], *lasts)


def shown(events: DataFrame) -> DataFrame:
    """When and where each participant showed on the kill feed: match_id, participant, t, pos, x, y."""
    who = F.concat(F.array("killer", "victim"), F.coalesce("assists", F.array().cast("array<int>")))
    return events.where("kind = 'kill'").select("match_id", F.explode(F.array_distinct(who)).alias("participant"), "t", "pos", "x", "y")


def rounded(x: Column, digits: int) -> Column:
    """Rounded, borders going up: a billionth more than they are, so that borders don't hang on the order of operations."""
    return F.round(x + 1e-9, digits)


def situations(frames: DataFrame, events: DataFrame, role: str) -> DataFrame:
    """match_id, participant, team, minute and the role's features, for minutes 2 to 40 (not the last whole one)."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    main = "jungle_cs" if role == "JUNGLE" else "cs"
    # Everything is dealt by the match alone: a minute's wide row is made where its match is, and is never shuffled.
    events = events.repartition("match_id")
    keys, order = ["match_id", "participant"], ["minute"]
    every = previous(frames, keys, order, {"_main1": F.col(main)})
    every = previous(every, keys, order, {"_main2": F.col("_main1")})
    if role == "JUNGLE":
        every = running(every, keys, order, {"_farmed": ("max", F.when(F.col(main) > F.col("_main1"), F.col("minute")))})
    own = F.when((F.col("role") == role) & (F.col("minute") >= FIRST) & (F.col("minute") <= LAST), F.struct(*[c for c in every.columns if c not in ("match_id", "minute")]))
    board = beside(seats(every, F.collect_list(own).alias("_own")), ["match_id"], {"_last": F.max("minute")})
    board = counted(board.where((F.size("_own") > 0) & (F.col("minute") <= F.col("_last") - 1) & F.col("match_id").isNotNull()), events)
    red = F.col("team") == 200
    of = lambda name, own=True: F.when(red if own else ~red, F.col(f"{name}_200")).otherwise(F.col(f"{name}_100"))
    j = board.withColumn("_own", F.explode("_own")).select("*", "_own.*").drop("_own").withColumn("_enemy_jg", of("JUNGLE", False)["participant"])
    # Only junglers are looked up, so the other participants' kills meet no row.
    seen = shown(events).select("match_id", F.col("participant").alias("_enemy_jg"), F.col("t").alias("_st"), F.struct("t", "pos", "x", "y").alias("_seen"), "pos")
    j = asof(j, seen, ["match_id", "_enemy_jg"], "t0", "_st", {"_seen": "_seen"}, tie=["pos"])
    f = {n: (rounded(v.cast("double"), 6) + 0.0).alias(n) for n, v in _features(role, main, of, red).items()}
    return j.select("match_id", "participant", "team", "minute", *f.values())


def _features(role: str, main: str, of, red: Column) -> dict[str, Column]:
    c, zero = F.col, lambda v: F.coalesce(v, F.lit(0)).cast("double")
    yes = lambda cond: F.coalesce(cond, F.lit(False)).cast("double")
    t0, now = c("t0"), c("t0") / 60000
    u, v = own_fraction("x", "y", "team")
    by_player = lambda name, who: zero(F.try_element_at(F.array(*[c(f"{name}_{p}") for p in PLAYERS]), who))
    died = lambda who: F.try_element_at(F.array(*[c(f"died_{p}") for p in PLAYERS]), who)
    stat = lambda seat, field: zero(seat[field])
    opponent = of(role, False)
    lost = lambda what: (zero(of(what, False)), zero(of(what)))  # what the enemy lost is this side's gain
    f = {"u": rounded(u, 4), "v": rounded(v, 4), "level": c("level"), "current_gold": c("current_gold"), "total_gold": c("total_gold"), "main_cs": c(main),
         "level_diff_opp": c("level") - stat(opponent, "level"), "cs_diff_opp": c(main) - stat(opponent, main),
         "kill_diff_opp": by_player("kills", c("participant")) - by_player("kills", opponent["participant"]), "deaths": by_player("deaths", c("participant")),
         "team_kill_diff": of("team_kills") - of("team_kills", False), "own_dragons": of("dragons"), "enemy_dragons": of("dragons", False), "own_grubs": of("grubs"),
         "minutes_since_dragon": (t0 - zero(c("last_dragon"))) / 60000, "died_recently": yes(t0 - died(c("participant")) < RECENT),
         "own_barons": of("barons"), "enemy_barons": of("barons", False), "minutes_since_baron": (t0 - zero(c("last_baron"))) / 60000}
    f["own_plates"], f["enemy_plates"] = lost("plates_lost")
    f["own_towers"], f["enemy_towers"] = lost("towers_lost")
    for name, last, first, again in (("dragon", "last_dragon", DRAGON, DRAGON_AGAIN), ("baron", "last_baron", BARON, BARON_AGAIN)):
        due = F.coalesce(c(last) / 60000 + again, F.lit(first))
        f[f"{name}_up_in"] = rounded(F.least(F.greatest(due - now, F.lit(-5.0)), F.lit(10.0)), 2)
        f[f"{name}_up"] = yes(due <= now)
    for name, taken, first, most in (("grubs", "grubs_taken", GRUBS, 10.0), ("herald", "herald_taken", HERALD, 15.0)):
        f[f"{name}_up_in"] = rounded(F.least(F.greatest(F.lit(first) - now, F.lit(0.0)), F.lit(most)), 2)
        f[f"{name}_up"] = yes((now >= first) & (c(taken) == 0))
    f["cs_gain_1m"], f["cs_gain_2m"] = c(main) - zero(c("_main1")), c(main) - zero(c("_main2"))
    zone = own_zone("x", "y", "team")
    f |= {f"in_{z}": yes(zone == z) for z in ZONES}
    if role != "JUNGLE":
        f["in_home_lane"] = yes(lane_at("x", "y") == HOME[role])
    place = lambda seat: own_fraction(seat["x"], seat["y"], "team")
    apart = lambda au, av: F.sqrt(F.pow(au - u, 2) + F.pow(av - v, 2))
    for lane in LANE_ROLES:
        ally, foe, key = of(lane), of(lane, False), lane.lower()
        au, av = place(ally)
        f |= {f"{key}_level_diff": stat(ally, "level") - stat(foe, "level"), f"{key}_cs_diff": stat(ally, "cs") - stat(foe, "cs"),
              f"{key}_kill_diff": by_player("kills", ally["participant"]) - by_player("kills", foe["participant"]), f"{key}_ally_dead": yes(t0 - died(ally["participant"]) < DEAD),
              f"{key}_ally_push": rounded(zero(au + av), 3), f"{key}_ally_dist": rounded(zero(apart(au, av)), 3)}
    if role != "JUNGLE":
        ju, jv = place(of("JUNGLE"))
        f |= {"ally_jg_u": rounded(zero(ju), 4), "ally_jg_v": rounded(zero(jv), 4), "ally_jg_dist": rounded(zero(apart(ju, jv)), 3)}
    if role in ("BOTTOM", "UTILITY"):
        other = "UTILITY" if role == "BOTTOM" else "BOTTOM"
        partner = of(other)
        gap = F.sqrt(F.pow(c("x") - partner["x"], 2) + F.pow(c("y") - partner["y"], 2))
        f |= {"duo_dist": rounded(F.coalesce(gap, F.lit(1e9)) / 1000, 3), "duo_level_diff": stat(partner, "level") - stat(of(other, False), "level")}
    if role == "UTILITY":
        f["wards_placed"] = by_player("wards", c("participant"))
    seen = c("_seen")
    su, sv = own_fraction(F.coalesce(seen["x"], F.lit(MAP_X / 2)), F.coalesce(seen["y"], F.lit(MAP_Y / 2)), "team")
    known = seen.isNotNull()
    f |= {"enemy_jg_seen_minutes_ago": F.when(known, F.least((t0 - seen["t"]) / 60000, F.lit(UNSEEN))).otherwise(UNSEEN),
          "enemy_jg_seen_topside": F.when(known, yes(sv > su)).otherwise(0.5), "enemy_jg_seen_on_our_half": F.when(known, yes(su + sv < 1)).otherwise(0.5)}
    if role == "JUNGLE":
        f["minutes_since_farm"] = c("minute") - zero(c("_farmed"))
    return f
