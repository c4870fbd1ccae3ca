"""Match and timeline documents to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import EPIC_MONSTERS, WARD_TYPES
from ..functions.expr import duration_seconds, ratio, readable_zone, zone
from ..operators.joins import asof
from ..operators.ordered import running
from ..operators.scale import grown, hot_keys, written

PARTICIPANT = """participantId int, puuid string, teamId int, teamPosition string, championId int, championName string, win boolean,
kills int, deaths int, assists int, totalMinionsKilled int, neutralMinionsKilled int, goldEarned int, totalDamageDealtToChampions int,
magicDamageDealtToChampions int, totalDamageTaken int, damageSelfMitigated int, totalTimeSpentDead int, totalHealsOnTeammates int,
totalDamageShieldedOnTeammates int, visionScore int, wardsPlaced int, wardsKilled int, detectorWardsPlaced int, champLevel int, timePlayed int,
gameEndedInEarlySurrender boolean, summoner1Id int, summoner2Id int, item0 int, item1 int, item2 int, item3 int, item4 int, item5 int, item6 int,
doubleKills int, tripleKills int, quadraKills int, pentaKills int, largestMultiKill int, firstBloodKill boolean,
perks struct<statPerks: struct<offense: int, flex: int, defense: int>, styles: array<struct<style: int, selections: array<struct<perk: int>>>>>"""
MATCH_SCHEMA = f"""metadata struct<matchId: string>, info struct<gameCreation: bigint, gameStartTimestamp: bigint, gameEndTimestamp: bigint,
gameDuration: bigint, gameVersion: string, queueId: int, participants: array<struct<{PARTICIPANT.replace(chr(10), ' ')}>>,
teams: array<struct<teamId: int, win: boolean, bans: array<struct<championId: int, pickTurn: int>>,
objectives: map<string, struct<first: boolean, kills: int>>>>>"""
EVENT = """type string, timestamp bigint, killerId int, victimId int, creatorId int, participantId int, assistingParticipantIds array<int>,
position struct<x: int, y: int>, bounty int, shutdownBounty int, wardType string, killerTeamId int, monsterType string, monsterSubType string,
teamId int, buildingType string, towerType string, laneType string, itemId int, beforeId int, skillSlot int, levelUpType string, level int,
victimDamageReceived array<struct<participantId: int, physicalDamage: int, magicDamage: int, trueDamage: int>>, winningTeam int"""
FRAME = """participantId int, totalGold int, currentGold int, xp int, level int, minionsKilled int, jungleMinionsKilled int,
position struct<x: int, y: int>, damageStats struct<totalDamageDoneToChampions: int>"""
TIMELINE_SCHEMA = f"""metadata struct<matchId: string>, info struct<frameInterval: bigint, frames: array<struct<timestamp: bigint,
participantFrames: map<string, struct<{FRAME.replace(chr(10), ' ')}>>, events: array<struct<{EVENT.replace(chr(10), ' ')}>>>>>"""


def _inner(schema: str) -> str:
    return schema.replace("\n", " ")


def parsed(raw: DataFrame, text: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a text column: a malformed document is recorded with a reason, not fatal."""
    ddl = _inner(schema) + ", _corrupt string"
    doc = F.from_json(F.col(text), ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # A generator's output is a value of its own: the optimizer can't copy the parse into each use of it.
    d = raw.select("*", F.explode(F.array(doc)).alias("_doc"))
    reason = (F.when(F.col(text).isNull(), "empty").when(F.col("_doc._corrupt").isNotNull(), "malformed")
              .when(F.col("_doc.metadata.matchId").isNull(), "no match id").when(F.col("_doc.info").isNull(), "no info"))
    d = d.withColumn("_reason", reason)
    good = d.where("_reason IS NULL").select("_doc.metadata", "_doc.info")
    return good, d.where("_reason IS NOT NULL").select(F.col(key), F.col("_reason").alias("reason"))


def read_matches(spark, path: str) -> DataFrame:
    return spark.read.schema(_inner(MATCH_SCHEMA)).json(path)


def read_timelines(spark, path: str) -> DataFrame:
    return spark.read.schema(_inner(TIMELINE_SCHEMA)).json(path)


def _exploded(matches: DataFrame, everyone: bool = False) -> DataFrame:
    i = "info."
    return matches.select(
        F.col("metadata.matchId").alias("match_id"), F.timestamp_millis(F.col(i + "gameStartTimestamp")).alias("game_start"),
        duration_seconds(i + "gameDuration", i + "gameEndTimestamp").alias("duration_s"), F.substring_index(i + "gameVersion", ".", 2).alias("patch"),
        F.col(i + "queueId").alias("queue_id"), F.explode(i + "participants").alias("p"),
        *([F.col(i + "participants").alias("everyone")] if everyone else []))


def core_participants(matches: DataFrame) -> DataFrame:
    """Result and K/D/A only; the narrow projection prunes the rest of the document."""
    e = _exploded(matches)
    return e.select("match_id", *[F.col(f"p.{c}").alias(n) for c, n in (
        ("participantId", "participant_id"), ("puuid", "player"), ("teamId", "team"), ("championId", "champion"), ("teamPosition", "role"),
        ("win", "win"), ("kills", "kills"), ("deaths", "deaths"), ("assists", "assists"))])


def rune_columns(perks: Column) -> list[Column]:
    """Keystone, main and second style, and the whole page: the perks of all styles, then the shards there are (null if none)."""
    styles = F.coalesce(perks["styles"], F.array().cast(perks_type("styles")))
    main, second = F.get(styles, F.lit(0)), F.get(styles, F.lit(1))
    chosen = F.flatten(F.transform(styles, lambda s: F.transform(F.coalesce(s["selections"], F.array().cast(perks_type("selections"))), lambda x: x["perk"])))
    page = F.filter(F.concat(chosen, F.array(*[perks["statPerks"][k] for k in ("offense", "flex", "defense")])), lambda x: x.isNotNull())
    return [F.get(main["selections"], F.lit(0))["perk"].alias("keystone"), main["style"].alias("primary_style"), second["style"].alias("sub_style"),
            F.when(F.size(page) > 0, page).alias("perks")]


def perks_type(part: str) -> str:
    selections = "array<struct<perk: int>>"
    return selections if part == "selections" else f"array<struct<style: int, selections: {selections}>>"


def participants(matches: DataFrame) -> DataFrame:
    """Build rows: one wide row per participant with team totals, items, multikills and the lane opponent.

    Totals and the opponent (the enemy of the same role, if exactly one) come from the document's own list of
    participants, so no shuffle is needed.
    """
    p = lambda c: F.col(f"p.{c}")
    z = lambda c: F.coalesce(p(c), F.lit(0))
    everyone = F.col("everyone")
    mates = lambda *cs: F.aggregate(F.filter(everyone, lambda q: q["teamId"] == p("teamId")), F.lit(0).cast("long"),
                                    lambda acc, q: acc + sum((F.coalesce(q[c], F.lit(0)) for c in cs), F.lit(0)))
    rivals = F.filter(everyone, lambda q: (q["teamId"] != p("teamId")) & (q["teamPosition"] == p("teamPosition")) & (p("teamPosition") != ""))
    rival = F.when(F.size(rivals) == 1, F.get(rivals, F.lit(0)))
    return _exploded(matches, everyone=True).select(
        "match_id", "game_start", "duration_s", "patch", "queue_id", p("participantId").alias("participant_id"), p("puuid").alias("player"),
        p("teamId").alias("team"), F.coalesce(p("teamPosition"), F.lit("")).alias("role"), p("championId").alias("champion"), p("win").alias("win"),
        p("kills").alias("kills"), p("deaths").alias("deaths"), p("assists").alias("assists"),
        (z("totalMinionsKilled") + z("neutralMinionsKilled")).alias("cs"), z("totalDamageDealtToChampions").alias("damage"),
        z("magicDamageDealtToChampions").alias("magic_damage"), (z("totalDamageTaken") + z("damageSelfMitigated")).alias("damage_taken"), z("goldEarned").alias("gold"),
        z("visionScore").alias("vision"), z("wardsPlaced").alias("wards_placed"), z("wardsKilled").alias("wards_killed"), z("detectorWardsPlaced").alias("control_wards"),
        z("totalTimeSpentDead").alias("time_dead"), (z("totalHealsOnTeammates") + z("totalDamageShieldedOnTeammates")).alias("heal_shield"),
        F.array(*[z(f"item{i}") for i in range(7)]).alias("items"), F.array_sort(F.array(z("summoner1Id"), z("summoner2Id"))).alias("spells"),
        z("doubleKills").alias("double_kills"), z("tripleKills").alias("triple_kills"), z("quadraKills").alias("quadra_kills"), z("pentaKills").alias("penta_kills"),
        z("largestMultiKill").alias("largest_multikill"), F.coalesce(p("firstBloodKill"), F.lit(False)).alias("first_blood"),
        F.coalesce(p("gameEndedInEarlySurrender"), F.lit(False)).alias("remake"), *rune_columns(p("perks")),
        mates("kills").alias("team_kills"), mates("totalDamageDealtToChampions").alias("team_damage"), mates("totalDamageTaken", "damageSelfMitigated").alias("team_taken"),
        rival["championId"].alias("opponent"), rival["participantId"].alias("opponent_id"))


def bans(matches: DataFrame) -> DataFrame:
    t = matches.select(F.col("metadata.matchId").alias("match_id"), F.explode("info.teams").alias("t"))
    b = t.select("match_id", F.col("t.teamId").alias("team"), F.explode("t.bans").alias("b"))
    return b.select("match_id", "team", F.col("b.pickTurn").alias("turn"), F.col("b.championId").alias("champion")).where("champion > 0")


def objectives(matches: DataFrame) -> DataFrame:
    t = matches.select(F.col("metadata.matchId").alias("match_id"), F.explode("info.teams").alias("t"))
    return t.select("match_id", F.col("t.teamId").alias("team"), F.col("t.win").alias("win"), F.explode("t.objectives").alias("objective", "o")).select(
        "match_id", "team", "win", "objective", F.coalesce("o.first", F.lit(False)).alias("first"), F.coalesce("o.kills", F.lit(0)).alias("kills"))


def minute_frames(timelines: DataFrame, tolerance_ms: int = 5_000) -> DataFrame:
    """One row per participant and minute.

    A frame is minute m's if it lands at most ``tolerance_ms`` after the mark; the first such frame counts. A
    missing minute takes the frame before it (the very first frame if there is none), so row m is always the
    state at minute m. A document holds all its frames, so this is worked out inside the row, without a shuffle.
    """
    c = F.col
    minute = lambda f: F.floor(f["timestamp"] / 60000).cast("int")
    in_time = F.sort_array(F.transform("info.frames", lambda f, i: F.struct(f["timestamp"].alias("at"), i.alias("i"))))
    placed = F.filter(F.transform(in_time, lambda o: F.struct(minute(F.get("info.frames", o["i"])).alias("minute"), F.get("info.frames", o["i"]).alias("f"))),
                      lambda v: v["f"]["timestamp"] - v["minute"].cast("long") * 60000 <= tolerance_ms)
    d = timelines.select(c("metadata.matchId").alias("match_id"), F.get("info.frames", F.get(in_time, F.lit(0))["i"]).alias("_first"), placed.alias("_v")).where(F.size("_v") > 0)
    d = d.withColumn("_v", F.filter("_v", lambda v, i: (i == 0) | (v["minute"] != F.get(c("_v"), F.greatest(i - 1, F.lit(0)))["minute"])))
    lead = F.when(F.get("_v", F.lit(0))["minute"] > 0, F.array(F.struct(F.lit(0).alias("minute"), c("_first").alias("f"))))
    d = d.withColumn("_v", F.concat(F.coalesce(lead, F.slice("_v", 1, 0)), "_v"))
    # A frame stands for its minute and the missing ones after it, up to the last known minute.
    spans = F.transform("_v", lambda v, i: F.struct(v["f"].alias("f"), F.sequence(
        v["minute"], F.coalesce(F.get(c("_v"), i + 1)["minute"] - 1, v["minute"])).alias("at")))
    r = d.select("match_id", F.explode(spans).alias("_s"))
    r = r.select("match_id", c("_s.f.timestamp").alias("frame_ms"), c("_s.at").alias("_at"), F.explode("_s.f.participantFrames").alias("pid", "r"))
    r = r.select("match_id", c("pid").cast("int").alias("participant_id"), "frame_ms", "r", F.explode("_at").alias("minute"))
    v = lambda n: F.coalesce(c(f"r.{n}"), F.lit(0))
    return r.select("match_id", "participant_id", "minute", "frame_ms", v("totalGold").alias("gold"), v("currentGold").alias("current_gold"), v("xp").alias("xp"),
                    F.coalesce("r.level", F.lit(1)).alias("level"), (v("minionsKilled") + v("jungleMinionsKilled")).alias("cs"), v("minionsKilled").alias("lane_cs"),
                    v("jungleMinionsKilled").alias("jungle_cs"), F.coalesce("r.damageStats.totalDamageDoneToChampions", F.lit(0)).alias("damage_to_champions"),
                    c("r.position.x").alias("x"), c("r.position.y").alias("y"))


def events(timelines: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """The event log; with ``kinds`` unwanted events are dropped inside the document, before rows are made."""
    all_ = F.flatten(F.transform("info.frames", lambda f: F.coalesce(f["events"], F.array().cast(f"array<struct<{EVENT.replace(chr(10), ' ')}>>"))))
    if kinds:
        all_ = F.filter(all_, lambda e: e["type"].isin(*kinds))
    return timelines.select(F.col("metadata.matchId").alias("match_id"), F.posexplode(all_).alias("pos", "e")).select("match_id", "pos", "e.*")


def purchases(log: DataFrame) -> DataFrame:
    """Purchases that were not undone: an undo takes back the latest purchase of its item still standing.

    Per item the log is a walk of +1 (bought) and -1 (undone), never below zero. A purchase stands if the walk
    does not fall below the level it reached any more, so bracket matching becomes two running minima. The few
    columns are written once, and their rows per key counted once for all three scans: documents are not parsed anew.
    """
    e = log.where(F.col("type").isin("ITEM_PURCHASED", "ITEM_UNDO"))
    buy = F.col("type") == "ITEM_PURCHASED"
    e = e.select("match_id", F.col("participantId").alias("participant_id"), F.when(buy, F.coalesce("itemId", F.lit(0))).otherwise(F.col("beforeId")).alias("item"),
                 "timestamp", "pos", buy.alias("_buy")).where("item IS NOT NULL AND (_buy OR item > 0)")
    e = written(e, "purchases")
    keys, order = ["match_id", "participant_id", "item"], ["timestamp", "pos"]
    hot = hot_keys(e, keys, order[0])
    w = running(e, keys, order, {"_s": ("sum", F.when(F.col("_buy"), 1).otherwise(-1).cast("long"))}, hot=hot)
    w = running(w, keys, order, {"_m": ("min", F.col("_s"))}, hot=hot)
    w = w.withColumn("_level", F.col("_s") - F.least(F.col("_m"), F.lit(0)))
    w = running(w, keys, order, {"_after": ("min", F.col("_level"))}, reverse=True, hot=hot)
    return w.where(F.col("_buy") & (F.col("_after") >= F.col("_level"))).select("match_id", "participant_id", "item", F.floor(F.col("timestamp") / 1000).cast("int").alias("second"), "timestamp", "pos")


def skill_orders(log: DataFrame) -> DataFrame:
    """Normal level-ups as a string of Q, W, E, R."""
    letter = F.element_at(F.array(*[F.lit(x) for x in "QWER"]), F.col("skillSlot"))
    e = log.where("type = 'SKILL_LEVEL_UP' AND levelUpType = 'NORMAL' AND skillSlot BETWEEN 1 AND 4")
    o = e.groupBy("match_id", F.col("participantId").alias("participant_id")).agg(F.array_sort(F.collect_list(F.struct("timestamp", "pos", letter.alias("k")))).alias("_o"))
    return o.select("match_id", "participant_id", F.array_join(F.transform("_o", lambda x: x["k"]), "").alias("skill_order"))


COUNTERS = ("kills", "deaths", "assists", "wards_placed", "wards_killed")


def counted_events(log: DataFrame) -> DataFrame:
    """(match, participant, timestamp, counter) rows; an absent assist list means nobody assisted."""
    ward = F.col("wardType").isin(*WARD_TYPES)
    kill = F.col("type") == "CHAMPION_KILL"
    one = lambda cond, who, name: F.when(cond, F.array(F.struct(who.cast("int").alias("participant_id"), F.lit(name).alias("counter"))))
    none = F.array().cast("array<struct<participant_id:int,counter:string>>")
    assists = F.transform(F.coalesce("assistingParticipantIds", F.array().cast("array<int>")), lambda a: F.struct(a.alias("participant_id"), F.lit("assists").alias("counter")))
    rows = F.concat(
        F.coalesce(one(kill, F.col("killerId"), "kills"), none), F.coalesce(one(kill, F.col("victimId"), "deaths"), none), F.when(kill, assists).otherwise(none),
        F.coalesce(one((F.col("type") == "WARD_PLACED") & ward, F.col("creatorId"), "wards_placed"), none),
        F.coalesce(one((F.col("type") == "WARD_KILL") & ward, F.col("killerId"), "wards_killed"), none))
    return log.select("match_id", "timestamp", F.explode(rows).alias("_c")).select("match_id", "_c.participant_id", "timestamp", "_c.counter")


def with_counters(minutes: DataFrame, log: DataFrame) -> DataFrame:
    """Minute rows with everything that happened up to their frame's own time."""
    c = counted_events(log)
    wide = c.select("match_id", "participant_id", F.col("timestamp").alias("_t"), *[F.when(F.col("counter") == n, 1).otherwise(0).cast("long").alias(n) for n in COUNTERS])
    out = asof(minutes, wide, ["match_id", "participant_id"], "frame_ms", "_t", {n: n for n in COUNTERS}, kinds={n: "sum" for n in COUNTERS})
    return out.select(*minutes.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in COUNTERS])


def with_differences(minutes: DataFrame, players: DataFrame) -> DataFrame:
    """Leads over the lane opponent in gold, xp and cs at the same minute."""
    # A match is one document: its minutes are dealt by the match alone and met by scans, instead of three joins' shuffles.
    pair = players.select("match_id", "participant_id", "opponent_id", F.lit(-1).alias("_since")).repartition("match_id")
    m = asof(minutes.repartition("match_id"), pair, ["match_id", "participant_id"], "minute", "_since", {"_opponent": "opponent_id"}, hot=None)
    o = minutes.repartition("match_id").select("match_id", F.col("participant_id").alias("_opponent"), F.col("minute").alias("_t"), *[F.col(c).alias(f"_{c}") for c in ("gold", "xp", "cs")])
    j = asof(m, o, ["match_id", "_opponent"], "minute", "_t", {f"_{c}": f"_{c}" for c in ("gold", "xp", "cs")}, matched_time="_at", hot=None)
    return j.select(*minutes.columns, *[F.when(F.col("_at") == F.col("minute"), F.col(c) - F.col(f"_{c}")).alias(f"{c}_diff") for c in ("gold", "xp", "cs")])


def deaths(log: DataFrame, minutes: DataFrame, players: DataFrame, ahead_gold: int = 500, early_minutes: int = 14) -> DataFrame:
    """Every death with place, killer, assisters, the gold lead at the last full minute, and flags."""
    d = log.where("type = 'CHAMPION_KILL'").select("match_id", F.col("victimId").alias("participant_id"), "timestamp", "pos", F.coalesce("killerId", F.lit(0)).alias("killer"),
                                                   F.size(F.coalesce("assistingParticipantIds", F.array().cast("array<int>"))).alias("assisters"),
                                                   F.coalesce("position.x", F.lit(0)).alias("x"), F.coalesce("position.y", F.lit(0)).alias("y"))
    d = d.join(grown(players.select("match_id", "participant_id", "team")), ["match_id", "participant_id"])
    last = minutes.groupBy(F.col("match_id").alias("_lm")).agg(F.max("minute").alias("_last"))
    d = d.join(grown(last), F.col("match_id") == F.col("_lm")).withColumn("_at", F.least(F.floor(F.col("timestamp") / 60000), F.col("_last")).cast("int"))
    g = minutes.select(F.col("match_id").alias("_m"), F.col("participant_id").alias("_p"), F.col("minute").alias("_t"), "gold_diff")
    j = d.join(grown(g), (F.col("match_id") == F.col("_m")) & (F.col("participant_id") == F.col("_p")) & (F.col("_at") == F.col("_t")), "left")
    z = zone("x", "y")
    return j.select("match_id", "participant_id", "team", "timestamp", "pos", F.round(F.col("timestamp") / 60000, 2).alias("minute"), z.alias("zone"), readable_zone(z, "team").alias("place"),
                    "killer", "assisters", "gold_diff", F.coalesce(F.col("gold_diff") >= ahead_gold, F.lit(False)).alias("ahead"),
                    (F.col("timestamp") < early_minutes * 60000).alias("early"))


def game_metrics(players: DataFrame, minutes: DataFrame, death_rows: DataFrame, log: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """All whole-game metrics of a participant as a {name: number} map; metrics without a value are absent."""
    c = F.col
    mins = F.greatest(c("duration_s") / 60, F.lit(1e-9))
    base = {
        "kills": c("kills"), "deaths": c("deaths"), "assists": c("assists"), "kda": (c("kills") + c("assists")) / F.greatest(c("deaths"), F.lit(1)),
        "cs_per_min": c("cs") / mins, "gold_per_min": c("gold") / mins, "damage_per_min": c("damage") / mins, "damage_share": ratio("damage", "team_damage"),
        "kill_participation": ratio(c("kills") + c("assists"), "team_kills"), "time_dead_share": F.least(F.lit(1.0), c("time_dead") / F.greatest(c("duration_s"), F.lit(1))),
        "heal_shield_per_min": c("heal_shield") / mins, "damage_taken_share": ratio("damage_taken", "team_taken"), "vision_per_min": c("vision") / mins,
        "wards_placed_per_min": c("wards_placed") / mins, "wards_killed": c("wards_killed"), "control_wards": c("control_wards")}
    key = ["match_id", "participant_id"]
    d = death_rows.groupBy(*key).agg(
        F.sum(c("early").cast("int")).alias("early_deaths"), F.sum(c("ahead").cast("int")).alias("deaths_while_ahead"),
        F.count(F.when((c("assisters") == 0) & (c("killer") > 0), 1)).alias("solo_deaths"), F.min_by("minute", F.struct("timestamp", "pos")).alias("first_death_min"))
    solo = log.where("type = 'CHAMPION_KILL' AND coalesce(size(assistingParticipantIds), 0) <= 0").groupBy("match_id", c("killerId").alias("participant_id")).agg(F.count(F.lit(1)).alias("solo_kills"))
    plates = log.where("type = 'TURRET_PLATE_DESTROYED'").groupBy("match_id", c("killerId").alias("participant_id")).agg(F.count(F.lit(1)).alias("turret_plates"))
    points = minutes.where(c("minute").isin(10, 15, 20))
    at = points.groupBy(*key).agg(*[F.max(F.when(c("minute") == m, c(v))).alias(f"{v}_at_{m}") for m in (10, 15, 20) for v in ("cs", "gold", "xp", "gold_diff", "xp_diff", "cs_diff")])
    # Objectives and towers by the taking team, and who took part.
    epic = (c("type") == "ELITE_MONSTER_KILL") & c("monsterType").isin(*EPIC_MONSTERS)
    tower = (c("type") == "BUILDING_KILL") & (c("buildingType") == "TOWER_BUILDING")
    taken = log.where(epic | tower).select("match_id", F.when(epic, "objective").otherwise("tower").alias("what"),
                                           F.when(epic, c("killerTeamId")).when(c("teamId") == 100, 200).otherwise(100).alias("team"),
                                           F.array_distinct(F.concat(F.array(c("killerId")), F.coalesce("assistingParticipantIds", F.array().cast("array<int>")))).alias("who"))
    total = taken.groupBy("match_id", "team").agg(*[F.count(F.when(c("what") == w, 1)).alias(f"_{w}s") for w in ("objective", "tower")])
    part = taken.select("match_id", "team", "what", F.explode("who").alias("participant_id")).groupBy("match_id", "team", "participant_id").agg(
        *[F.count(F.when(c("what") == w, 1)).alias(f"_my_{w}s") for w in ("objective", "tower")])
    j = players.join(grown(total), ["match_id", "team"], "left").join(grown(part), ["match_id", "team", "participant_id"], "left")
    for more in (d, solo, plates, at):
        j = j.join(grown(more), key, "left")
    if timings is not None:
        j = j.join(grown(timings), key, "left")
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    more = {n: zero(n) for n in ("early_deaths", "deaths_while_ahead", "solo_deaths", "solo_kills", "turret_plates")}
    more["first_death_min"] = c("first_death_min")
    for w in ("objective", "tower"):
        more[f"{w}_participation"] = F.when(c(f"_{w}s") > 0, zero(f"_my_{w}s") / F.when(c(f"_{w}s") > 0, c(f"_{w}s")))
    for m in (10, 15, 20):
        for v in ("cs", "gold", "xp", "gold_diff", "xp_diff", "cs_diff"):
            more[f"{v}_at_{m}"] = c(f"{v}_at_{m}")
    if timings is not None:
        more.update({n: c(n) for n in ("first_item_min", "second_item_min", "boots_min")})
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.round(v.cast("double"), 4).alias("v")) for n, v in {**base, **more}.items()])
    return j.select("match_id", "participant_id", "player", "team", "role", "champion", "win",
                    F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("metrics"))


def build_timings(bought: DataFrame, items: DataFrame) -> DataFrame:
    """Minute of the first and second different finished item and of the boots. ``items``: item, finished, boots."""
    b = bought.join(items, "item")
    first = b.where("finished").groupBy("match_id", "participant_id", "item").agg(F.min(F.struct("timestamp", "pos")).alias("_t"))
    f = first.groupBy("match_id", "participant_id").agg(F.min("_t").alias("_1"))
    second = first.join(grown(f), ["match_id", "participant_id"]).where(F.col("_t") > F.col("_1")).groupBy("match_id", "participant_id").agg(F.min("_t").alias("_2"))
    boots = b.where("boots").groupBy("match_id", "participant_id").agg(F.min("timestamp").alias("_b"))
    minute = lambda c: F.round(F.col(c) / 60000, 2)
    return (f.join(grown(second), ["match_id", "participant_id"], "full").join(grown(boots), ["match_id", "participant_id"], "full")
            .select("match_id", "participant_id", minute("_1.timestamp").alias("first_item_min"), minute("_2.timestamp").alias("second_item_min"), minute("_b").alias("boots_min")))


def pushed(spark, path: str, kinds: Sequence[str]) -> DataFrame:
    """Read an exploded event table and let the scan skip other kinds: the layout to prefer over documents."""
    return spark.read.parquet(path).where(F.col("type").isin(*kinds))


def write_events(log: DataFrame, path: str) -> None:
    """Explode once, sorted by type, so row groups of other types are skipped by later reads."""
    log.sortWithinPartitions("type", "match_id").write.mode("overwrite").parquet(path)


def team_gold(minutes: DataFrame, players: DataFrame) -> DataFrame:
    """Each minute's gold of both teams and the difference."""
    t = minutes.join(grown(players.select("match_id", "participant_id", "team")), ["match_id", "participant_id"])
    side = lambda s: F.sum(F.when(F.col("team") == s, F.col("gold")).otherwise(0))
    return t.groupBy("match_id", "minute").agg(side(100).alias("blue"), side(200).alias("red")).withColumn("diff", F.col("blue") - F.col("red"))


