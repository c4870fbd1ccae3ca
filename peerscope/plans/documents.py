"""Match and timeline documents built from the star tables, parsed back into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import written_numbers
from ..operators.scale import written
from ..sources import dimensions as D
from ..sources import matches as M
from .registry import query
from .star import BUILDS_SQL, LINES_SQL, SEATS_SQL, Star, with_sql


def _pid():
    return (F.col("slot") + F.when(F.col("team") == "F", 0).otherwise(7)).cast("int")


def _side():
    return F.when(F.col("team") == "F", 100).otherwise(200)


def _perks():
    """Rune pages as documents have them: some without a second style, a shard or any rune at all."""
    i = F.col("item").cast("int")
    style = lambda style, *perks: F.struct(style.cast("int").alias("style"), F.array(*[F.struct(p.cast("int").alias("perk")) for p in perks]).alias("selections"))
    main, second = style(8000 + i % 3 * 100, 8000 + i % 4, 8100 + F.col("kills") % 3), style(8400 + i % 2 * 100, 8300 + F.col("slot") % 2)
    shards = F.struct((5000 + i % 2).alias("offense"), F.when(i % 5 != 1, F.lit(5007)).alias("flex"), F.lit(5002).alias("defense"))
    return F.when(i % 11 != 0, F.struct(shards.alias("statPerks"), F.when(i % 7 == 3, F.array(main)).otherwise(F.array(main, second)).alias("styles")))


def match_texts(s: Star) -> DataFrame:
    """One JSON document per order: seats are participants, returned lines bans, classes objectives."""
    # Seats, bans and objectives read the lines joined once.
    lines = written(s.lines().drop("player", "status", "game_score", "ship_s"), "lines")
    seat = s.seats(lines)
    people = seat.select("game_id", F.struct(
        _pid().alias("participantId"), F.col("supplier").cast("string").alias("puuid"), _side().alias("teamId"), F.concat(F.lit("R"), "slot").alias("teamPosition"),
        F.substring("champion", 7, 3).cast("int").alias("championId"), "win", F.col("kills").cast("int").alias("kills"), F.col("deaths").cast("int").alias("deaths"),
        F.col("assists").cast("int").alias("assists"), F.col("gold").cast("int").alias("totalMinionsKilled"), F.col("damage").cast("int").alias("totalDamageDealtToChampions"),
        (F.col("gold") * 100).cast("int").alias("goldEarned"), F.col("item").cast("int").alias("item0"), (F.col("item") % 50).cast("int").alias("visionScore"),
        F.lit(4).alias("summoner1Id"), (F.col("item") % 5 + 1).cast("int").alias("summoner2Id"), _perks().alias("perks")).alias("_p"))
    p = people.groupBy("game_id").agg(F.collect_list("_p").alias("participants"))
    bans = lines.where("flag = 'R'").groupBy("game_id", _side().alias("teamId")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("slot").cast("int").alias("pickTurn"), F.substring("champion", 7, 3).cast("int").alias("championId")))).alias("bans"))
    obj = lines.groupBy("game_id", _side().alias("teamId"), "class").agg(F.count(F.lit(1)).cast("int").alias("kills"), F.bool_or("win").alias("win"))
    teams = obj.groupBy("game_id", "teamId").agg(F.bool_or("win").alias("win"), F.map_from_entries(F.collect_list(F.struct("class", F.struct((F.col("kills") >= 2).alias("first"), "kills")))).alias("objectives"))
    t = teams.join(bans, ["game_id", "teamId"], "left").groupBy("game_id").agg(F.collect_list(F.struct("teamId", "win", "bans", "objectives")).alias("teams"))
    g = s.games().join(p, "game_id").join(t, "game_id")
    end = F.when(F.col("game_id") % 2 == 0, (F.col("start_s") + F.col("duration_s")) * 1000)
    info = F.struct((F.col("start_s") * 1000).alias("gameStartTimestamp"), end.alias("gameEndTimestamp"),
                    F.when(F.col("game_id") % 2 == 0, F.col("duration_s")).otherwise(F.col("duration_s") * 1000).alias("gameDuration"),
                    F.concat((F.col("patch") - 1980).cast("string"), F.lit(".1.2")).alias("gameVersion"), F.lit(420).alias("queueId"), "participants", "teams")
    text = F.to_json(F.struct(F.struct(F.concat(F.lit("M_"), F.col("game_id").cast("string")).alias("matchId")).alias("metadata"), info.alias("info")))
    # Every fiftieth document is cut short, as a malformed download would be.
    return g.select("game_id", F.when(F.col("game_id") % 50 == 7, F.substring(text, 1, 200)).otherwise(text).alias("text"))


def matches(s: Star) -> DataFrame:
    return M.parsed(match_texts(s), "text", M.MATCH_SCHEMA, "game_id")[0]


GOOD = "game_id % 50 <> 7"


@query("match_participants", with_sql(BUILDS_SQL) + """
SELECT 'M_' || match_id AS match_id, role + CASE team WHEN 'F' THEN 0 ELSE 7 END AS participant_id, CAST(player AS VARCHAR) AS player, CASE team WHEN 'F' THEN 100 ELSE 200 END AS team, 'R' || role AS role,
  CAST(substr(champion, 7) AS INT) AS champion, win, kills, deaths, assists, cs, damage, team_kills, CAST(substr(opponent, 7) AS INT) AS opponent, duration_s, (patch - 1980) || '.1' AS patch FROM builds WHERE match_id % 50 <> 7""")
def match_participants(s: Star) -> DataFrame:
    p = M.participants(matches(s))
    return p.select("match_id", "participant_id", "player", "team", "role", "champion", "win", "kills", "deaths", "assists", "cs", "damage", "team_kills", "opponent", "duration_s", "patch")


@query("core_participants", with_sql(SEATS_SQL) + f"""
SELECT 'M_' || game_id AS match_id, CAST(supplier AS VARCHAR) AS player, win, kills, deaths, assists FROM seats WHERE {GOOD}""")
def core_participants(s: Star) -> DataFrame:
    return M.core_participants(matches(s)).select("match_id", "player", "win", "kills", "deaths", "assists")


@query("match_bans", with_sql(LINES_SQL) + f"""
SELECT 'M_' || game_id AS match_id, CASE team WHEN 'F' THEN 100 ELSE 200 END AS team, slot AS turn, CAST(substr(champion, 7) AS INT) AS champion FROM lines WHERE flag = 'R' AND {GOOD}""")
def match_bans(s: Star) -> DataFrame:
    return M.bans(matches(s))


@query("match_objectives", with_sql(LINES_SQL) + f"""
SELECT 'M_' || game_id AS match_id, CASE team WHEN 'F' THEN 100 ELSE 200 END AS team, class AS objective, count(*) >= 2 AS first, count(*) AS kills FROM lines WHERE {GOOD} GROUP BY ALL""")
def match_objectives(s: Star) -> DataFrame:
    return M.objectives(matches(s)).select("match_id", "team", "objective", "first", "kills")


@query("rejected_documents", "SELECT DISTINCT l_orderkey AS game_id, 'malformed' AS reason FROM lineitem WHERE l_orderkey % 50 = 7")
def rejected_documents(s: Star) -> DataFrame:
    return M.parsed(match_texts(s), "text", M.MATCH_SCHEMA, "game_id")[1]


def timeline_texts(s: Star) -> DataFrame:
    """One timeline per order: eight frames with uneven offsets; lines are purchases, undos, kills, wards and skills."""
    c = F.col
    l = s.lines().groupBy("game_id", "slot", "team").agg(
        F.sum("quantity").alias("gold"), F.sum("discount").alias("kills"), F.max("item").alias("last"),
        F.collect_list(F.struct("slot", "item", "supplier", "price", "quantity", "flag", "tax", _pid().alias("pid"))).alias("_l"))
    # A game's lines travel once, as one array: they are numbered and made events inside the row.
    g = l.groupBy("game_id").agg(F.collect_list(F.struct(_pid().alias("pid"), "gold", "kills", c("last").alias("item"))).alias("_p"), F.flatten(F.collect_list("_l")).alias("_l"))
    ev = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    spot = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none_i = F.lit(None).cast("int")
    events = lambda c, t, undo: F.array(
        ev(type=F.when(undo, "ITEM_UNDO").otherwise("ITEM_PURCHASED"), timestamp=t, participantId=F.lit(1), itemId=F.when(~undo, (c("item") % 6 + 1).cast("int")), beforeId=F.when(undo, (c("item") % 6 + 1).cast("int")),
           killerId=none_i, victimId=none_i, assistingParticipantIds=F.lit(None).cast("array<int>"), creatorId=none_i, wardType=F.lit(None).cast("string"), skillSlot=none_i, levelUpType=F.lit(None).cast("string"), position=spot(none_i, none_i)),
        ev(type=F.when(c("flag") == "R", "CHAMPION_KILL").otherwise("WARD_PLACED"), timestamp=t + 100, participantId=none_i, itemId=none_i, beforeId=none_i, killerId=F.when(c("flag") == "R", (c("item") % 14 + 1).cast("int")),
           victimId=F.when(c("flag") == "R", c("pid")), assistingParticipantIds=F.when((c("flag") == "R") & (c("quantity") > 25), F.array((c("item") % 7 + 1).cast("int"))), creatorId=F.when(c("flag") != "R", c("pid")),
           wardType=F.when(c("flag") != "R", F.when(c("tax") >= 4, "SIGHT_WARD").otherwise("UNDEFINED")), skillSlot=none_i, levelUpType=F.lit(None).cast("string"),
           position=spot((c("item") * 7 % 14870).cast("int"), (c("price") * 3 % 14980).cast("int"))),
        ev(type=F.lit("SKILL_LEVEL_UP"), timestamp=t + 200, participantId=F.lit(1), itemId=none_i, beforeId=none_i, killerId=none_i, victimId=none_i, assistingParticipantIds=F.lit(None).cast("array<int>"), creatorId=none_i,
           wardType=F.lit(None).cast("string"), skillSlot=(c("item") % 4 + 1).cast("int"), levelUpType=F.lit("NORMAL"), position=spot(none_i, none_i)))
    # Lines in order of slot and number are events in order of time.
    made = F.flatten(F.transform(F.array_sort("_l"), lambda x, i: events(
        lambda n: x[n], ((x["slot"] - 1) * 60000 + (i + 1) * 700).cast("bigint"), (x["flag"] == "A") & (x["quantity"] < 25))))
    # A generator's output is a value of its own: the events are not made anew for every frame.
    d = g.select("game_id", "_p", F.explode(F.array(made)).alias("_e"))
    offset = lambda m: F.when(m == 0, F.lit(0)).otherwise((c("game_id") * 37 + m * 2311) % 8000)

    def frame(m):
        at = m.cast("bigint") * 60000 + offset(m)
        pf = F.map_from_entries(F.transform("_p", lambda p: F.struct(p["pid"].cast("string").alias("k"), F.struct(
            (500 + p["gold"] * 10 * m).cast("int").alias("totalGold"), (p["kills"] * m).cast("int").alias("xp"), (p["gold"] * m).cast("int").alias("minionsKilled"), (m + 1).cast("int").alias("level")).alias("v"))))
        mine = F.filter("_e", lambda e: F.floor(e["timestamp"] / 60000) == m)
        return F.struct(at.alias("timestamp"), pf.alias("participantFrames"), mine.alias("events"))

    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), frame)
    return d.select("game_id", F.to_json(F.struct(F.struct(F.concat(F.lit("M_"), c("game_id").cast("string")).alias("matchId")).alias("metadata"), F.struct(F.lit(60000).alias("frameInterval"), frames.alias("frames")).alias("info"))).alias("text"))


def timelines(s: Star) -> DataFrame:
    return M.parsed(timeline_texts(s), "text", M.TIMELINE_SCHEMA, "game_id")[0]


FRAMES_SQL = SEATS_SQL + """,
off AS (SELECT game_id, m, CASE WHEN m = 0 THEN 0 ELSE (game_id * 37 + m * 2311) % 8000 END AS o FROM (SELECT DISTINCT game_id FROM lines), generate_series(0, 7) x(m)),
ok AS (SELECT game_id, m, max(CASE WHEN o <= 5000 THEN m END) OVER (PARTITION BY game_id ORDER BY m) AS src, max(CASE WHEN o <= 5000 THEN m END) OVER (PARTITION BY game_id) AS last FROM off),
fr AS (SELECT s.game_id, slot + CASE team WHEN 'F' THEN 0 ELSE 7 END AS pid, k.m, k.src, k.src * 60000 + f.o AS ms, 500 + gold * 10 * src AS gold, kills * src AS xp, gold * src AS cs FROM seats s JOIN ok k ON k.game_id = s.game_id AND k.m <= k.last JOIN off f ON f.game_id = s.game_id AND f.m = k.src)"""


@query("minute_frames", with_sql(FRAMES_SQL) + "SELECT 'M_' || game_id AS match_id, pid AS participant_id, m AS minute, gold, xp, cs FROM fr")
def minute_frames(s: Star) -> DataFrame:
    return M.minute_frames(timelines(s)).select("match_id", "participant_id", "minute", "gold", "xp", "cs")


LOG_SQL = LINES_SQL + """,
nl AS (SELECT *, slot + CASE team WHEN 'F' THEN 0 ELSE 7 END AS pid, row_number() OVER (PARTITION BY game_id ORDER BY slot, item, supplier, price, quantity) AS rn FROM lines),
lt AS (SELECT *, (slot - 1) * 60000 + rn * 700 AS t FROM nl)"""


@query("event_log", with_sql(LOG_SQL) + """
SELECT 'M_' || game_id AS match_id, t + 100 AS timestamp, item % 14 + 1 AS killer, pid AS victim, CASE WHEN quantity > 25 THEN 1 ELSE 0 END AS assists FROM lt WHERE flag = 'R'""")
def event_log(s: Star) -> DataFrame:
    e = M.events(timelines(s), ["CHAMPION_KILL"])
    return e.select("match_id", "timestamp", F.col("killerId").alias("killer"), F.col("victimId").alias("victim"), F.size(F.coalesce("assistingParticipantIds", F.array().cast("array<int>"))).alias("assists"))


@query("standing_purchases", with_sql(LOG_SQL) + """,
w AS (SELECT game_id, item % 6 + 1 AS it, t, NOT (flag = 'A' AND quantity < 25) AS buy, sum(CASE WHEN flag = 'A' AND quantity < 25 THEN -1 ELSE 1 END) OVER (PARTITION BY game_id, item % 6 ORDER BY t) AS s FROM lt),
l AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY game_id, it ORDER BY t)) AS lv FROM w),
a AS (SELECT *, min(lv) OVER (PARTITION BY game_id, it ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft FROM l)
SELECT 'M_' || game_id AS match_id, it AS item, CAST(t // 1000 AS INT) AS second FROM a WHERE buy AND aft >= lv""")
def standing_purchases(s: Star) -> DataFrame:
    return M.purchases(M.events(timelines(s), ["ITEM_PURCHASED", "ITEM_UNDO"])).select("match_id", "item", "second")


@query("skill_strings", with_sql(LOG_SQL) + """
SELECT 'M_' || game_id AS match_id, string_agg(substr('QWER', CAST(item % 4 AS INT) + 1, 1), '' ORDER BY t) AS skill_order FROM lt GROUP BY game_id""")
def skill_strings(s: Star) -> DataFrame:
    return M.skill_orders(M.events(timelines(s), ["SKILL_LEVEL_UP"])).select("match_id", "skill_order")


@query("minute_counters", with_sql(FRAMES_SQL, """
nl AS (SELECT *, slot + CASE team WHEN 'F' THEN 0 ELSE 7 END AS pid, row_number() OVER (PARTITION BY game_id ORDER BY slot, item, supplier, price, quantity) AS rn FROM lines),
lt AS (SELECT *, (slot - 1) * 60000 + rn * 700 AS t FROM nl)""") + """
SELECT 'M_' || f.game_id AS match_id, f.pid AS participant_id, f.m AS minute, count(*) FILTER (WHERE l.flag = 'R' AND l.pid = f.pid AND l.t + 100 <= f.ms) AS deaths,
  count(*) FILTER (WHERE l.flag = 'R' AND l.item % 14 + 1 = f.pid AND l.t + 100 <= f.ms) AS kills, count(*) FILTER (WHERE l.flag <> 'R' AND l.tax >= 4 AND l.pid = f.pid AND l.t + 100 <= f.ms) AS wards_placed
FROM fr f LEFT JOIN lt l ON l.game_id = f.game_id GROUP BY ALL""")
def minute_counters(s: Star) -> DataFrame:
    t = written(timelines(s), "timelines")
    m = M.with_counters(M.minute_frames(t), M.events(t, ["CHAMPION_KILL", "WARD_PLACED", "WARD_KILL"]))
    return m.select("match_id", "participant_id", "minute", "deaths", "kills", "wards_placed")


@query("match_metrics")
def match_metrics(s: Star) -> DataFrame:
    """Every participant's metrics, from both documents."""
    p = written(M.participants(matches(s)), "participants")
    t = written(timelines(s), "timelines")
    log = M.events(t)
    minutes = written(M.with_differences(M.minute_frames(t), p).select("match_id", "participant_id", "minute", *[c + d for c in ("cs", "gold", "xp") for d in ("", "_diff")]), "minutes")
    items = s.spark.range(1, 7).select(F.col("id").cast("int").alias("item"), (F.col("id") % 2 == 0).alias("finished"), (F.col("id") == 5).alias("boots"))
    timings = M.build_timings(M.purchases(log), items)
    out = M.game_metrics(p, minutes, M.deaths(log, minutes, p), log, timings)
    return out.select("match_id", "participant_id", "role", F.size("metrics").alias("metrics"), *[F.col("metrics")[k].alias(k) for k in ("kda", "damage_share", "kill_participation", "early_deaths", "first_death_min", "first_item_min")])


@query("death_details", with_sql(LOG_SQL) + """,
d AS (SELECT game_id, pid, t + 100 AS ts, item * 7 % 14870 AS x, price * 3 % 14980 AS y, CASE WHEN quantity > 25 THEN 1 ELSE 0 END AS assisters FROM lt WHERE flag = 'R' AND game_id % 50 <> 7),
z AS (SELECT *, x / 14870.0 AS u, y / 14980.0 AS v FROM d)
SELECT 'M_' || game_id AS match_id, pid AS participant_id, ts AS timestamp, assisters, CASE WHEN u < 0.26 AND v < 0.26 THEN 'blue_base' WHEN u > 0.74 AND v > 0.74 THEN 'red_base' WHEN u < 0.15 OR v > 0.85 THEN 'top_lane'
  WHEN v < 0.15 OR u > 0.85 THEN 'bot_lane' WHEN abs(u - v) < 0.07 THEN 'mid_lane' WHEN abs(u + v - 1) < 0.07 THEN 'river' WHEN u + v < 1 THEN 'blue_jungle' ELSE 'red_jungle' END AS zone FROM z""")
def death_details(s: Star) -> DataFrame:
    # Only what deaths read is written.
    p, t = written(M.participants(matches(s)).select("match_id", "participant_id", "team", "opponent_id"), "participants"), written(timelines(s), "timelines")
    minutes = written(M.with_differences(M.minute_frames(t), p).select("match_id", "participant_id", "minute", "gold_diff"), "minutes")
    return M.deaths(M.events(t, ["CHAMPION_KILL"]), minutes, p).select("match_id", "participant_id", "timestamp", "assisters", "zone")


@query("team_gold_series", with_sql(FRAMES_SQL) + """
SELECT 'M_' || game_id AS match_id, m AS minute, CAST(coalesce(sum(gold) FILTER (WHERE pid <= 7), 0) AS BIGINT) AS blue, CAST(coalesce(sum(gold) FILTER (WHERE pid > 7), 0) AS BIGINT) AS red FROM fr WHERE game_id % 50 <> 7 GROUP BY ALL""")
def team_gold_series(s: Star) -> DataFrame:
    return M.team_gold(M.minute_frames(timelines(s)), M.participants(matches(s))).select("match_id", "minute", "blue", "red")


ITEMS_SQL = """
it AS (SELECT CAST(p_partkey AS INT) AS item, list_filter([CASE WHEN p_size % 2 = 0 THEN 'Armor' END, CASE WHEN p_size % 3 = 0 THEN 'Damage' END, CASE WHEN p_size % 5 = 0 THEN 'LifeSteal' END, CASE WHEN p_size % 11 = 0 THEN 'Boots' END], lambda x: x IS NOT NULL) AS tags,
  p_size % 4 = 0 AS into_, CAST(p_retailprice * 2 AS INT) AS total, p_name FROM part)"""


def item_catalogue(s: Star) -> DataFrame:
    size = F.col("p_size")
    tag = lambda k, n: F.when(size % k == 0, n)
    return s.table("part").select(
        F.col("p_partkey").cast("int").alias("item"), F.col("p_name").alias("name"), F.when(F.col("p_name").contains("hot"), "Wounds the target").otherwise("").alias("description"),
        F.filter(F.array(tag(2, "Armor"), tag(3, "Damage"), tag(5, "LifeSteal"), tag(11, "Boots")), lambda x: x.isNotNull()).alias("tags"),
        F.when(size % 4 == 0, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>")).alias("into"), (F.col("p_retailprice") * 2).cast("int").alias("total"),
        F.lit(True).alias("purchasable"), F.lit(True).alias("on_map"))


@query("item_rules", with_sql(ITEMS_SQL) + """
SELECT item, list_contains(tags, 'Boots') AND total >= 900 AS boots, NOT list_contains(tags, 'Boots') AND NOT into_ AND total >= 2200 AS finished FROM it""")
def item_rules(s: Star) -> DataFrame:
    return D.item_rules(item_catalogue(s))


@query("item_flags", with_sql(ITEMS_SQL) + """
SELECT item, unnest(list_filter(['items', CASE WHEN list_contains(tags, 'Armor') THEN 'armor' END, CASE WHEN list_contains(tags, 'Damage') THEN 'ad' END, CASE WHEN list_contains(tags, 'LifeSteal') THEN 'sustain' END,
  CASE WHEN p_name LIKE '%hot%' THEN 'anti_heal' END], lambda x: x IS NOT NULL)) AS flag FROM it""")
def item_flags(s: Star) -> DataFrame:
    return D.item_flags(item_catalogue(s))


@query("patch_note_changes", """
SELECT CAST(p_size AS VARCHAR) || '.1' AS patch, CAST(substr(p_brand, 7) AS INT) AS champion, CASE p_partkey % 2 WHEN 0 THEN 'buff' ELSE 'nerf' END AS kind FROM part""")
def patch_note_changes(s: Star) -> DataFrame:
    """Notes documents made of the part table, one per size, parsed to change rows."""
    p = s.table("part")
    change = F.struct(F.upper("p_brand").alias("champion"), F.when(F.col("p_partkey") % 2 == 0, "buff").otherwise("nerf").alias("kind"), F.col("p_name").alias("text"))
    doc = p.groupBy("p_size").agg(F.collect_list(change).alias("changes"))
    text = doc.select(F.to_json(F.struct(F.array(F.struct(F.concat(F.col("p_size").cast("string"), F.lit(".1")).alias("patch"), F.lit("live").alias("status"), "changes")).alias("patches"))).alias("t"))
    notes = text.select(F.from_json("t", D.NOTES_SCHEMA.replace("\n", " ")).alias("n")).select("n.patches")
    champions = p.select(F.substring("p_brand", 7, 3).cast("int").alias("champion"), F.col("p_brand").alias("name")).distinct()
    return D.champion_changes(notes, champions).select("patch", "champion", "kind")


@query("lobby_ids", "SELECT c_custkey, 1 AS place, replace(c_name, 'Customer#', 'Cu ') AS name, 'NA1' AS tag FROM customer")
def lobby_ids(s: Star) -> DataFrame:
    """Chat lines made of customer names: the second line repeats the first one's id in other letters."""
    who = F.replace(F.col("c_name"), F.lit("Customer#"), F.lit("Cu "))
    text = F.concat(who, F.lit(" #NA1 joined the lobby\n"), F.upper(who), F.lit("#na1, nobody here"))
    return D.player_ids(s.table("customer").select("c_custkey", text.alias("t")), "c_custkey", "t")


@query("file_titles", """
SELECT p_partkey, 'Brand' || substr(p_brand, 7) AS champion, 'Foe' || p_size AS opponent, CASE WHEN p_partkey % 2 = 0 THEN 'TOP' ELSE 'BOTTOM' END AS role, CASE WHEN p_partkey % 2 = 0 THEN 'NA' ELSE 'KR' END AS region,
  CASE WHEN p_partkey % 2 = 0 THEN 'GOLD' ELSE 'MASTER' END AS tier, '26.' || p_size AS patch FROM part""")
def file_titles(s: Star) -> DataFrame:
    n, size = F.substring("p_brand", 7, 3), F.col("p_size").cast("string")
    last = F.concat(F.lit("/v/brand"), n, F.lit(" vs FOE"), size, F.lit(" (TOP) NA Gold 26."), size, F.lit("_720p.mp4"))
    first = F.concat(F.lit("/v/(X Y) brand"), n, F.lit(" ADC vs foe"), size, F.lit(" (P Q) - KR Master Patch 26."), size, F.lit(".mkv"))
    p = s.table("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, last).otherwise(first).alias("path"))
    return p.select("p_partkey", *[c.alias(k) for k, c in D.title_columns(F.col("path")).items() if k != "title"])


@query("written_numbers", """
WITH d AS (SELECT doc_id, regexp_replace(text, '(?i)\\bE\\d+\\b|\\b\\d+v\\d+\\b', ' ', 'g') AS t FROM documents),
n AS (SELECT doc_id, unnest(regexp_extract_all(' ' || t, '(?:^|[^\\w.])(\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)', 1)) AS raw FROM d)
SELECT doc_id, count(*) AS numbers FROM n GROUP BY doc_id""")
def number_counts(s: Star) -> DataFrame:
    d = s.table("documents").select("doc_id", F.explode(written_numbers("text")).alias("n"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers"))
