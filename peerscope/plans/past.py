"""A player's history on the star and event bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import history as H
from ..operators.ordered import numbered
from .registry import query
from .sequences import SESSIONS_SQL, session_games
from .star import EVENTS_SQL, GAMES_SQL, LINES_SQL, Star, with_sql


@query("champion_pool", with_sql(LINES_SQL) + """,
o AS (SELECT supplier, role, champion, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, CAST(sum(price % 10000) AS DOUBLE) AS s, CAST(sum((price % 10000) * (price % 10000)) AS DOUBLE) AS q,
  coalesce(stddev_samp(price % 10000) / sqrt(count(*)), 0) AS se FROM lines GROUP BY ALL),
t AS (SELECT *, CAST(sum(games) OVER w - games AS BIGINT) AS others, (sum(s) OVER w - s) / nullif(sum(games) OVER w - games, 0) AS mo, sum(q) OVER w - q AS qo FROM o WINDOW w AS (PARTITION BY supplier, role)),
v AS (SELECT *, s / games AS score, CASE WHEN games >= 5 AND others > 0 THEN s / games - mo END AS gap, CASE WHEN others > 1 THEN sqrt(greatest((qo - others * mo * mo) / (others - 1), 0.0) / others) ELSE 0.0 END AS se_o FROM t)
SELECT supplier, role, champion, games, wins, score, round(se, 5) AS se, others, round(gap, 5) AS gap, round(se_o, 5) AS se_others,
  CASE WHEN abs(gap) > 2 * sqrt(se * se + se_o * se_o) AND gap > 0 THEN 'stronger' WHEN abs(gap) > 2 * sqrt(se * se + se_o * se_o) THEN 'weaker' ELSE '' END AS verdict FROM v""")
def champion_pool(s: Star) -> DataFrame:
    rows = s.lines().withColumn("score", F.col("price") % 10000)
    out = H.champion_pool(rows, "supplier", "champion", "role", "win", "score")
    return out.select("supplier", "role", "champion", "games", "wins", "score", F.round("se", 5).alias("se"), "others",
                      F.round("gap", 5).alias("gap"), F.round("se_others", 5).alias("se_others"), "verdict")


@query("weekly_progress", with_sql(GAMES_SQL) + """
SELECT role, strftime(date_trunc('week', start_at), '%Y-%m-%d') AS week, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, avg(score) AS score FROM games GROUP BY ALL""")
def weekly_progress(s: Star) -> DataFrame:
    w = H.weekly(s.games(), ["role"], "start_at", "win", ["score"])
    return w.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("trend_fit", with_sql(GAMES_SQL) + """,
n AS (SELECT player, score, row_number() OVER (PARTITION BY player ORDER BY start_s, game_id) AS x FROM games),
f AS (SELECT player, count(*) AS games, regr_slope(score, x) AS b, regr_sxx(score, x) AS sxx, regr_syy(score, x) AS syy FROM n GROUP BY player),
e AS (SELECT player, games, CASE WHEN games >= 3 THEN b * 10 ELSE 0.0 END AS slope, CASE WHEN games >= 3 THEN sqrt(greatest(syy - b * b * sxx, 0.0) / (games - 2) / sxx) * 10 ELSE 0.0 END AS se FROM f)
SELECT player, games, round(slope, 5) AS slope, round(se, 4) AS se, CASE WHEN games >= 10 AND se > 0 AND abs(slope) > 2 * se THEN CASE WHEN slope > 0 THEN 'improving' ELSE 'declining' END ELSE 'steady' END AS verdict FROM e""")
def trend_fit(s: Star) -> DataFrame:
    t = H.trend(s.games(), ["player"], ["start_s", "game_id"], "score")
    return t.withColumn("slope", F.round("slope", 5)).withColumn("se", F.round("se", 4))


@query("recent_vs_older", with_sql(LINES_SQL) + """,
g AS (SELECT DISTINCT player, start_s, game_id FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY start_s DESC, game_id DESC) AS back FROM g),
l AS (SELECT l.player, m.metric, m.value, CASE WHEN back <= 4 THEN 'recent' ELSE 'older' END AS part FROM lines l JOIN r USING (player, start_s, game_id),
  LATERAL (SELECT 'quantity' AS metric, CAST(quantity AS DOUBLE) AS value UNION ALL SELECT 'price', CAST(price AS DOUBLE)) m),
q AS (SELECT player, metric, part, count(*) AS n, quantile_cont(value, 0.5) AS median FROM l GROUP BY ALL),
p AS (SELECT player, metric, max(n) FILTER (WHERE part = 'recent') AS recent_games, max(median) FILTER (WHERE part = 'recent') AS recent_median,
  coalesce(max(n) FILTER (WHERE part = 'older'), 0) AS older_games, max(median) FILTER (WHERE part = 'older' AND n >= 5) AS older_median FROM q GROUP BY ALL)
SELECT *, recent_median - older_median AS change FROM p WHERE recent_games >= 5""")
def recent_vs_older(s: Star) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("quantity", "price")])
    rows = s.lines().select("player", "start_s", "game_id", F.explode(pairs).alias("_x")).select("player", "start_s", "game_id", "_x.*")
    return H.recent_versus_older(rows, "player", "metric", ["start_s", "game_id"], "value", 4, 5)


@query("session_position", with_sql(SESSIONS_SQL) + """
SELECT 'position' AS grouping, CASE "index" WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE '4th+' END AS label, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, avg(cents) AS mean_score, round(stddev_samp(cents) / sqrt(count(*)), 6) AS se FROM sg GROUP BY ALL
UNION ALL SELECT 'streak', CASE WHEN losses_before = 0 THEN 'after a win' WHEN losses_before = 1 THEN 'after 1 loss' ELSE 'after 2+ losses' END, count(*), CAST(sum(win::INT) AS BIGINT), avg(cents), round(stddev_samp(cents) / sqrt(count(*)), 6) FROM sg WHERE "index" > 1 GROUP BY ALL""")
def session_position(s: Star) -> DataFrame:
    return H.session_groups(session_games(s), "win", "cents").withColumn("se", F.round("se", 6))


@query("paired_gap", with_sql(SESSIONS_SQL) + """,
p AS (SELECT user_id, session, avg(cents) FILTER (WHERE "index" >= 3) AS l, avg(cents) FILTER (WHERE "index" = 1) AS e FROM sg GROUP BY ALL),
d AS (SELECT user_id, l - e AS d FROM p WHERE l IS NOT NULL AND e IS NOT NULL),
g AS (SELECT user_id, count(*) AS sessions, avg(d) AS gap, coalesce(stddev_samp(d) / sqrt(count(*)), 0) AS se FROM d GROUP BY user_id HAVING count(*) >= 2)
SELECT user_id, sessions, round(gap, 5) AS gap, round(se, 5) AS se, sessions >= 10 AND abs(gap) > 2 * se AS clear FROM g""")
def paired_gap(s: Star) -> DataFrame:
    out = H.paired_gap(session_games(s), ["user_id", "session"], ["user_id"], F.col("index") == 1, F.col("index") >= 3, "cents")
    return out.withColumn("gap", F.round("gap", 5)).withColumn("se", F.round("se", 5))


_TILT = {"game1": '"index" = 1', "game2": '"index" = 2', "game3": '"index" = 3', "game4plus": '"index" >= 4',
         "after_two_losses": "losses_before >= 2", "after_win": '"index" > 1 AND losses_before = 0'}


@query("tilt", with_sql(SESSIONS_SQL) + "SELECT user_id, " + ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {n}_games, CAST(coalesce(sum(win::INT) FILTER (WHERE {c}), 0) AS BIGINT) AS {n}_wins" for n, c in _TILT.items()) + " FROM sg GROUP BY user_id")
def tilt(s: Star) -> DataFrame:
    return H.tilt(session_games(s), ["user_id"], "win")


@query("recurring_patterns", with_sql(LINES_SQL) + """,
n AS (SELECT player, game_id, CASE WHEN discount >= 9 THEN 'cheap' WHEN quantity >= 45 THEN 'bulk' WHEN tax = 0 THEN 'free' END AS note FROM lines)
SELECT player, note, count(DISTINCT game_id) AS games FROM n WHERE note IS NOT NULL GROUP BY ALL HAVING count(DISTINCT game_id) >= 3""")
def recurring_patterns(s: Star) -> DataFrame:
    note = F.when(F.col("discount") >= 9, "cheap").when(F.col("quantity") >= 45, "bulk").when(F.col("tax") == 0, "free")
    n = s.lines().select("player", "game_id", note.alias("note")).where("note IS NOT NULL")
    return n.groupBy("player", "note").agg(F.countDistinct("game_id").alias("games")).where("games >= 3")


@query("half_split_focus", with_sql(GAMES_SQL) + """,
h AS (SELECT player, score, row_number() OVER (PARTITION BY player ORDER BY start_s, game_id) AS rn, count(*) OVER (PARTITION BY player) AS n FROM games)
SELECT player, any_value(n) AS games, avg(score) FILTER (WHERE rn * 2 <= n) AS earlier, avg(score) FILTER (WHERE rn * 2 > n) AS later FROM h GROUP BY player""")
def half_split_focus(s: Star) -> DataFrame:
    from ..operators.scale import beside
    g = numbered(s.games(), ["player"], ["start_s", "game_id"], "rn")
    g = beside(g, ["player"], {"n": F.count(F.lit(1))})
    early = F.col("rn") * 2 <= F.col("n")
    return g.groupBy("player").agg(F.first("n").alias("games"), F.avg(F.when(early, F.col("score"))).alias("earlier"),
                                   F.avg(F.when(~early, F.col("score"))).alias("later"))


ZONE_CASE = """CASE WHEN u < 0.26 AND v < 0.26 THEN 'own_base' WHEN u > 0.74 AND v > 0.74 THEN 'enemy_base' WHEN u < 0.15 OR v > 0.85 THEN 'top_lane' WHEN v < 0.15 OR u > 0.85 THEN 'bot_lane'
  WHEN abs(u - v) < 0.07 THEN 'mid_lane' WHEN abs(u + v - 1) < 0.07 THEN 'river' WHEN u + v < 1 THEN 'own_jungle' ELSE 'enemy_jungle' END"""


@query("death_map", with_sql(LINES_SQL) + """,
p AS (SELECT player, game_id, CASE team WHEN 'F' THEN 100 ELSE 200 END AS side, (item * 7) % 14870 AS x, (price * 3) % 14980 AS y FROM lines),
f AS (SELECT *, CASE WHEN side = 200 THEN 1 - y / 14980.0 ELSE x / 14870.0 END AS u, CASE WHEN side = 200 THEN 1 - x / 14870.0 ELSE y / 14980.0 END AS v FROM p)
""" + f"SELECT player, {ZONE_CASE} AS zone, count(*) AS deaths FROM f GROUP BY ALL")
def death_map(s: Star) -> DataFrame:
    side = F.when(F.col("team") == "F", 100).otherwise(200)
    p = s.lines().select("player", side.alias("side"), (F.col("item") * 7 % 14870).alias("x"), (F.col("price") * 3 % 14980).alias("y"))
    return p.groupBy("player", E.own_zone("x", "y", "side").alias("zone")).agg(F.count(F.lit(1)).alias("deaths"))


_SEG = "sqrt(pow(x - {ax} - t{i} * {dx}, 2) + pow(y - {ay} - t{i} * {dy}, 2))"


def lane_ctes() -> str:
    """From a table p with x and y: m, with the distance to each lane's centre line."""
    segs, i = [], 0
    names: dict[str, list[int]] = {}
    for lane, path in E.LANES.items():
        for a, b in zip(path, path[1:]):
            names.setdefault(lane, []).append(i)
            dx, dy = b[0] - a[0], b[1] - a[1]
            segs.append((f"greatest(0.0, least(1.0, ((x - {a[0]}) * {dx} + (y - {a[1]}) * {dy}) / {dx * dx + dy * dy})) AS t{i}",
                         _SEG.format(ax=a[0], ay=a[1], dx=dx, dy=dy, i=i) + f" AS d{i}"))
            i += 1
    best = {lane: "least(" + ", ".join(f"d{j}" for j in js) + ")" for lane, js in names.items()}
    return f"""
t AS (SELECT *, {", ".join(a for a, _ in segs)} FROM p), d AS (SELECT *, {", ".join(b for _, b in segs)} FROM t),
m AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in best.items())} FROM d)"""


LANE_CASE = """CASE WHEN (x / 14870.0 < 0.26 AND y / 14980.0 < 0.26) OR (x / 14870.0 > 0.74 AND y / 14980.0 > 0.74) THEN NULL
  WHEN least(top, mid, bot) > 1000 THEN NULL WHEN bot <= top AND bot <= mid THEN 'bot' WHEN mid <= top AND mid <= bot THEN 'mid' ELSE 'top' END"""


@query("lane_membership", with_sql(LINES_SQL) + f""",
p AS (SELECT game_id, slot, CAST((item * 7) % 14870 AS DOUBLE) AS x, CAST((price * 3) % 14980 AS DOUBLE) AS y FROM lines), {lane_ctes()},
l AS (SELECT {LANE_CASE} AS lane FROM m)
SELECT coalesce(lane, 'none') AS lane, count(*) AS n FROM l GROUP BY ALL""")
def lane_membership(s: Star) -> DataFrame:
    p = s.lines().select((F.col("item") * 7 % 14870).alias("x"), (F.col("price") * 3 % 14980).alias("y"))
    return p.groupBy(F.coalesce(E.lane_at("x", "y"), F.lit("none")).alias("lane")).agg(F.count(F.lit(1)).alias("n"))


@query("ladder_scores", with_sql(GAMES_SQL) + """,
r AS (SELECT game_id, total % 2800 AS score FROM games)
SELECT game_id, score, CASE WHEN score >= 2800 THEN 'Master+ ' || (score - 2800) || ' LP' ELSE ['Iron','Bronze','Silver','Gold','Platinum','Emerald','Diamond'][score // 400 + 1] || ' ' || ['IV','III','II','I'][(score % 400) // 100 + 1] || ' ' || (score % 100) || ' LP' END AS label, score AS back FROM r""")
def ladder_scores(s: Star) -> DataFrame:
    r = s.games().select("game_id", (F.col("total") % 2800).alias("score")).withColumn("label", E.ladder_label("score"))
    parts = F.split("label", " ")
    return r.withColumn("back", E.ladder_score(F.upper(parts[0]), parts[1], parts[2].cast("int")).cast("long"))


@query("respawn_times", with_sql(GAMES_SQL) + """,
g AS (SELECT game_id, game_id % 18 + 1 AS level, duration_s / 60.0 + game_id % 30 AS m FROM games)
SELECT game_id, round([6, 6, 8, 8, 10, 12, 16, 21, 26, 32.5, 35, 37.5, 40, 42.5, 45, 47.5, 50, 52.5][level] * (1 + CASE WHEN m < 15 THEN 0.0 WHEN m < 30 THEN 0.0085 * (m - 15) WHEN m < 45 THEN 0.1275 + 0.006 * (m - 30) ELSE least(0.5, 0.2175 + 0.029 * (m - 45)) END), 9) AS seconds FROM g""")
def respawn_times(s: Star) -> DataFrame:
    g = s.games().select("game_id", (F.col("game_id") % 18 + 1).alias("level"), (F.col("duration_s") / 60.0 + F.col("game_id") % 30).alias("m"))
    return g.select("game_id", F.round(E.respawn_seconds("level", "m"), 9).alias("seconds"))


@query("skill_orders", with_sql(LINES_SQL) + """,
o AS (SELECT game_id, string_agg(substr('QWE', CAST(item % 3 AS INT) + 1, 1), '' ORDER BY slot, item) AS letters FROM lines GROUP BY game_id),
c AS (SELECT game_id, letters, k, pos, row_number() OVER (PARTITION BY game_id, k ORDER BY pos) AS nth FROM (SELECT game_id, letters, unnest(string_split(letters, '')) AS k, generate_subscripts(string_split(letters, ''), 1) AS pos FROM o)),
f AS (SELECT game_id, arg_min(k, pos) AS first_max FROM c WHERE nth = 3 GROUP BY game_id)
SELECT game_id, letters, first_max FROM o LEFT JOIN f USING (game_id)""")
def skill_orders(s: Star) -> DataFrame:
    letter = F.substring(F.lit("QWE"), (F.col("item") % 3 + 1).cast("int"), F.lit(1))
    o = s.lines().groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("slot", "item", letter.alias("k")))).alias("_o"))
    o = o.select("game_id", F.array_join(F.transform("_o", lambda x: x["k"]), "").alias("letters"))
    return o.withColumn("first_max", E.first_maxed("letters", 3))


@query("objective_timers", with_sql(EVENTS_SQL) + """,
t AS (SELECT event_id, user_id, s, max(s) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 3600.0 AS taken, s / 3600.0 AS now FROM ev)
SELECT event_id, round(greatest(-5.0, least(10.0, coalesce(taken + 24, 473500.0) - now)), 6) AS up_in, coalesce(taken + 24, 473500.0) <= now AS up FROM t""")
def objective_timers(s: Star) -> DataFrame:
    from ..operators.ordered import running
    e = running(s.events(), ["user_id"], ["us", "event_id"], {"_last": ("max", F.when(F.col("event_type") == "purchase", F.col("s")))})
    spawn = E.next_spawn(F.col("_last") / 3600.0, 473500.0, 24.0)
    now = F.col("s") / 3600.0
    return e.select("event_id", F.round(E.minutes_until(spawn, now, -5.0, 10.0), 6).alias("up_in"), (spawn <= now).alias("up"))


@query("log_odds", with_sql(LINES_SQL) + """,
r AS (SELECT champion, (sum(win::INT) + 20.0) / (count(*) + 40) AS p FROM lines GROUP BY champion)
SELECT champion, round(ln(greatest(0.0001, least(0.9999, p)) / (1 - greatest(0.0001, least(0.9999, p)))), 6) AS log_odds, round(100 * (1 / (1 + exp(-ln(p / (1 - p)))) - 0.5), 6) AS points FROM r""")
def log_odds(s: Star) -> DataFrame:
    r = s.lines().groupBy("champion").agg(E.shrunk_rate(F.sum(F.col("win").cast("int")), F.count(F.lit(1))).alias("p"))
    return r.select("champion", F.round(E.logit("p"), 6).alias("log_odds"), F.round(E.points(E.logit("p")), 6).alias("points"))


@query("normalised_names", "SELECT p_partkey, lower(regexp_replace(p_name || ' & ' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS name FROM part")
def normalised_names(s: Star) -> DataFrame:
    return s.table("part").select("p_partkey", E.plain_name(F.concat("p_name", F.lit(" & "), "p_brand")).alias("name"))
