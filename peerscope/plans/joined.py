"""Join operators on the star and event bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import query
from .star import EVENTS_SQL, GAMES_SQL, LINES_SQL, SEATS_SQL, Star, with_sql

OPP_SQL = SEATS_SQL + """,
cells AS (SELECT game_id, slot, team, count(*) AS n, min(champion) AS opponent, min(gold) AS opp_gold, min(damage) AS opp_damage
  FROM seats GROUP BY game_id, slot, team),
facing AS (SELECT s.*, c.opponent, c.opp_gold, c.opp_damage FROM seats s JOIN cells c
  ON c.game_id = s.game_id AND c.slot = s.slot AND c.team <> s.team AND c.n = 1)"""


@query("opponent_pair", with_sql(LINES_SQL) + """,
cells AS (SELECT game_id, slot, team, count(*) AS n, min(champion) AS opponent, min(price) AS opp_price FROM lines GROUP BY ALL)
SELECT l.game_id, l.slot, l.team, l.champion, l.price, c.opponent, c.opp_price FROM lines l JOIN cells c
  ON c.game_id = l.game_id AND c.slot = l.slot AND c.team <> l.team AND c.n = 1""")
def opponent_pair(s: Star) -> DataFrame:
    rows = s.lines().select("game_id", "slot", "team", "champion", "price")
    return J.opponents(rows, "game_id", "slot", "team", {"opponent": "champion", "opp_price": "price"})


@query("opponent_difference", with_sql(OPP_SQL) + """
SELECT s.game_id, s.slot, s.team, s.gold, s.gold - o.gold AS gold_diff, s.damage - o.damage AS damage_diff
FROM seats s LEFT JOIN seats o ON o.game_id = s.game_id AND o.slot = s.slot AND o.team <> s.team""")
def opponent_difference(s: Star) -> DataFrame:
    seats = s.seats().select("game_id", "slot", "team", "gold", "damage")
    other = F.when(F.col("team") == "F", "O").otherwise("F")
    pairs = seats.select("game_id", "team", "slot", other.alias("other")).distinct()
    out = J.minute_difference(seats, pairs.select("game_id", "team", "other").distinct(), "game_id", "team", "other",
                              "slot", ["gold", "damage"])
    return out.select("game_id", "slot", "team", "gold", "gold_diff", "damage_diff")


@query("scope_filter", with_sql(GAMES_SQL) + """
SELECT l_orderkey AS game_id, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
WHERE l_orderkey IN (SELECT game_id FROM games WHERE tier IN ('FURNITURE','AUTOMOBILE') AND patch >= 1999) GROUP BY 1""")
def scope_filter(s: Star) -> DataFrame:
    scope = s.games().where(F.col("tier").isin("FURNITURE", "AUTOMOBILE") & (F.col("patch") >= 1999))
    rows = s.table("lineitem").withColumnRenamed("l_orderkey", "game_id")
    return J.in_scope(rows, scope, ["game_id"]).groupBy("game_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("pending_work", with_sql(GAMES_SQL) + """
SELECT game_id, player FROM games WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = game_id AND l_returnflag = 'R')""")
def pending_work(s: Star) -> DataFrame:
    done = s.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("game_id"))
    return J.pending(s.games().select("game_id", "player"), done, ["game_id"])


@query("null_safe_lookup", with_sql(LINES_SQL) + """,
a AS (SELECT role, CASE WHEN slot <> 4 THEN slot END AS minute, CAST(sum(price) AS BIGINT) AS total FROM lines GROUP BY ALL),
b AS (SELECT role, CASE WHEN slot <> 4 THEN slot END AS minute, max(price) AS top FROM lines GROUP BY ALL)
SELECT a.role, a.minute, a.total, b.top FROM a JOIN b ON a.role = b.role AND a.minute IS NOT DISTINCT FROM b.minute""")
def null_safe_lookup(s: Star) -> DataFrame:
    minute = F.when(F.col("slot") != 4, F.col("slot")).alias("minute")
    rows = s.lines().select("role", minute, "price")
    a = rows.groupBy("role", "minute").agg(F.sum("price").alias("total"))
    b = rows.groupBy(F.col("role").alias("_r"), F.col("minute").alias("_m")).agg(F.max("price").alias("top"))
    return J.null_safe_join(a, b, [("role", "_r"), ("minute", "_m")]).select("role", "minute", "total", "top")


_KIND = {k: f"event_type = '{k}'" for k in ("view", "click", "purchase", "error", "signup")}


def _events(s: Star, kind: str, **names: str) -> DataFrame:
    e = s.events().where(_KIND[kind])
    return e.select("user_id", *[F.col(c).alias(n) for n, c in names.items()])


@query("asof_backward", with_sql(EVENTS_SQL) + """
SELECT v.event_id, v.user_id, p.event_id AS last_purchase, p.cents AS last_cents
FROM (SELECT * FROM ev WHERE event_type = 'view') v
ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.us >= p.us""")
def asof_backward(s: Star) -> DataFrame:
    left = _events(s, "view", event_id="event_id", us="us")
    right = _events(s, "purchase", pid="event_id", cents="cents", pus="us")
    out = J.asof(left, right, ["user_id"], "us", "pus", {"last_purchase": "pid", "last_cents": "cents"})
    return out.drop("us")


@query("asof_nearest", with_sql(EVENTS_SQL) + """
, cand AS (SELECT v.event_id, v.user_id, p.event_id AS purchase, abs(v.us - p.us) AS gap,
    row_number() OVER (PARTITION BY v.event_id ORDER BY abs(v.us - p.us), p.us) AS rn
  FROM ev v JOIN ev p ON v.user_id = p.user_id AND p.event_type = 'purchase' AND abs(v.us - p.us) <= 21600000000
  WHERE v.event_type = 'click')
SELECT v.event_id, v.user_id, c.purchase, c.gap FROM ev v LEFT JOIN cand c ON c.event_id = v.event_id AND rn = 1 WHERE v.event_type = 'click'""")
def asof_nearest(s: Star) -> DataFrame:
    left = _events(s, "click", event_id="event_id", us="us")
    right = _events(s, "purchase", pid="event_id", pus="us")
    return J.asof_nearest(left, right, ["user_id"], "us", "pus", {"purchase": "pid"}, 6 * 3600 * 1_000_000).drop("us")


@query("interval_link", with_sql(EVENTS_SQL) + """
, cand AS (SELECT v.event_id, v.user_id, v.k, p.event_id AS linked, abs(v.us - p.us) AS distance,
    row_number() OVER (PARTITION BY v.event_id ORDER BY abs(v.us - p.us), p.us) AS rn
  FROM ev v JOIN ev p ON v.user_id = p.user_id AND v.k % 10 = p.k % 10 AND p.event_type = 'view' AND abs(v.us - p.us) <= 86400000000
  WHERE v.event_type = 'error')
SELECT event_id, user_id, linked, distance FROM cand WHERE rn = 1""")
def interval_link(s: Star) -> DataFrame:
    group = (F.col("k") % 10).alias("group")
    left = s.events().where(_KIND["error"]).select("user_id", group, "event_id", "us")
    right = s.events().where(_KIND["view"]).select("user_id", group, F.col("event_id").alias("linked"), F.col("us").alias("rus"))
    out = J.nearest_link(left, right, ["user_id", "group"], "event_id", "us", "linked", "rus", 24 * 3600 * 1_000_000)
    return out.select("event_id", "user_id", "linked", "distance")


@query("range_window", with_sql(EVENTS_SQL) + """
SELECT w.event_id, CAST(count(e.event_id) AS BIGINT) AS events, CAST(coalesce(sum(e.cents), 0) AS BIGINT) AS cents
FROM ev w LEFT JOIN ev e ON e.user_id = w.user_id AND e.us > w.us - 43200000000 AND e.us <= w.us
WHERE w.event_type = 'signup' GROUP BY w.event_id""")
def range_window(s: Star) -> DataFrame:
    windows = _events(s, "signup", event_id="event_id", end_us="us").withColumn("from_us", F.col("end_us") - 12 * 3600 * 1_000_000)
    events = s.events().select("user_id", "us", "cents", F.lit(1).cast("long").alias("one"))
    out = J.window_totals(windows, events, ["user_id"], "from_us", "end_us", "us", {"events": "one", "cents": "cents"})
    return out.select("event_id", "events", "cents")


@query("cost_until_back", with_sql(EVENTS_SQL) + """
SELECT d.event_id, CAST(coalesce(sum(e.cents), 0) AS BIGINT) AS cost, CAST(count(e.event_id) AS BIGINT) AS taken
FROM ev d LEFT JOIN ev e ON e.user_id = d.user_id AND e.us > d.us AND e.us <= d.us + d.k * 600000000 AND e.event_type <> d.event_type
WHERE d.event_type = 'error' GROUP BY d.event_id""")
def cost_until_back(s: Star) -> DataFrame:
    """What the other side took while someone was away: events of other kinds in (death, return]."""
    deaths = s.events().where(_KIND["error"]).select("user_id", "event_id", "us", (F.col("us") + F.col("k") * 600_000_000).alias("back"))
    other = s.events().where("event_type <> 'error'").select("user_id", F.col("us").alias("at"), "cents", F.lit(1).cast("long").alias("one"))
    out = J.window_totals(deaths, other, ["user_id"], "us", "back", "at", {"cost": "cents", "taken": "one"})
    return out.select("event_id", "cost", "taken")


@query("alive_at", with_sql(EVENTS_SQL) + """
SELECT m.event_id, CAST(count(d.event_id) AS BIGINT) AS dead FROM ev m
LEFT JOIN ev d ON d.user_id = m.user_id AND d.event_type = 'error' AND d.us <= m.us AND m.us < d.us + (1 + d.k) * 3600000000
WHERE m.event_type = 'view' GROUP BY m.event_id""")
def alive_at(s: Star) -> DataFrame:
    moments = _events(s, "view", event_id="event_id", us="us")
    deaths = s.events().where(_KIND["error"]).select("user_id", F.col("us").alias("from_us"),
                                                     (F.col("us") + (1 + F.col("k")) * 3_600_000_000).alias("until_us"))
    return J.active_at(moments, deaths, ["user_id"], "us", "from_us", "until_us", "dead").select("event_id", "dead")


@query("lookahead_label", with_sql(EVENTS_SQL) + """
, nxt AS (SELECT m.event_id, p.event_id AS first_id, p.cents, row_number() OVER (PARTITION BY m.event_id ORDER BY p.us) AS rn
  FROM ev m JOIN ev p ON p.user_id = m.user_id AND p.event_type = 'purchase' AND p.us > m.us AND p.us - m.us <= 86400000000
  WHERE m.event_type = 'view')
SELECT m.event_id, n.first_id IS NOT NULL AS bought, n.first_id, n.cents AS first_cents
FROM ev m LEFT JOIN nxt n ON n.event_id = m.event_id AND rn = 1 WHERE m.event_type = 'view'""")
def lookahead_label(s: Star) -> DataFrame:
    moments = _events(s, "view", event_id="event_id", us="us")
    events = _events(s, "purchase", pid="event_id", cents="cents", pus="us")
    out = J.look_ahead(moments, events, ["user_id"], "us", "pus", 24 * 3600 * 1_000_000,
                       {"first_id": "pid", "first_cents": "cents"}, "bought")
    return out.select("event_id", "bought", "first_id", "first_cents")


def pairs_sql(who: str) -> str:
    return LINES_SQL + f""",
seat AS (SELECT game_id, team, {who}, max(win::INT) AS w FROM lines GROUP BY ALL),
pairs AS (SELECT a.{who}, b.{who} AS other, a.team = b.team AS together, count(*) AS games, CAST(sum(a.w) AS BIGINT) AS wins
  FROM seat a JOIN seat b ON a.game_id = b.game_id AND a.{who} <> b.{who} GROUP BY ALL)"""



@query("pair_synergy", with_sql(pairs_sql("champion")) + "SELECT * FROM pairs")
def pair_synergy(s: Star) -> DataFrame:
    return J.pair_records(s.lines(), "game_id", "team", "champion", "win")


@query("head_to_head", with_sql(pairs_sql("supplier")) + """
SELECT supplier, other, CAST(sum(games) FILTER (WHERE together) AS BIGINT) AS games_with, CAST(sum(wins) FILTER (WHERE together) AS BIGINT) AS wins_with,
  CAST(sum(games) FILTER (WHERE NOT together) AS BIGINT) AS games_against, CAST(sum(wins) FILTER (WHERE NOT together) AS BIGINT) AS wins_against
FROM pairs GROUP BY supplier, other""")
def head_to_head(s: Star) -> DataFrame:
    pairs = J.pair_records(s.lines(), "game_id", "team", "supplier", "win")
    t = F.col("together")
    return pairs.groupBy("supplier", "other").agg(
        F.sum(F.when(t, F.col("games"))).alias("games_with"), F.sum(F.when(t, F.col("wins"))).alias("wins_with"),
        F.sum(F.when(~t, F.col("games"))).alias("games_against"), F.sum(F.when(~t, F.col("wins"))).alias("wins_against"))


@query("frequent_partner", with_sql(pairs_sql("supplier")) + """
SELECT supplier, other, games, wins FROM pairs WHERE together
QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY games DESC, other) <= 5""")
def frequent_partner(s: Star) -> DataFrame:
    pairs = J.pair_records(s.lines(), "game_id", "team", "supplier", "win").where("together").drop("together")
    return J.top_per_group(pairs, ["supplier"], [F.col("games").desc(), F.col("other")], 5)


@query("series_align", with_sql(EVENTS_SQL) + """
, a AS (SELECT user_id, s // 21600 AS sec, CAST(avg(k) AS DOUBLE) AS v FROM ev WHERE event_type IN ('view','click') GROUP BY ALL),
b AS (SELECT user_id, s // 21600 AS sec, CAST(avg(k) AS DOUBLE) AS v FROM ev WHERE event_type NOT IN ('view','click') GROUP BY ALL),
e AS (SELECT a.user_id, a.sec - b.sec AS o, count(*) AS overlap, avg(abs(a.v - b.v)) AS error FROM a JOIN b ON a.user_id = b.user_id
  AND a.sec - b.sec BETWEEN -8 AND 8 GROUP BY ALL HAVING count(*) >= 4)
SELECT user_id, CAST(o AS INTEGER) AS "offset", overlap, round(error, 6) AS error FROM e
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(error, 6), abs(o), o) = 1""")
def series_align(s: Star) -> DataFrame:
    sec = F.floor(F.col("s") / 21600).alias("sec")
    one = F.col("event_type").isin("view", "click")
    series = lambda cond: s.events().where(cond).groupBy("user_id", sec).agg(F.avg("k").alias("v"))
    out = J.series_offsets(series(one).withColumnRenamed("v", "va"), series(~one).withColumnRenamed("v", "vb"),
                           ["user_id"], "sec", "va", "vb", 8, 4)
    return out.select("user_id", "offset", "overlap", "error")


@query("tracking_slot", with_sql(LINES_SQL) + """,
e AS (SELECT player, slot, count(*) AS points, round(avg(abs(discount - tax)), 6) AS error FROM lines GROUP BY player, slot
  HAVING count(*) >= 4)
SELECT player, slot, points, error FROM e WHERE error <= 4 QUALIFY row_number() OVER (PARTITION BY player ORDER BY error, slot) = 1""")
def tracking_slot(s: Star) -> DataFrame:
    return J.best_tracking_slot(s.lines(), ["player"], "slot", "discount", "tax", 4, 4.0)


@query("likely_pick", with_sql(LINES_SQL) + """,
c AS (SELECT role, class, count(*) AS games FROM lines GROUP BY ALL),
t AS (SELECT *, sum(games) OVER (PARTITION BY role) AS role_games FROM c)
SELECT role, class, games, CAST(role_games AS BIGINT) AS role_games, games / role_games AS share FROM t WHERE games / role_games > 0.15
QUALIFY row_number() OVER (PARTITION BY role ORDER BY games DESC, class) = 1""")
def likely_pick(s: Star) -> DataFrame:
    return J.likely_pick(s.lines(), "role", "class", 0.15)
