"""Ordered-sequence operators on the event and game bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bit
from ..operators import history as H
from ..operators import scoring as S
from ..operators import sequence as Q
from ..operators.ordered import numbered, previous, running, top_per_group
from .registry import query
from .star import EVENTS_SQL, GAMES_SQL, LINES_SQL, Star, with_sql

HOUR = 3600
SESSIONS_SQL = EVENTS_SQL + """,
flow AS (SELECT *, event_type = 'purchase' AS win, s + k AS ends, lag(s + k) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev_end FROM ev),
sess AS (SELECT *, CAST(sum(CASE WHEN prev_end IS NULL OR s - prev_end >= 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS session FROM flow),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY us, event_id) AS "index",
  count(*) FILTER (WHERE NOT win) OVER (PARTITION BY user_id, session ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lost,
  count(*) FILTER (WHERE NOT win) OVER (PARTITION BY user_id, session ORDER BY us, event_id) AS lost_now FROM sess),
sg AS (SELECT *, lost - coalesce(max(CASE WHEN win THEN lost_now END) OVER (PARTITION BY user_id, session ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS losses_before FROM placed)"""


def session_games(s: Star) -> DataFrame:
    e = s.events().withColumn("win", F.col("event_type") == "purchase").withColumn("ends", F.col("s") + F.col("k"))
    return H.sessions(e, ["user_id"], "s", "ends", ["us", "event_id"], 12 * HOUR, "win")


@query("sessions", with_sql(SESSIONS_SQL) + 'SELECT event_id, user_id, session, "index", losses_before FROM sg')
def sessions(s: Star) -> DataFrame:
    return session_games(s).select("event_id", "user_id", "session", "index", "losses_before")


@query("latest_session", with_sql(SESSIONS_SQL) + """
SELECT user_id, max(session) AS sessions, CAST(max_by(n, session) AS BIGINT) AS last_games, CAST(max_by(c, session) AS BIGINT) AS last_cents
FROM (SELECT user_id, session, count(*) AS n, sum(cents) AS c FROM sg GROUP BY ALL) GROUP BY user_id""")
def latest_session(s: Star) -> DataFrame:
    per = session_games(s).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("c"))
    return per.groupBy("user_id").agg(F.max("session").alias("sessions"), F.max_by("n", "session").alias("last_games"),
                                      F.max_by("c", "session").alias("last_cents"))


STREAK_SQL = GAMES_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY start_s, game_id) - row_number() OVER (PARTITION BY player, win ORDER BY start_s, game_id) AS g,
        row_number() OVER (PARTITION BY player ORDER BY start_s, game_id) AS rn FROM games),
runs AS (SELECT player, win, g, count(*) AS n, max(rn) AS last FROM r GROUP BY ALL)"""


@query("streaks", with_sql(STREAK_SQL) + """
SELECT player, CAST(coalesce(max(n) FILTER (WHERE win), 0) AS BIGINT) AS longest_win, CAST(coalesce(max(n) FILTER (WHERE NOT win), 0) AS BIGINT) AS longest_loss,
  CAST(max_by(CASE WHEN win THEN n ELSE -n END, last) AS BIGINT) AS current_run FROM runs GROUP BY player""")
def streaks(s: Star) -> DataFrame:
    return H.streaks(s.games(), ["player"], ["start_s", "game_id"], "win")


@query("prior_games", with_sql(GAMES_SQL) + """
SELECT game_id, player, role, row_number() OVER (PARTITION BY player, role ORDER BY start_s, game_id) - 1 AS prior_games FROM games""")
def prior_games(s: Star) -> DataFrame:
    return H.prior_games(s.games(), ["player", "role"], ["start_s", "game_id"]).select("game_id", "player", "role", "prior_games")


@query("rating_as_of", with_sql(GAMES_SQL) + """
SELECT game_id, player, count(score) OVER w AS games_before, avg(score) OVER w AS rating_before FROM games
WINDOW w AS (PARTITION BY player ORDER BY start_s, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def rating_as_of(s: Star) -> DataFrame:
    return H.rating_before(s.games(), ["player"], ["start_s", "game_id"], "score").select(
        "game_id", "player", "games_before", "rating_before")


@query("latest_snapshot", with_sql(GAMES_SQL) + """
SELECT player, game_id, total FROM games QUALIFY row_number() OVER (PARTITION BY player ORDER BY start_s DESC, game_id DESC) = 1""")
def latest_snapshot(s: Star) -> DataFrame:
    rows = s.games().select("player", "game_id", "start_s", "total")
    return H.latest(rows, ["player"], ["start_s", "game_id"]).select("player", "game_id", "total")


@query("snapshot_changes", with_sql(GAMES_SQL) + """
SELECT game_id, player, role FROM games QUALIFY coalesce(lag(role) OVER (PARTITION BY player ORDER BY start_s, game_id) <> role, true)""")
def snapshot_changes(s: Star) -> DataFrame:
    return H.changes_only(s.games(), ["player"], ["start_s", "game_id"], ["role"]).select("game_id", "player", "role")


@query("sustained_runs", with_sql(LINES_SQL) + """,
c AS (SELECT player, slot AS minute, CAST(avg(discount) AS DOUBLE) * 10 AS g FROM lines GROUP BY ALL),
m AS (SELECT *, CASE WHEN g <= 45 THEN 'weak' WHEN g >= 55 THEN 'strong' END AS kind FROM c),
i AS (SELECT *, minute - row_number() OVER (PARTITION BY player, kind ORDER BY minute) AS isl FROM m WHERE kind IS NOT NULL)
SELECT player, kind, min(minute) AS first_minute, max(minute) AS last_minute, count(*) AS minutes, round(avg(g), 6) AS mean_value
FROM i GROUP BY player, kind, isl HAVING count(*) >= 3""")
def sustained_runs(s: Star) -> DataFrame:
    c = s.lines().groupBy("player", F.col("slot").alias("minute")).agg((F.avg("discount") * 10).alias("g"))
    return S.sustained_runs(c, ["player"], "minute", "g", 45.0, 55.0, 3).withColumn("mean_value", F.round("mean_value", 6))


@query("ffill_age", with_sql(EVENTS_SQL) + """
, f AS (SELECT *, max(CASE WHEN event_type = 'view' THEN s END) OVER w AS seen, last_value(CASE WHEN event_type = 'view' THEN cents END IGNORE NULLS) OVER w AS v
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN s - seen <= 86400 THEN v END AS cents_filled FROM f""")
def ffill_age(s: Star) -> DataFrame:
    e = s.events().withColumn("cents", F.when(F.col("event_type") == "view", F.col("cents"))).withColumn("t", F.col("us"))
    e = e.select("event_id", "user_id", "cents", "t", "s")
    out = Q.filled(e, ["user_id"], "s", ["cents"], 86400, ["event_id"])
    return out.select("event_id", "cents_filled")


@query("value_ago", with_sql(EVENTS_SQL) + """
, c AS (SELECT a.event_id, b.cents, row_number() OVER (PARTITION BY a.event_id ORDER BY b.us DESC) AS rn FROM ev a JOIN ev b
  ON b.user_id = a.user_id AND b.us <= a.us - 43200000000 AND b.us >= a.us - 86400000000)
SELECT e.event_id, e.cents - c.cents AS change FROM ev e LEFT JOIN c ON c.event_id = e.event_id AND rn = 1""")
def value_ago(s: Star) -> DataFrame:
    e = s.events().select("event_id", "user_id", "us", "cents")
    out = Q.value_ago(e, ["user_id"], "us", "cents", 12 * HOUR * 1_000_000, 12 * HOUR * 1_000_000, "then")
    return out.select("event_id", (F.col("cents") - F.col("then")).alias("change"))


@query("rolling_max", with_sql(EVENTS_SQL) + """
SELECT event_id, max(cents) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS peak FROM ev""")
def rolling_max(s: Star) -> DataFrame:
    return Q.rolling_max(s.events(), ["user_id"], "us", "cents", 24 * HOUR * 1_000_000, "peak").select("event_id", "peak")


@query("run_seconds", with_sql(EVENTS_SQL) + """
, f AS (SELECT *, cents >= 2000 AS on_, lag(cents >= 2000) OVER w AS was, lag(s) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
b AS (SELECT *, last_value(CASE WHEN on_ AND (was IS NULL OR NOT was OR s - pt > 86400) THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS began FROM f)
SELECT event_id, CASE WHEN on_ THEN s - began END AS held FROM b""")
def run_seconds(s: Star) -> DataFrame:
    e = s.events().select("event_id", "user_id", "s", "cents")
    return Q.run_length(e, ["user_id"], "s", F.col("cents") >= 2000, 86400, "held", ["event_id"]).select("event_id", "held")


@query("since_event", with_sql(EVENTS_SQL) + """
SELECT v.event_id, least(604800, coalesce(v.s - max(p.s), 604800)) AS since, count(p.event_id) AS events_before, CAST(coalesce(sum(p.cents), 0) AS BIGINT) AS cents_before
FROM ev v LEFT JOIN ev p ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.s < v.s WHERE v.event_type <> 'purchase' GROUP BY v.event_id, v.s""")
def since_event(s: Star) -> DataFrame:
    e = s.events()
    left = e.where("event_type <> 'purchase'").select("event_id", "user_id", "s")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("s").alias("ps"), "cents")
    out = Q.since_event(left, right, ["user_id"], "s", "ps", 7 * 86400, {"cents_before": "cents"})
    return out.select("event_id", F.col("since").cast("long").alias("since"), "events_before", "cents_before")


@query("kept_runs", with_sql(EVENTS_SQL) + """
, f AS (SELECT *, cents < 2000 AS blank, row_number() OVER (PARTITION BY user_id ORDER BY us) - row_number() OVER (PARTITION BY user_id, cents < 2000 ORDER BY us) AS g FROM ev),
r AS (SELECT *, max(s) OVER (PARTITION BY user_id, blank, g) - min(s) OVER (PARTITION BY user_id, blank, g) AS span FROM f)
SELECT event_id, blank AND span >= 43200 AS dead FROM r""")
def kept_runs(s: Star) -> DataFrame:
    e = s.events().withColumn("blank", F.col("cents") < 2000).select("event_id", "user_id", "s", "blank")
    return Q.keep_long_runs(e, ["user_id"], "s", "blank", 12 * HOUR, "dead", ["event_id"]).select("event_id", "dead")


@query("median_of_three", with_sql(EVENTS_SQL) + """
, f AS (SELECT *, lag(cents) OVER w AS a, lead(cents) OVER w AS z FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, CASE WHEN a IS NULL OR z IS NULL THEN cents ELSE a + cents + z - greatest(a, cents, z) - least(a, cents, z) END AS smooth FROM f""")
def median_of_three(s: Star) -> DataFrame:
    e = s.events().select("event_id", "user_id", "us", "cents")
    return Q.median_of_three(e, ["user_id"], ["us", "event_id"], "cents", "smooth").select("event_id", "smooth")


@query("downsample", with_sql(EVENTS_SQL) + """
SELECT user_id, s // 86400 AS slot, arg_min(cents, us) AS cents FROM ev GROUP BY user_id, slot""")
def downsample(s: Star) -> DataFrame:
    e = s.events().withColumn("day", F.col("us"))
    return Q.downsample(e, ["user_id"], "us", 86_400_000_000, ["cents"]).select("user_id", "slot", "cents")


@query("window_median", with_sql(EVENTS_SQL) + """
SELECT user_id, s // 21600 AS second, quantile_cont(cents, 0.5) AS cents FROM ev GROUP BY ALL""")
def window_median(s: Star) -> DataFrame:
    e = s.events().select("user_id", (F.col("s") / 21600).alias("t"), "cents")
    return Q.per_second_median(e, ["user_id"], "t", "cents")


@query("reset_count", with_sql(EVENTS_SQL) + """
, f AS (SELECT *, lag(k) OVER w AS a, lead(k) OVER w AS z FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, CAST(sum(CASE WHEN a >= 50 AND k <= 35 AND z <= 35 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS level_ups FROM f""")
def reset_count(s: Star) -> DataFrame:
    e = s.events().select("event_id", "user_id", "us", "k")
    return Q.resets(e, ["user_id"], ["us", "event_id"], "k", 50, 35, "level_ups").select("event_id", "level_ups")


@query("ready_bits", with_sql(EVENTS_SQL) + "SELECT event_id, (k >> 0) & 1 = 1 AS q, (k >> 2) & 1 = 1 AS e, (k >> 3) & 1 = 1 AS r FROM ev")
def ready_bits(s: Star) -> DataFrame:
    return s.events().select("event_id", bit("k", 0).alias("q"), bit("k", 2).alias("e"), bit("k", 3).alias("r"))


HITS_SQL = EVENTS_SQL + """,
h AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY us) AS pt FROM ev WHERE event_type IN ('click', 'error')),
g AS (SELECT *, CAST(sum(CASE WHEN pt IS NULL OR s - pt > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS segment FROM h)"""


@query("quiet_segments", with_sql(HITS_SQL) + """
SELECT user_id, segment, min(s) AS start_s, max(s) AS end_s, count(*) AS hits, CAST(sum(cents) AS BIGINT) AS cents,
  arg_min(event_type, us) AS opened_by FROM g GROUP BY user_id, segment""")
def quiet_segments(s: Star) -> DataFrame:
    hits = s.events().where(F.col("event_type").isin("click", "error"))
    seg = Q.segment_by_quiet(hits, ["user_id"], "s", 6 * HOUR, tie=["event_id"])
    return seg.groupBy("user_id", "segment").agg(
        F.min("s").alias("start_s"), F.max("s").alias("end_s"), F.count(F.lit(1)).alias("hits"),
        F.sum("cents").alias("cents"), F.min_by("event_type", "us").alias("opened_by"))


def lane_samples(s: Star) -> DataFrame:
    """Events as readings of two health bars: k and the cents, in hours."""
    return s.events().select("user_id", "event_id", "s", F.col("k").alias("me"), (F.col("cents") % 100).alias("them"),
                             (F.col("event_id") % 7).alias("distance"), (F.col("event_id") % 3 == 0).cast("int").alias("others"),
                             (F.col("k") % 6).alias("mine"), (F.col("cents") % 5).alias("theirs"))


TRADES_SQL = EVENTS_SQL + """,
sm AS (SELECT user_id, s, event_id, k AS me, cents % 100 AS them, event_id % 7 AS distance, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS others,
       k % 6 AS mine, cents % 5 AS theirs FROM ev),
p AS (SELECT *, lag(me) OVER w AS pm, lag(them) OVER w AS po, lag(s) OVER w AS pt FROM sm WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
hh AS (SELECT *, coalesce(pm - me >= 20 OR po - them >= 20, false) AS hit, greatest(pm - me, 0) AS lm, greatest(po - them, 0) AS lo FROM p),
lh AS (SELECT *, max(CASE WHEN hit THEN s END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_hit FROM hh),
tr AS (SELECT *, CAST(sum(CASE WHEN last_hit IS NULL OR pt - last_hit >= 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS trade FROM lh WHERE hit),
tg AS (SELECT user_id, trade, arg_min(pt, (s, event_id)) AS start_s, max(s) AS end_s, arg_min(distance <= 4, (s, event_id)) AS near, CAST(sum(lm) AS BIGINT) AS me_lost, CAST(sum(lo) AS BIGINT) AS opponent_lost,
  arg_min(CASE WHEN lm >= 20 AND lo >= 20 THEN 'both' WHEN lo >= 20 THEN 'you' ELSE 'opponent' END, (s, event_id)) AS started_by, max(others) > 0 AS skirmish,
  arg_min(mine - theirs, (s, event_id)) AS minion_edge FROM tr GROUP BY user_id, trade),
trades AS (SELECT * EXCLUDE (near), CASE WHEN opponent_lost - me_lost >= 20 THEN 'won' WHEN opponent_lost - me_lost <= -20 THEN 'lost' ELSE 'even' END AS result FROM tg WHERE near)"""


def lane_trades(s: Star) -> DataFrame:
    return Q.trades(lane_samples(s), "user_id", "s", "me", "them", "distance", "others", 4, 20, 12 * HOUR, 1e18, ("mine", "theirs"), tie=["event_id"])


@query("trade_segments", with_sql(TRADES_SQL) + "SELECT * FROM trades")
def trade_segments(s: Star) -> DataFrame:
    return lane_trades(s)


@query("trade_consequences", with_sql(TRADES_SQL) + """,
d AS (SELECT t.user_id, t.trade, min(e.s) AS at FROM trades t JOIN ev e ON e.user_id = t.user_id AND e.event_type = 'error' AND e.s > t.end_s AND e.s - t.end_s <= 86400 GROUP BY ALL),
b AS (SELECT t.user_id, t.trade, min(e.s) AS at FROM trades t JOIN ev e ON e.user_id = t.user_id AND e.event_type = 'purchase' AND e.s > t.end_s AND e.s - t.end_s <= 172800 GROUP BY ALL)
SELECT t.user_id, t.trade, d.at IS NOT NULL AS died, b.at - t.end_s AS back_after_s FROM trades t LEFT JOIN d USING (user_id, trade) LEFT JOIN b USING (user_id, trade)""")
def trade_consequences(s: Star) -> DataFrame:
    e = s.events()
    out = Q.consequences(lane_trades(s), e.where("event_type = 'error'").select("user_id", F.col("s").alias("at")),
                         e.where("event_type = 'purchase'").select("user_id", F.col("s").alias("at")), ["user_id"], "end_s", "at", 86400, 172800)
    return out.select("user_id", "trade", "died", "back_after_s")


@query("trade_statistics", with_sql(TRADES_SQL) + """
SELECT user_id, count(*) AS trades, count(*) FILTER (WHERE result = 'won') AS won, count(*) FILTER (WHERE result = 'lost') AS lost,
  count(*) FILTER (WHERE result = 'even') AS even, CAST(sum(opponent_lost - me_lost) AS BIGINT) AS net, count(*) FILTER (WHERE started_by = 'you') / count(*) AS started_share,
  count(*) FILTER (WHERE minion_edge > 0) AS with_edge, count(*) FILTER (WHERE minion_edge > 0 AND result = 'won') AS with_edge_won
FROM trades WHERE NOT skirmish GROUP BY user_id""")
def trade_statistics(s: Star) -> DataFrame:
    t = lane_trades(s).where(~F.col("skirmish"))
    n = lambda c: F.count(F.when(c, 1))
    res, edge = F.col("result"), F.col("minion_edge") > 0
    return t.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("trades"), n(res == "won").alias("won"), n(res == "lost").alias("lost"), n(res == "even").alias("even"),
        F.sum(F.col("opponent_lost") - F.col("me_lost")).alias("net"),
        (n(F.col("started_by") == "you") / F.count(F.lit(1))).alias("started_share"),
        n(edge).alias("with_edge"), n(edge & (res == "won")).alias("with_edge_won"))


DROPS_SQL = """
WITH RECURSIVE ev AS (SELECT event_id, user_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS us, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
e AS (SELECT *, us / 1e6 AS t, CAST(k AS DOUBLE) AS h, cents < 1500 AS dead, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
w AS (SELECT user_id, rn, n, t, h, false AS is_on, 0.0::DOUBLE AS start_t, 0.0::DOUBLE AS peak, 0.0::DOUBLE AS last_fall, 0.0::DOUBLE AS low, false AS ended FROM e WHERE rn = 1
  UNION ALL
  SELECT y.user_id, y.rn, y.n, y.t, y.h, y.goes AND NOT y.ends, y.start_t, y.peak, y.last_fall, y.low, y.ends FROM (
    SELECT x.*, opens OR was_on AS goes, (was_on AND (dead OR t - start_t > 54000 OR (NOT fall AND t - last_before >= 10800))) OR (opens AND t - start_t > 54000) AS ends FROM (
      SELECT e.user_id, e.rn, e.n, e.t, e.h, e.dead, w.is_on AS was_on, NOT e.dead AND e.h < w.h AS fall, NOT w.is_on AND NOT e.dead AND e.h < w.h AS opens,
        CASE WHEN NOT w.is_on AND NOT e.dead AND e.h < w.h THEN w.t ELSE w.start_t END AS start_t, CASE WHEN NOT w.is_on AND NOT e.dead AND e.h < w.h THEN w.h ELSE w.peak END AS peak,
        w.last_fall AS last_before, CASE WHEN NOT e.dead AND e.h < w.h THEN e.t ELSE w.last_fall END AS last_fall,
        least(e.h, CASE WHEN NOT w.is_on AND NOT e.dead AND e.h < w.h THEN w.h ELSE w.low END) AS low
      FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1) x) y),
drops AS (SELECT user_id, start_t, t AS end_t, peak - low AS lost, low FROM w WHERE (ended OR (is_on AND rn = n)) AND peak - low >= 20)"""


def health_readings(s: Star) -> DataFrame:
    """Events as readings: seconds, health of 0 to 100, dead below a value."""
    return s.events().select("user_id", "event_id", "event_type", (F.col("us") / 1e6).alias("t"), F.col("k").cast("double").alias("hp"), (F.col("cents") < 1500).alias("dead"))


@query("health_drops", DROPS_SQL + """
SELECT user_id, start_t, end_t, lost, low, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.user_id = d.user_id AND event_type = 'error' AND us / 1e6 BETWEEN start_t AND start_t + 72000) THEN 'death'
  WHEN EXISTS (SELECT 1 FROM ev WHERE ev.user_id = d.user_id AND event_type = 'purchase' AND us / 1e6 BETWEEN start_t AND start_t + 216000) THEN 'recall' ELSE 'stayed' END AS outcome FROM drops d""")
def health_drops(s: Star) -> DataFrame:
    r = health_readings(s)
    drops = Q.health_drops(r, "user_id", "t", "hp", "dead", ["event_id"], 20.0, 54_000.0, 10_800.0)
    return Q.drop_outcomes(drops, r.where("event_type = 'error'"), r.where("event_type = 'purchase'"), "user_id", "t", 72_000.0, 216_000.0)


@query("bursts", with_sql(EVENTS_SQL) + """
, f AS (SELECT *, us / 1e6 AS t, CAST(k AS DOUBLE) AS h, cents < 1500 AS dead, lag(cents < 1500) OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM ev),
d AS (SELECT user_id, event_id, t FROM f WHERE dead AND was = false),
a AS (SELECT d.*, (SELECT min(t) FROM f WHERE f.user_id = d.user_id AND f.t >= d.t - 37800 AND f.t < d.t) AS bt, (SELECT max(t) FROM f WHERE f.user_id = d.user_id AND f.t >= d.t - 37800 AND f.t < d.t AND h >= 60) AS ht FROM d)
SELECT user_id, t, event_id, coalesce((SELECT min(h) FROM f WHERE f.user_id = a.user_id AND f.t = a.bt), 0.0) AS before, t - ht AS from_high, coalesce(t - ht <= 10800, false) AS burst FROM a""")
def bursts(s: Star) -> DataFrame:
    return Q.bursts(health_readings(s), "user_id", "t", "hp", "dead", ["event_id"], 60.0, 37_800.0, 10_800.0)


@query("deaths_seen", with_sql(EVENTS_SQL) + """
, f AS (SELECT *, lag(cents < 1500) OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM ev)
SELECT event_id, user_id FROM f WHERE cents < 1500 AND NOT coalesce(was, false)""")
def deaths_seen(s: Star) -> DataFrame:
    e = s.events().withColumn("dead", F.col("cents") < 1500)
    return Q.state_changes(e, ["user_id"], ["us", "event_id"], "dead").select("event_id", "user_id")


@query("spaced_picks", """
WITH RECURSIVE e AS (SELECT user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s FROM events WHERE event_type = 'purchase'),
kept(user_id, s) AS (SELECT user_id, min(s) FROM e GROUP BY user_id
  UNION ALL SELECT k.user_id, (SELECT min(x.s) FROM e x WHERE x.user_id = k.user_id AND x.s >= k.s + 86400) FROM kept k WHERE k.s IS NOT NULL)
SELECT user_id, s FROM kept WHERE s IS NOT NULL""")
def spaced_picks(s: Star) -> DataFrame:
    e = s.events().where("event_type = 'purchase'").select("user_id", "s")
    return Q.spaced(e, "user_id", "s", 86400)


@query("previous_decisions", with_sql(EVENTS_SQL) + """
SELECT event_id, lag(event_type, 1) OVER w AS before_1, lag(event_type, 2) OVER w AS before_2, coalesce(lag(event_type, 1) OVER w = 'purchase', false)::INT AS before_1_purchase
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def previous_decisions(s: Star) -> DataFrame:
    e = s.events()
    out = previous(e, ["user_id"], ["us", "event_id"], {"before_1": F.col("event_type")})
    out = previous(out, ["user_id"], ["us", "event_id"], {"before_2": F.col("event_type")}, steps=2)
    return out.select("event_id", "before_1", "before_2", F.coalesce(F.col("before_1") == "purchase", F.lit(False)).cast("int").alias("before_1_purchase"))


@query("cumulative_counters", with_sql(EVENTS_SQL) + """
SELECT event_id, count(*) FILTER (WHERE event_type = 'purchase') OVER w AS kills, count(*) FILTER (WHERE event_type = 'error') OVER w AS deaths,
  CAST(sum(cents) OVER w AS BIGINT) AS gold FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cumulative_counters(s: Star) -> DataFrame:
    is_ = lambda k: F.when(F.col("event_type") == k, 1)
    out = running(s.events(), ["user_id"], ["us", "event_id"], {"kills": ("count", is_("purchase")), "deaths": ("count", is_("error")), "gold": ("sum", F.col("cents"))})
    return out.select("event_id", "kills", "deaths", "gold")


@query("newest_games", with_sql(GAMES_SQL) + """
SELECT player, game_id, row_number() OVER (PARTITION BY player ORDER BY start_s DESC, game_id DESC) AS place FROM games
QUALIFY place BETWEEN 6 AND 10""")
def newest_games(s: Star) -> DataFrame:
    """A page of each player's history: the sixth to tenth newest game."""
    g = s.games().select("player", "game_id", "start_s")
    out = top_per_group(g, ["player"], [F.col("start_s").desc(), F.col("game_id").desc()], 10, "place")
    return out.where("place > 5").select("player", "game_id", "place")


@query("hash_sample", "SELECT o_orderkey AS game_id FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 500")
def hash_sample(s: Star) -> DataFrame:
    return s.table("orders").select(F.col("o_orderkey").alias("game_id")).orderBy(F.md5(F.col("game_id").cast("string").cast("binary"))).limit(500)


@query("first_position_distinct", with_sql(LINES_SQL) + """,
f AS (SELECT game_id, champion, min(slot) AS first_slot FROM lines GROUP BY ALL)
SELECT game_id, champion, row_number() OVER (PARTITION BY game_id ORDER BY first_slot, champion) AS place FROM f""")
def first_position_distinct(s: Star) -> DataFrame:
    f = s.lines().groupBy("game_id", "champion").agg(F.min("slot").alias("first_slot"))
    return numbered(f, ["game_id"], ["first_slot", "champion"], "place").select("game_id", "champion", "place")


RANKS_SQL = GAMES_SQL + """,
steps AS (SELECT *, CASE WHEN win THEN 22 ELSE -22 END AS move, row_number() OVER (PARTITION BY player ORDER BY start_s, game_id) AS rn FROM games),
snap AS (SELECT player, start_s AS snap_s, CAST(max_by(total % 2800, game_id) AS BIGINT) AS ladder FROM games WHERE game_id % 3 = 0 GROUP BY player, start_s),
anch AS (SELECT *, lead(ladder) OVER (PARTITION BY player ORDER BY snap_s) AS nxt FROM snap),
g AS (SELECT s.*, a.snap_s AS since, a.ladder AS from_, a.nxt AS to_ FROM steps s ASOF LEFT JOIN anch a ON s.player = a.player AND s.start_s > a.snap_s),
k AS (SELECT *, sum(move) OVER (PARTITION BY player, since ORDER BY rn) AS walk, row_number() OVER (PARTITION BY player, since ORDER BY rn) AS kk,
      sum(move) OVER (PARTITION BY player, since) AS tot, count(*) OVER (PARTITION BY player, since) AS n FROM g
      WHERE player IN (SELECT player FROM snap)),
firsts AS (SELECT player, arg_min(ladder, snap_s) AS f FROM snap GROUP BY player),
w AS (SELECT k.*, f, min(walk) OVER (PARTITION BY k.player, since ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS la,
      min(walk) OVER (PARTITION BY k.player, since ORDER BY rn) AS lb FROM k JOIN firsts USING (player))"""


@query("rank_history", with_sql(RANKS_SQL) + """
SELECT game_id, player, round(CASE WHEN since IS NULL THEN greatest(f - (tot - walk), walk - la)
  WHEN to_ IS NOT NULL THEN from_ + walk + (to_ - from_ - tot) * kk / n ELSE greatest(from_ + walk, walk - lb) END, 5) AS ladder FROM w""")
def rank_history(s: Star) -> DataFrame:
    g = s.games().select("game_id", "player", "start_s", "win", "total")
    snaps = g.where("game_id % 3 = 0").groupBy("player", F.col("start_s").alias("at")).agg(
        F.max_by(F.col("total") % 2800, "game_id").alias("ladder"))
    out = H.rank_line(g.drop("total"), snaps, "player", "start_s", "game_id", "win", "at", "ladder")
    return out.select("game_id", "player", F.round("ladder", 5).alias("ladder"))
