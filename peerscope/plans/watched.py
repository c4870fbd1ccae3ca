"""Recalls, slot readiness and source checks on the event binding: a user is a recording, an event a reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequence as Q
from .registry import query
from .star import EVENTS_SQL, Star, with_sql

# Events lie hours apart, so the rules' seconds are scaled.
OPENING, RESPAWNED, TRIP, LOOK, CHANNEL = 1_704_153_600.0, 14_400.0, 90_000.0, 54_000.0, 18_000.0


@query("recalls", with_sql(EVENTS_SQL) + f""",
r AS (SELECT user_id, event_id, us / 1e6 AS t, CAST(k AS DOUBLE) AS hp, CAST(cents AS DOUBLE) AS gold, event_id % 3 AS items, cents < 1500 AS dead FROM ev),
b AS (SELECT *, lag(hp) OVER w AS bhp, lag(gold) OVER w AS bgold, lag(items) OVER w AS bitems, lag(dead) OVER w AS bdead FROM r WHERE hp IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
u AS (SELECT user_id, t FROM b WHERE bdead AND NOT dead),
c AS (SELECT * FROM b WHERE bdead IS NOT NULL AND NOT dead AND t >= {OPENING} AND items <> bitems AND NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = b.user_id AND b.t - u.t BETWEEN 0 AND {RESPAWNED})),
l AS (SELECT user_id, list([t] ORDER BY t) AS ts FROM c GROUP BY user_id),
k AS (SELECT user_id, unnest(list_reduce(list_prepend([], ts), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] >= {TRIP} THEN list_concat(acc, x) ELSE acc END)) AS t FROM l)
SELECT k.user_id, k.t, coalesce((SELECT arg_min(hp, (x.t, x.event_id)) FROM b x WHERE x.user_id = k.user_id AND x.t BETWEEN k.t - {LOOK} AND k.t - {CHANNEL}), c.bhp) AS health,
  coalesce((SELECT max(gold) FROM b x WHERE x.user_id = k.user_id AND x.t >= k.t - {LOOK} AND x.t < k.t), c.bgold) AS gold FROM k JOIN c ON c.user_id = k.user_id AND c.t = k.t""")
def recalls(s: Star) -> DataFrame:
    """Trips home with the health and gold they were made with."""
    r = s.events().select("user_id", "event_id", (F.col("us") / 1e6).alias("t"), F.col("k").cast("double").alias("hp"), F.col("cents").alias("gold"), (F.col("event_id") % 3).alias("items"), (F.col("cents") < 1500).alias("dead"))
    return Q.recalls(r, "user_id", "t", "hp", "gold", "items", "dead", ["event_id"], OPENING, RESPAWNED, TRIP, LOOK, CHANNEL)


@query("slot_readiness", with_sql(EVENTS_SQL) + f""",
v AS (SELECT user_id, event_id % 2 AS slot, event_id, us, CASE WHEN cents % 9 <> 0 THEN cents / 100 END AS v FROM ev),
q AS (SELECT user_id, slot, quantile_cont(v, 0.9) AS bright, count(v) AS n FROM v GROUP BY ALL),
r AS (SELECT v.*, CASE WHEN n >= 20 THEN v >= 0.6 * bright - {Q.READY_EDGE} END AS ready FROM v JOIN q USING (user_id, slot))
SELECT user_id, slot, event_id, ready::INT AS ready, (CASE WHEN ready IS NOT NULL THEN ready AND coalesce((SELECT arg_max(x.ready, (x.us, x.event_id)) FROM r x WHERE x.user_id = r.user_id AND x.slot = r.slot AND x.ready IS NOT NULL AND (x.us, x.event_id) < (r.us, r.event_id)), false) END)::INT AS confirmed FROM r""")
def slot_readiness(s: Star) -> DataFrame:
    """Which of two slots of each recording is ready, and whether the reading before says so too."""
    v = s.events().select("user_id", (F.col("event_id") % 2).alias("slot"), "event_id", "us", F.when(F.col("cents") % 9 != 0, F.col("cents") / 100).alias("v"))
    return Q.slot_ready(v, ["user_id", "slot"], ["us", "event_id"], "v").select("user_id", "slot", "event_id", F.col("ready").cast("int").alias("ready"), F.col("confirmed").cast("int").alias("confirmed"))


CLOCK = "s - 1704067200 + user_id % 50 + CASE WHEN event_id % 4 = 0 THEN event_id % 97 ELSE event_id % 2 END"


@query("clock_offsets", with_sql(EVENTS_SQL) + f""",
d AS (SELECT user_id, CASE WHEN cents % 13 <> 0 THEN {CLOCK} END + 0.5 - (us / 1e6 - 1704067200) AS d FROM ev),
n AS (SELECT user_id, round(d) AS whole, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY ALL), m AS (SELECT user_id, arg_max(whole, (n, -whole)) AS mode FROM n GROUP BY user_id)
SELECT d.user_id, round(median(d) FILTER (abs(d - mode) <= 1.5), 4) AS "offset", round(count(*) FILTER (abs(d - mode) <= 1.5) / count(*), 6) AS agreement FROM d JOIN m USING (user_id) GROUP BY d.user_id""")
def clock_offsets(s: Star) -> DataFrame:
    """How far each recording's clock is off, some readings being wrong or missing."""
    e = s.events().select("user_id", (F.col("us") / 1e6 - 1704067200).alias("t"), F.when(F.col("cents") % 13 != 0, F.expr(CLOCK)).alias("clock"))
    return Q.clock_offsets(e, "user_id", "t", "clock").select("user_id", F.round("offset", 4).alias("offset"), F.round("agreement", 6).alias("agreement"))


@query("covered_time", with_sql(EVENTS_SQL) + """,
p AS (SELECT DISTINCT user_id, s AS a, s + cents * 20 AS z FROM ev WHERE cents > 0),
x AS (SELECT user_id, t, sum(step) OVER (PARTITION BY user_id ORDER BY t) AS depth, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS upto FROM (SELECT user_id, t, sum(step) AS step FROM (SELECT user_id, a AS t, 1 AS step FROM p UNION ALL SELECT user_id, z, -1 FROM p) GROUP BY ALL)),
y AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY user_id ORDER BY t), 0) AS before FROM x)
SELECT user_id, CAST(sum(CASE WHEN depth > 0 THEN upto - t ELSE 0 END) AS BIGINT) AS covered, count(*) FILTER (depth > 0 AND before = 0) AS pieces FROM y GROUP BY user_id""")
def covered_time(s: Star) -> DataFrame:
    """How long each user's spans last together, overlaps counted once."""
    e = s.events().select("user_id", F.col("s").alias("a"), (F.col("s") + F.col("cents") * 20).alias("z"))
    return Q.covered(e, "user_id", "a", "z")


@query("source_problems", with_sql(EVENTS_SQL) + """,
sa AS (SELECT user_id, s AS t, CASE WHEN event_id % 10 < user_id % 10 THEN 1 END AS me, cents * 2 + user_id * 40 AS distance FROM ev),
pe AS (SELECT user_id, (max(t) - min(t)) / 60.0 AS minutes, avg((me IS NOT NULL)::INT) AS coverage, count(*) FILTER (distance <= 750) AS in_range FROM sa GROUP BY user_id),
so AS (SELECT user_id, CASE WHEN user_id % 4 <> 0 THEN user_id % 11 / 10 END AS agreement, user_id % 6 = 0 AS roleless FROM (SELECT DISTINCT user_id FROM ev)),
tr AS (SELECT user_id, count(*) FILTER (cents % 4 = 0 OR (user_id % 23 = 7 AND cents % 8 <> 1)) AS trades FROM ev GROUP BY user_id),
d AS (SELECT so.*, minutes, coverage, in_range, trades, list_filter([CASE WHEN minutes < 5 THEN 'short' END, CASE WHEN coverage < 0.4 THEN 'bar unread' END, CASE WHEN agreement < 0.5 THEN 'clock uncertain' END, CASE WHEN in_range = 0 THEN 'never in range' END], lambda x: x IS NOT NULL) AS problems
  FROM so JOIN pe USING (user_id) JOIN tr USING (user_id)),
f AS (SELECT *, CASE WHEN len(problems) = 0 AND minutes > 0 THEN trades / minutes * 10 END AS rate FROM d), q AS (SELECT quantile_cont(rate, 0.25) AS q1, quantile_cont(rate, 0.75) AS q3, count(rate) AS n FROM f)
SELECT user_id, round(minutes, 4) AS minutes, round(coverage, 6) AS coverage, in_range, trades, array_to_string(problems, ', ') AS problems,
  array_to_string(list_filter([CASE WHEN roleless THEN 'role unknown' END, CASE WHEN trades = 0 AND in_range > 0 THEN 'no trades' END, CASE WHEN n >= 8 AND rate > q3 + 1 * (q3 - q1) THEN 'too many trades' END], lambda x: x IS NOT NULL), ', ') AS warnings FROM f, q""")
def source_problems(s: Star) -> DataFrame:
    """What speaks against learning from each recording."""
    e = s.events()
    u = F.col("user_id")
    samples = e.select("user_id", F.col("s").alias("t"), F.when(F.col("event_id") % 10 < u % 10, 1).alias("me"), (F.col("cents") * 2 + u * 40).alias("distance"))
    sources = e.select("user_id").distinct().select("user_id", F.when(u % 4 != 0, u % 11 / 10).alias("agreement"), F.when(u % 6 != 0, "TOP").alias("role"))
    trades = e.where((F.col("cents") % 4 == 0) | ((u % 23 == 7) & (F.col("cents") % 8 != 1))).select("user_id")
    out = Q.source_problems(samples, sources, trades, "user_id", 750.0, 1.0)
    return out.select("user_id", F.round("minutes", 4).alias("minutes"), F.round("coverage", 6).alias("coverage"), "in_range", "trades", *[F.array_join(c, ", ").alias(c) for c in ("problems", "warnings")])
