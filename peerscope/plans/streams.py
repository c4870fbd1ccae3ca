"""Streams over the events table, run over what is there. SQL twins describe what the watermark lets out."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import scratch_dir
from ..streaming import flows as S
from .registry import query
from .sequences import DROPS_SQL
from .star import EVENTS_SQL, Star, with_sql


def stream(s: Star) -> DataFrame:
    schema = s.table("events").schema
    raw = S.file_stream(s.spark, f"{s.dir}/events*.parquet", schema)
    ts = F.col("ts").cast("timestamp")
    return raw.select("event_id", "user_id", "event_type", ts.alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def _read(s: Star, path: str, like: DataFrame) -> DataFrame:
    return s.spark.read.schema(like.schema).parquet(path)


@query("stream_ingest", with_sql(EVENTS_SQL) + "SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
def stream_ingest(s: Star) -> DataFrame:
    """Every document arrives twice; each is kept once."""
    twice = stream(s).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out = S.ingest_once(twice, "event_id", "ts")
    return _read(s, S.run_available(out, "ingest"), out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_counters", with_sql(EVENTS_SQL) + """
, c AS (SELECT user_id, (s // 86400) * 86400 AS from_s, count(*) AS requests FROM ev GROUP BY ALL)
SELECT user_id, from_s, from_s + 86400 AS reset_s, requests, requests > 3 AS over_limit FROM c WHERE (from_s + 86400) * 1000000 <= (SELECT max(us) FROM ev) - 3600000000""")
def stream_counters(s: Star) -> DataFrame:
    out = S.counters(stream(s), "ts", ["user_id"], "1 day", 3)
    return _read(s, S.run_available(out, "counters"), out)


@query("stream_sliding_peak", with_sql(EVENTS_SQL) + """
, w AS (SELECT *, unnest([(s // 43200) * 43200 + 43200, (s // 43200) * 43200 + 86400]) AS at_s FROM ev)
SELECT user_id, at_s, max(cents) AS peak, max(cents) - min(cents) AS change FROM w WHERE at_s * 1000000 <= (SELECT max(us) FROM ev) - 3600000000 GROUP BY ALL""")
def stream_sliding_peak(s: Star) -> DataFrame:
    out = S.sliding_peak(stream(s), "ts", ["user_id"], "cents", "1 day", "12 hours")
    return _read(s, S.run_available(out, "peak"), out)


@query("stream_sessions", with_sql(EVENTS_SQL) + """
, f AS (SELECT *, lag(us + k * 1000000) OVER w AS pe FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, max(us + k * 1000000) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS me FROM f),
n AS (SELECT *, sum(CASE WHEN me IS NULL OR us - me >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS sid FROM g),
c AS (SELECT user_id, sid, min(us) // 1000000 AS start_s, count(*) AS games, max(us + (k + 43200) * 1000000) - 1 AS closes FROM n GROUP BY ALL)
SELECT user_id, start_s, games FROM c WHERE closes <= (SELECT max(us) FROM ev) - 86400000000""")
def stream_sessions(s: Star) -> DataFrame:
    out = S.sessions(stream(s), "user_id", "ts", "k", 43200)
    return _read(s, S.run_available(out, "sessions"), out).select("user_id", F.unix_seconds("start").alias("start_s"), "games")


@query("stream_latest", with_sql(EVENTS_SQL) + "SELECT user_id, arg_max(event_id, us) AS event_id FROM ev GROUP BY user_id")
def stream_latest(s: Star) -> DataFrame:
    path = f"{scratch_dir(s.spark).rstrip('/')}/peerscope/latest-{uuid4().hex}"
    S.run_available(stream(s).select("user_id", "ts", "event_id"), "latest", "append", S.upsert_each(path, ["user_id"], "ts"))
    return S.newest_version(s.spark, path).select("user_id", "event_id")


@query("stream_links", with_sql(EVENTS_SQL) + """
SELECT r.event_id AS recording, m.event_id AS match FROM ev r JOIN ev m ON m.user_id = r.user_id AND m.event_type = 'purchase' AND abs(m.us - r.us) <= 21600000000 WHERE r.event_type = 'view'""")
def stream_links(s: Star) -> DataFrame:
    e = stream(s)
    rec = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("recorded_at"), F.col("event_id").alias("recording"))
    mat = stream(s).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("started_at"), F.col("event_id").alias("match"))
    out = S.linked(rec, mat, "user_id", "recorded_at", "started_at", "6 hours")
    return _read(s, S.run_available(out, "links"), out).select("recording", "match")


@query("stream_scored", with_sql(EVENTS_SQL) + "SELECT event_id, round(1 / (1 + exp(-(cents - 2000) / 1000)), 6) AS p FROM ev")
def stream_scored(s: Star) -> DataFrame:
    path = f"{scratch_dir(s.spark).rstrip('/')}/peerscope/scored-{uuid4().hex}"
    score = lambda d: d.select("event_id", F.round(1 / (1 + F.exp(-(F.col("cents") - 2000) / 1000)), 6).alias("p"))
    S.run_available(stream(s), "scored", "append", S.score_each(score, path))
    return s.spark.read.parquet(path).select("event_id", "p")


@query("stream_drops", DROPS_SQL + """
, mark AS (SELECT max(us) / 1e6 - 30 AS mark_s FROM ev)
SELECT d.user_id, start_t, end_t, lost, low FROM drops d WHERE end_t <= (SELECT mark_s FROM mark) AND start_t < end_t
  AND EXISTS (SELECT 1 FROM w WHERE w.user_id = d.user_id AND w.ended AND w.t = d.end_t AND w.start_t = d.start_t)""")
def stream_drops(s: Star) -> DataFrame:
    """The batch operator's drops that a later reading has ended by the last watermark."""
    e = stream(s).select("user_id", "ts", F.col("k").alias("hp"), (F.col("cents") < 1500).alias("dead"))
    out = S.live_drops(e, "user_id", "ts", "hp", "dead", 20.0, 54_000.0, 10_800.0, idle="3650 days")
    return _read(s, S.run_available(out, "drops"), out)
