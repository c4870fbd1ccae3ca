"""Structured Streaming versions. Each is a DataFrame-to-DataFrame step, so batch and stream share the logic.

Event time and late data: every stateful step states its watermark. Rows later than the watermark are dropped,
windows and sessions are emitted once the watermark has passed their end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scale import scratch_dir
from ..sources.tables import newest


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, label: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Process what is there, then stop; returns the folder of the output."""
    base = f"{scratch_dir(stream.sparkSession).rstrip('/')}/peerscope/stream-{label}-{uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", f"{base}/out").start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return f"{base}/out"


def ingest_once(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Each document once: repeats inside the watermark are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, player: str, start: str, duration_s: str, gap_s: int, delay: str = "1 day") -> DataFrame:
    """Sessions of play as they close. The gap is one microsecond short, because touching windows merge while a
    break of exactly the gap ends a session."""
    width = F.concat(F.lit("interval "), (F.col(duration_s) + F.lit(gap_s)).cast("long") * 1_000_000 - 1, F.lit(" microseconds"))
    s = stream.withWatermark(start, delay).groupBy(player, F.session_window(F.col(start), width.cast("interval")).alias("_w"))
    return s.agg(F.count(F.lit(1)).alias("games")).select(
        player, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "games")


def counters(stream: DataFrame, time: str, keys: Sequence[str], span: str, limit: int, delay: str = "1 hour") -> DataFrame:
    """Requests per key in fixed windows, with an over-limit flag and the window's end for the reset."""
    g = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, span).alias("_w")).agg(F.count(F.lit(1)).alias("requests"))
    return g.select(*keys, F.unix_seconds("_w.start").alias("from_s"), F.unix_seconds("_w.end").alias("reset_s"), "requests", (F.col("requests") > limit).alias("over_limit"))


def sliding_peak(stream: DataFrame, time: str, keys: Sequence[str], value: str, span: str, step: str, delay: str = "1 hour") -> DataFrame:
    """Largest value and its range over sliding windows."""
    g = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, span, step).alias("_w")).agg(F.max(value).alias("peak"), (F.max(value) - F.min(value)).alias("change"))
    return g.select(*keys, F.unix_seconds("_w.end").alias("at_s"), "peak", "change")


def upsert_each(path: str, keys: Sequence[str], at: str) -> Callable[[DataFrame, int], None]:
    """Keep the newest row per key: every batch writes a new version of the table beside the last one, so a
    batch that is run again replaces its own version and readers never see half of one."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/v={batch_id - 1}") if batch_id > 0 else None
        both = batch if old is None else old.unionByName(batch)
        newest(both, keys, at).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
    return each


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    v = spark.read.parquet(path)
    last = v.agg(F.max("v")).first()[0]
    return spark.read.parquet(f"{path}/v={last}")


def linked(recordings: DataFrame, matches: DataFrame, key: str, rec_time: str, match_time: str, within: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Recordings with matches of the same key that started within the span: an interval join with watermarks on
    both sides, so state is dropped once no partner can come any more."""
    r = recordings.withWatermark(rec_time, delay).withColumnRenamed(key, "_rk")
    m = matches.withWatermark(match_time, delay)
    span = F.expr(f"INTERVAL {within}")
    on = (F.col("_rk") == F.col(key)) & (F.col(match_time) >= F.col(rec_time) - span) & (F.col(match_time) <= F.col(rec_time) + span)
    return r.join(m, on, "inner").drop("_rk")


def score_each(score: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Score each batch with a saved model and write it under its own id, so a repeated batch replaces itself."""
    def each(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return each


DROP_STATE = "t array<double>, hp array<double>, dead array<boolean>"
DROP_OUT = "start_t double, end_t double, lost double, low double"


def closed_drops(t: list[float], hp: list[float], dead: list[bool], within: float, quiet: float) -> tuple[list[tuple], int]:
    """Drops that have ended among readings in time order, and the first reading that is still needed.

    The rule is that of the batch operator. Needed are the readings of the drop that is open, or the last one.
    """
    found, i, n = [], 1, len(t)
    while i < n:
        if dead[i] or hp[i] >= hp[i - 1]:
            i += 1
            continue
        start, last, j = i - 1, t[i], i
        while j < n and not dead[j] and t[j] - t[start] <= within:
            if hp[j] < hp[j - 1]:
                last = t[j]
            elif t[j] - last >= quiet:
                break
            j += 1
        if j == n:
            return found, start
        low = min(hp[start:j + 1])
        found.append((t[start], t[j], hp[start] - low, low))
        i = j + 1
    return found, max(0, n - 1)


def live_drops(stream: DataFrame, key: str, time: str, health: str, dead: str, share: float = 0.2, within: float = 15.0, quiet: float = 3.0,
               delay: str = "30 seconds", idle: str = "1 hour") -> DataFrame:
    """Health drops per recording as they end; times are seconds of the event time.

    Readings are taken up in time order once the watermark has passed them. The state holds the readings it
    has not reached and those of an open drop, from its first reading on. After ``idle`` of event time
    without a reading the recording is over: an open drop ends at its last reading.
    """
    kind = stream.schema[key].dataType.simpleString()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, hp, dd = (list(x) for x in state.get) if state.exists else ([], [], [])
        for f in frames:
            t += f["_t"].tolist()
            hp += f["_h"].tolist()
            dd += f["_d"].tolist()
        order = sorted(range(len(t)), key=lambda i: (t[i], hp[i]))
        t, hp, dd = ([x[i] for i in order] for x in (t, hp, dd))
        mark = state.getCurrentWatermarkMs()
        over = bool(t) and mark >= t[-1] * 1000 + idle_ms
        ready = len(t) if over else sum(x * 1000 <= mark for x in t)
        rows, keep = closed_drops(t[:ready], hp[:ready], dd[:ready], within, quiet)
        if over and keep < len(t) - 1:
            rows.append((t[keep], t[-1], hp[keep] - min(hp[keep:]), min(hp[keep:])))
        if over:
            state.remove()
        else:
            keep = min(keep, ready)
            state.update((t[keep:], hp[keep:], dd[keep:]))
            next_ = t[ready] * 1000 if ready < len(t) else t[-1] * 1000 + idle_ms  # when the watermark passes a reading held, or the recording is over
            state.setTimeoutTimestamp(max(mark, int(next_)) + 1)
        yield pd.DataFrame([(k[0], *r) for r in rows if r[2] >= share], columns=[key, "start_t", "end_t", "lost", "low"])

    s = stream.withWatermark(time, delay).where(F.col(health).isNotNull()).select(
        key, time, (F.unix_micros(time) / 1e6).alias("_t"), F.col(health).cast("double").alias("_h"), F.coalesce(F.col(dead), F.lit(False)).alias("_d"))
    return s.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {DROP_OUT}", DROP_STATE, "append", GroupStateTimeout.EventTimeTimeout)
