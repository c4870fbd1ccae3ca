"""Ordered readings: runs, smoothing, as-of ages, trades, drops, deaths and recalls.

Windows over (key, time) through ``running``; no Python runs on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof, look_ahead
from .ordered import islands, previous, rolling_range, running, top_per_group
from .quantiles import grouped_quantiles
from .scale import dimension, written


def filled(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], max_age: float, tie: Sequence[str] = ()) -> DataFrame:
    """Forward fill, but only from readings at most ``max_age`` old; ``tie`` orders readings of one time."""
    t = F.col(time)
    want = {f"_f_{v}": ("last", F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"), t.alias("t")))) for v in values}
    out = running(df, keys, [time, *tie], want)
    fresh = lambda v: t - F.col(f"_f_{v}")["t"] <= F.lit(max_age)
    return out.select(*df.columns, *[F.when(fresh(v), F.col(f"_f_{v}")["v"]).alias(f"{v}_filled") for v in values])


def value_ago(df: DataFrame, keys: Sequence[str], time: str, value: str, ago: float, tolerance: float,
              name: str) -> DataFrame:
    """The reading of at least ``ago`` earlier, at most ``tolerance`` older than that."""
    left = df.withColumn("_then", F.col(time) - F.lit(ago))
    right = df.where(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_rt"), F.col(value).alias("_rv"))
    out = asof(left, right, keys, "_then", "_rt", {"_v": "_rv"}, matched_time="_mt")
    ok = F.col("_then") - F.col("_mt") <= F.lit(tolerance)
    return out.select(*df.columns, F.when(ok, F.col("_v")).alias(name))


def rolling_max(df: DataFrame, keys: Sequence[str], time: str, value: str, span: float, name: str) -> DataFrame:
    return rolling_range(df, keys, time, span, {name: F.max(value)})


def run_length(df: DataFrame, keys: Sequence[str], time: str, flag: Column, max_gap: float, name: str, tie: Sequence[str] = ()) -> DataFrame:
    """Time since the start of the unbroken run of a condition; null while it does not hold. ``tie`` orders readings of one time."""
    out = previous(df.withColumn("_on", F.coalesce(flag, F.lit(False))), keys, [time, *tie],
                   {"_was": F.col("_on"), "_pt": F.col(time)})
    fresh = F.col("_was").isNull() | ~F.col("_was") | (F.col(time) - F.col("_pt") > F.lit(max_gap))
    out = running(out, keys, [time, *tie], {"_begin": ("last", F.when(F.col("_on") & fresh, F.col(time)))})
    return out.select(*df.columns, F.when(F.col("_on"), F.col(time) - F.col("_begin")).alias(name))


def since_event(df: DataFrame, events: DataFrame, keys: Sequence[str], time: str, event_time: str, cap: float,
                totals: dict[str, str] | None = None, name: str = "since") -> DataFrame:
    """Time since the latest event that ended strictly before the reading (capped), count and sums of all such."""
    totals = totals or {}
    e = events.withColumn("_one", F.lit(1).cast("long"))
    values = {"_at": event_time, "events_before": "_one", **totals}
    kinds = {"events_before": "sum", **{n: "sum" for n in totals}}
    out = asof(df, e, keys, time, event_time, values, strict=True, kinds=kinds)
    age = F.least(F.lit(cap), F.coalesce(F.col(time) - F.col("_at"), F.lit(cap)))
    return out.select(*df.columns, age.alias(name), F.coalesce("events_before", F.lit(0)).alias("events_before"),
                      *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in totals])


def keep_long_runs(df: DataFrame, keys: Sequence[str], time: str, flag: str, min_span: float, name: str, tie: Sequence[str] = ()) -> DataFrame:
    """Clear runs of a flag shorter than ``min_span`` (first to last reading), keep the rest; ``tie`` orders readings of one time."""
    out = previous(df, keys, [time, *tie], {"_was": F.col(flag)})
    out = islands(out, keys, [time, *tie], F.col("_was").isNull() | (F.col("_was") != F.col(flag)), "_run")
    span = out.groupBy(*keys, "_run").agg((F.max(time) - F.min(time)).alias("_span"))
    long = out.join(span, [*keys, "_run"])
    return long.select(*df.columns, (F.col(flag) & (F.col("_span") >= F.lit(min_span))).alias(name))


def median_of_three(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Each reading replaced by the median of itself and its neighbours (kept at the edges)."""
    v = F.col(value)
    out = previous(previous(df, keys, order, {"_a": v}), keys, order, {"_z": v}, following=True)
    mid = F.array_sort(F.array("_a", v, "_z"))[1]
    return out.select(*df.columns, F.when(F.col("_a").isNull() | F.col("_z").isNull(), v).otherwise(mid).alias(name))


def per_second_median(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    return df.groupBy(*keys, F.floor(time).alias("second")).agg(F.percentile(value, F.lit(0.5)).alias(value))


def downsample(df: DataFrame, keys: Sequence[str], time: str, every: float, columns: Sequence[str]) -> DataFrame:
    """The first reading of every ``every`` units."""
    slot = F.floor(F.col(time) / F.lit(every)).alias("slot")
    return (df.groupBy(*keys, slot).agg(F.min_by(F.struct(time, *columns), time).alias("_r"))
            .select(*keys, "slot", f"_r.{time}", *[f"_r.{c}" for c in columns]))


def resets(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, high: float, low: float,
           name: str) -> DataFrame:
    """Running count of resets: a fall from ``high`` or more to ``low`` or less that the next reading confirms."""
    v = F.col(value)
    out = previous(previous(df, keys, order, {"_a": v}), keys, order, {"_z": v}, following=True)
    fall = (F.col("_a") >= high) & (v <= low) & (F.col("_z") <= low)
    return running(out, keys, order, {name: ("sum", F.when(F.coalesce(fall, F.lit(False)), 1).otherwise(0).cast("long"))}).drop("_a", "_z")


def segment_by_quiet(hits: DataFrame, keys: Sequence[str], time: str, quiet: float, name: str = "segment", tie: Sequence[str] = ()) -> DataFrame:
    """Number segments of hits: a new one begins after ``quiet`` without a hit; ``tie`` orders hits of one time."""
    out = previous(hits, keys, [time, *tie], {"_pt": F.col(time)})
    return islands(out, keys, [time, *tie], F.col("_pt").isNull() | (F.col(time) - F.col("_pt") > F.lit(quiet)), name).drop("_pt")


def trades(samples: DataFrame, key: str, time: str, me: str, them: str, distance: str, others: str,
           close: float, drop: float, quiet: float, end_at: float, minions: Sequence[str] = (),
           opening: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Exchanges between two lane opponents from a series of health readings.

    A hit is a reading where either side falls by ``drop`` or more from its previous reading; a trade opens
    on a hit while close, goes on with every hit until ``quiet`` passed without one, and compares what both
    lost. A hit opens a new trade if the reading just before it already came ``quiet`` after the last hit.
    ``tie`` orders readings of one time.
    """
    keys, order = [key], [time, *tie]
    s = samples.where(F.col(time) <= end_at)
    s = previous(s.where(F.col(me).isNotNull() & F.col(them).isNotNull()), keys, order,
                 {"_pm": F.col(me), "_po": F.col(them), "_pt": F.col(time)})
    lost_me, lost_them = F.col("_pm") - F.col(me), F.col("_po") - F.col(them)
    hit = F.coalesce((lost_me >= drop) | (lost_them >= drop), F.lit(False))
    s = s.withColumn("_hit", hit).withColumn("_lm", F.greatest(lost_me, F.lit(0))).withColumn("_lo", F.greatest(lost_them, F.lit(0)))
    s = running(s, keys, order, {"_last_hit": ("max", F.when(F.col("_hit"), F.col(time)))}, strict=True)
    fresh = F.col("_last_hit").isNull() | (F.col("_pt") - F.col("_last_hit") >= F.lit(quiet))
    hits = islands(s.where("_hit"), keys, order, fresh, "trade")
    place = F.struct(*[F.col(c) for c in order])
    first = lambda c: F.min_by(c, place)
    out = hits.groupBy(key, "trade").agg(
        first(F.col("_pt")).alias("start_s"), F.max(time).alias("end_s"), first(F.col(distance) <= close).alias("_near"),
        F.sum("_lm").alias("me_lost"), F.sum("_lo").alias("opponent_lost"),
        first(F.when((F.col("_lm") >= drop) & (F.col("_lo") >= drop), "both").when(F.col("_lo") >= drop, "you")
              .otherwise("opponent")).alias("started_by"),
        (F.max(others) > 0).alias("skirmish"),
        *([first(F.col(minions[0]) - F.col(minions[1])).alias("minion_edge")] if minions else []),
        *[first(F.col(c)).alias(c) for c in opening])
    gap = F.col("opponent_lost") - F.col("me_lost")
    out = out.where(F.col("_near")).drop("_near")
    return out.withColumn("result", F.when(gap >= drop, "won").when(gap <= -drop, "lost").otherwise("even"))


def consequences(trades_: DataFrame, deaths: DataFrame, bases: DataFrame, keys: Sequence[str], end: str, at: str,
                 died_within: float, back_within: float) -> DataFrame:
    """After each trade: died soon, and how soon back in base."""
    out = look_ahead(trades_, deaths.select(*keys, F.col(at).alias("_d")), keys, end, "_d", died_within, {"_dt": "_d"}, "died")
    out = look_ahead(out.drop("_dt"), bases.select(*keys, F.col(at).alias("_b")), keys, end, "_b", back_within, {"_bt": "_b"}, "_back")
    return out.withColumn("back_after_s", F.when(F.col("_back"), F.col("_bt") - F.col(end))).drop("_back", "_bt")


# -- health drops ------------------------------------------------------------------------------

def health_drops(samples: DataFrame, key: str, time: str, health: str, dead: str, tie: Sequence[str] = (), share: float = 0.2,
                 within: float = 15.0, quiet: float = 3.0) -> DataFrame:
    """Health drops per recording: key, start_t, end_t, lost, low.

    A drop starts at the reading before a fall while alive. It goes on for ``within`` from there and ends at
    the first reading that is dead, later than that, or ``quiet`` after the last fall without a new one; the
    next one can start behind it. Drops of at least ``share`` count, a recording's last reading ends its last.

    No drop is open at a reading with no fall in the ``within`` before it, so recordings are cut there and a
    piece, folded in time order inside one row, is as long as falls follow each other and no longer.
    """
    order = [time, *tie]
    s = samples.where(F.col(health).isNotNull()).select(key, *order, F.col(health).cast("double").alias("_h"), F.coalesce(F.col(dead), F.lit(False)).alias("_d"))
    s = previous(s, [key], order, {"_ph": F.col("_h")})
    s = running(s, [key], order, {"_fall": ("max", F.when(~F.col("_d") & (F.col("_h") < F.col("_ph")), F.col(time)))})
    rest = F.coalesce(F.col(time) - F.col("_fall") > F.lit(within), F.lit(True))
    s = islands(s, [key], order, rest, "_piece")
    # A resting reading closes the piece before it and begins its own.
    s = s.select(key, F.explode(F.when(rest, F.array(F.col("_piece") - 1, F.col("_piece"))).otherwise(F.array("_piece"))).alias("_piece"),
                 F.struct(*[F.col(c) for c in order], F.col("_h").alias("h"), F.col("_d").alias("dead")).alias("_r"))
    drop = "struct<start_t: double, end_t: double, lost: double, low: double>"
    none = F.lit(None).cast("double")
    state = F.struct(F.lit(False).alias("on"), *[none.alias(n) for n in ("start", "peak", "last", "low", "h", "t")], F.array().cast(f"array<{drop}>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        t, h = r[time].cast("double"), r["h"]
        fall = F.coalesce(~r["dead"] & (h < a["h"]), F.lit(False))
        opens = ~a["on"] & fall
        start, peak, last = F.when(opens, a["t"]).otherwise(a["start"]), F.when(opens, a["h"]).otherwise(a["peak"]), F.when(fall, t).otherwise(a["last"])
        low = F.least(h, F.when(opens, a["h"]).otherwise(a["low"]))
        ends = (a["on"] & (r["dead"] | (t - a["start"] > within) | (~fall & (t - a["last"] >= quiet)))) | (opens & (t - a["t"] > within))
        found = F.when(F.coalesce(ends, F.lit(False)) & (peak - low >= share), F.array(_drop(start, t, peak, low))).otherwise(F.array().cast(f"array<{drop}>"))
        return F.struct(((a["on"] | opens) & ~F.coalesce(ends, F.lit(False))).alias("on"), start.alias("start"), peak.alias("peak"), last.alias("last"), low.alias("low"),
                        h.alias("h"), t.alias("t"), F.concat(a["out"], found).alias("out"))

    def finish(a: Column) -> Column:
        return F.concat(a["out"], F.when(a["on"] & (a["peak"] - a["low"] >= share), F.array(_drop(a["start"], a["t"], a["peak"], a["low"]))).otherwise(F.array().cast(f"array<{drop}>")))

    pieces = s.groupBy(key, "_piece").agg(F.array_sort(F.collect_list("_r")).alias("_rs")).where(F.size("_rs") > 1)
    return pieces.select(key, F.explode(F.aggregate("_rs", state, step, finish)).alias("_x")).select(key, "_x.*")


def _drop(start: Column, end: Column, peak: Column, low: Column) -> Column:
    return F.struct(start.alias("start_t"), end.alias("end_t"), (peak - low).alias("lost"), low.alias("low"))


def drop_outcomes(drops: DataFrame, deaths: DataFrame, recalls: DataFrame, key: str, at: str,
                  death_within: float = 20.0, recall_within: float = 60.0) -> DataFrame:
    """What a drop led to, counted from its start: death, recall, or stayed."""
    out = _soon(drops, deaths, key, "start_t", at, death_within, "_died")
    out = _soon(out, recalls, key, "start_t", at, recall_within, "_left")
    return out.withColumn("outcome", F.when(F.col("_died"), "death").when(F.col("_left"), "recall").otherwise("stayed")).drop("_died", "_left")


def _soon(df: DataFrame, events: DataFrame, key: str, time: str, at: str, within: float, name: str) -> DataFrame:
    """Whether an event comes at ``time`` or up to ``within`` after it."""
    out = asof(df, events.select(key, F.col(at).cast("double").alias("_e")), [key], time, "_e", {}, direction="forward", matched_time="_next")
    return out.withColumn(name, F.coalesce(F.col("_next") - F.col(time) <= F.lit(within), F.lit(False))).drop("_next")


def bursts(samples: DataFrame, key: str, time: str, health: str, dead: str, tie: Sequence[str] = (), high: float = 0.6, look: float = 10.5, burst: float = 3.0) -> DataFrame:
    """Deaths with the health ``look`` before, the time since the last reading at ``high`` or more, and whether that is a burst."""
    order = [time, *tie]
    s = samples.where(F.col(health).isNotNull()).select(key, *order, F.col(health).cast("double").alias("_h"), F.coalesce(F.col(dead), F.lit(False)).alias("_d"))
    s = previous(s, [key], order, {"_was": F.col("_d")})
    died = s.where(F.col("_d") & (F.col("_was") == F.lit(False))).withColumn("_from", F.col(time) - F.lit(look))
    first = asof(died, s.select(key, F.col(time).alias("_t1"), F.col("_h").alias("_v")), [key], "_from", "_t1", {"_before": "_v"}, direction="forward", matched_time="_bt")
    high_at = s.where(F.col("_h") >= high).select(key, F.col(time).alias("_t2"))
    out = asof(first, high_at, [key], time, "_t2", {}, strict=True, matched_time="_ht")
    near = F.when(F.col("_ht") >= F.col("_from"), F.col(time) - F.col("_ht"))
    seen = F.col("_bt") < F.col(time)
    return out.select(key, *order, F.when(seen, F.col("_before")).otherwise(0.0).alias("before"), near.alias("from_high"), F.coalesce(near <= burst, F.lit(False)).alias("burst"))


def state_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Rows where a flag turns true (deaths in a series of dead / alive readings)."""
    out = previous(df, keys, order, {"_was": F.col(flag)})
    return out.where(F.col(flag) & ~F.coalesce(F.col("_was"), F.lit(False))).drop("_was")


def spaced(df: DataFrame, key: str, time: str, apart: float) -> DataFrame:
    """Greedy thinning in time order: keep a row if the last kept one is at least ``apart`` before it.

    A gap of ``apart`` or more always starts anew, so it opens a cluster whose first row is kept. Inside a
    cluster the row kept after another is the first one at least ``apart`` later: these links are found by
    one as-of, and what the first rows reach is found by doubling them. A round squares the links, so a key
    of any density takes as many joins as its longest chain has binary digits, and no list is gathered.
    """
    rows = df.select(key, time).where(F.col(time).isNotNull()).distinct()
    t = previous(rows, [key], [time], {"_pt": F.col(time)})
    t = islands(t, [key], [time], F.col("_pt").isNull() | (F.col(time) - F.col("_pt") >= F.lit(apart)), "_c")
    t = asof(t.withColumn("_from", F.col(time) + F.lit(apart)), t.select(key, F.col(time).alias("_then"), F.col("_c").alias("_there")), [key], "_from", "_then",
             {"_in": "_there"}, direction="forward", matched_time="_next")
    first = F.col("_pt").isNull() | (F.col(time) - F.col("_pt") >= F.lit(apart))
    t = written(t.select(key, time, first.alias("_first"), F.when(F.col("_in") == F.col("_c"), F.col("_next")).alias("_next")), "links")
    kept = t.where("_first").select(key, time)
    links = t.where("_next IS NOT NULL").select(key, F.col(time).alias("_at"), "_next")
    while not links.isEmpty():
        on = lambda a, b: (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{a}") == F.col(f"b.{b}"))
        reached = kept.alias("a").join(links.alias("b"), on(time, "_at")).select(f"a.{key}", F.col("b._next").alias(time))
        kept = written(kept.unionByName(reached), "kept")
        links = written(links.alias("a").join(links.alias("b"), on("_next", "_at")).select(f"a.{key}", "a._at", F.col("b._next").alias("_next")), "links")
    return kept


def recalls(samples: DataFrame, key: str, time: str, health: str, gold: str, items: str, dead: str, tie: Sequence[str] = (), opening: float = 90.0, respawned: float = 20.0,
            trip: float = 45.0, look: float = 15.0, channel: float = 9.0) -> DataFrame:
    """Trips home: (key, time, health, gold) of the first purchase of each.

    A purchase (``items`` differ from the reading before) counts while alive, after the ``opening`` and not
    within ``respawned`` after coming back from death; purchases less than ``trip`` after a counted one
    belong to it. Health is read before the channel: the first reading between ``look`` and ``channel``
    before; gold is the most held in the ``look`` before. Without such readings it is the reading before.
    """
    order = [time, *tie]
    s = samples.where(F.col(health).isNotNull()).select(key, *order, F.col(health).cast("double").alias("_h"), F.col(gold).cast("double").alias("_g"), F.col(items).alias("_i"), F.coalesce(F.col(dead), F.lit(False)).alias("_d"))
    s = previous(s, [key], order, {"_b": F.struct("_h", "_g", "_i", "_d")})
    back = s.where(F.col("_b._d") & ~F.col("_d")).select(key, F.col(time).alias("_up"))
    bought = s.where(F.col("_b").isNotNull() & ~F.col("_d") & (F.col(time) >= opening) & ~F.col("_i").eqNullSafe(F.col("_b._i")))
    bought = asof(bought, back, [key], time, "_up", {}, matched_time="_since")
    bought = written(bought.where(F.col("_since").isNull() | (F.col(time) - F.col("_since") > respawned)), "bought")
    trips = spaced(bought, key, time, trip)
    c = bought.join(trips, [key, time], "left_semi")
    c = top_per_group(c, [key, time], [F.col(x) for x in order[1:]] or [F.col(time)], 1)
    c = asof(c.withColumn("_from", F.col(time) - F.lit(look)), s.select(key, F.col(time).alias("_t1"), *tie, F.col("_h").alias("_hv")), [key], "_from", "_t1", {"_first": "_hv"},
             direction="forward", matched_time="_ft", tie=list(tie))
    at = F.col(time).cast("double").alias("_at")  # whole times would count the present reading
    seen = s.select(key, time, at, "_g", F.lit(False).alias("_ask")).unionByName(c.select(key, time, at, F.lit(None).cast("double").alias("_g"), F.lit(True).alias("_ask")))
    most = rolling_range(seen, [key], "_at", look, {"_most": F.max("_g")}, back_to=0.001).where("_ask").select(key, time, "_most")
    c = c.join(most, [key, time])
    early = F.col("_ft") <= F.col(time) - F.lit(channel)
    return c.select(key, time, F.when(early, F.col("_first")).otherwise(F.col("_b._h")).alias("health"), F.coalesce("_most", F.col("_b._g")).alias("gold"))


# A slot is ready at this share of its own bright readings, of which it needs so many.
READY_SHARE, READY_SEEN = 0.6, 20
READY_EDGE = 1e-9  # a value on the border counts as ready, however the percentile is interpolated


def slot_ready(readings: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, share: float = READY_SHARE, seen: int = READY_SEEN) -> DataFrame:
    """Whether a slot is ready at each reading: its value reaches ``share`` of its own 90th percentile.

    ``ready`` is null without a value or with fewer than ``seen`` of them; ``confirmed`` says that the slot's
    reading with a value before this one was ready as well. Percentiles are exact for slots of any size.
    """
    keys = list(keys)
    some = readings.where(F.col(value).isNotNull())
    counts = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    q = grouped_quantiles(some, keys, value, {"_bright": 0.9}).select(*keys, "_bright").join(counts, keys)
    d = readings.join(dimension(q), keys, "left")
    ready = F.when(F.col("_n") >= seen, F.col(value) >= F.lit(share) * F.col("_bright") - READY_EDGE)
    d = d.withColumn("ready", ready)
    d = running(d, keys, order, {"_was": ("last", F.col("ready"))}, strict=True)
    return d.withColumn("confirmed", F.when(F.col("ready").isNotNull(), F.col("ready") & F.coalesce("_was", F.lit(False)))).drop("_n", "_bright", "_was")


# -- sources ------------------------------------------------------------------------------------------

def clock_offsets(readings: DataFrame, key: str, time: str, clock: str, tolerance: float = 1.5, half: float = 0.5) -> DataFrame:
    """How far a source's clock is from its time: key, offset, agreement (share of all readings with a clock near the commonest distance).

    The commonest whole distance is found by counts; the offset is the exact median of those within
    ``tolerance`` of it. A clock of whole seconds is ``half`` a second behind on average. Of equally common distances the smallest counts.
    """
    d = readings.select(key, (F.col(clock) + half - F.col(time)).cast("double").alias("_d"))
    tally = d.where("_d IS NOT NULL").groupBy(key, F.round("_d").cast("long").alias("_whole")).agg(F.count(F.lit(1)).alias("_n"))
    mode = dimension(tally.groupBy(key).agg(F.max_by("_whole", F.struct("_n", -F.col("_whole"))).alias("_mode")))
    near = d.join(mode, key).where(F.abs(F.col("_d") - F.col("_mode")) <= tolerance)
    total = d.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    found = near.groupBy(key).agg(F.percentile("_d", F.lit(0.5)).alias("offset"), F.count(F.lit(1)).alias("_near")).join(total, key)
    return found.select(key, "offset", (F.col("_near") / F.col("_all")).alias("agreement"))


def covered(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """How long a key's spans cover together: key, covered, pieces. Overlaps count once: a span opens a piece where nothing before it reaches."""
    s = spans.where(F.col(end) > F.col(start)).select(key, F.col(start).alias("_a"), F.col(end).alias("_z")).distinct()
    s = running(s, [key], ["_a", "_z"], {"_reach": ("max", F.col("_z"))}, strict=True)
    new = F.col("_reach").isNull() | (F.col("_a") > F.col("_reach"))
    added = F.greatest(F.col("_z") - F.greatest(F.col("_a"), F.coalesce("_reach", F.col("_a"))), F.lit(0))
    return s.groupBy(key).agg(F.sum(added).alias("covered"), F.count(F.when(new, 1)).alias("pieces"))


# What a source must have to be learned from, and the trading range.
LANE_MINUTES, COVERAGE, CLOCK, TRADE_RANGE = 5.0, 0.4, 0.5, 0.35


def source_problems(samples: DataFrame, sources: DataFrame, trades: DataFrame, key: str, trade_range: float = TRADE_RANGE, far: float = 3.0) -> DataFrame:
    """What speaks against each source: minutes, coverage (share of samples with the own bar), in_range, trades, problems[], warnings[].

    ``samples``: key, t (seconds), me, distance; ``sources``: key, agreement, role; ``trades``: key. A rate of trades
    above Q3 + ``far`` times the quartile distance of the good sources is a warning where there are at least eight of them.
    """
    per = samples.groupBy(key).agg(((F.max("t") - F.min("t")) / 60).alias("minutes"), F.avg(F.col("me").isNotNull().cast("double")).alias("coverage"), F.count(F.when(F.col("distance") <= trade_range, 1)).alias("in_range"))
    n = trades.groupBy(key).agg(F.count(F.lit(1)).alias("trades"))
    d = sources.join(per, key, "left").join(n, key, "left").withColumns({"minutes": F.coalesce("minutes", F.lit(0.0)), "coverage": F.coalesce("coverage", F.lit(0.0)), "in_range": F.coalesce("in_range", F.lit(0)), "trades": F.coalesce("trades", F.lit(0))})
    told = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in pairs]), lambda x: x.isNotNull())
    d = d.withColumn("problems", told((F.col("minutes") < LANE_MINUTES, "short"), (F.col("coverage") < COVERAGE, "bar unread"), (F.col("agreement") < CLOCK, "clock uncertain"), (F.col("in_range") == 0, "never in range")))
    ok = (F.size("problems") == 0) & (F.col("minutes") > 0)
    d = written(d.withColumn("_rate", F.when(ok, F.col("trades") / F.col("minutes") * 10)), "sources")
    q = d.agg(F.percentile("_rate", F.lit(0.25)).alias("_q1"), F.percentile("_rate", F.lit(0.75)).alias("_q3"), F.count("_rate").alias("_n"))
    d = d.crossJoin(F.broadcast(q))
    high = (F.col("_n") >= 8) & (F.col("_rate") > F.col("_q3") + far * (F.col("_q3") - F.col("_q1")))
    return d.withColumn("warnings", told((F.col("role").isNull(), "role unknown"), ((F.col("trades") == 0) & (F.col("in_range") > 0), "no trades"), (high, "too many trades"))).select(
        key, "minutes", "coverage", "in_range", "trades", "problems", "warnings")
