"""Joins: opponent pairing, as-of, interval and fallback lookups, pair statistics.

Counting joins (events in a window, intervals covering a moment) are written as differences of running
totals, never as matched pairs, so their cost is linear whatever the overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running, top_per_group
from .scale import HotKeys


def opponents(df: DataFrame, match: str, role: str, team: str, values: dict[str, str],
              how: str = "inner") -> DataFrame:
    """Each row with its opponent's values: the other side's row of the same role, if there is exactly one.

    The other side is reduced to one cell per (match, role, team) before the join.
    """
    known = df.where(F.col(role).isNotNull() & (F.col(role).cast("string") != ""))
    cells = (known.groupBy(match, role, team)
             .agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(n) for n, c in values.items()])
             .where("_n = 1").drop("_n")
             .select(F.col(match).alias("_m"), F.col(role).alias("_r"), F.col(team).alias("_t"), *values))
    on = (df[match] == cells["_m"]) & (df[role] == cells["_r"]) & (df[team] != cells["_t"])
    return df.join(cells, on, how).drop("_m", "_r", "_t")


def minute_difference(minutes: DataFrame, pairs: DataFrame, match: str, who: str, opponent: str,
                      minute: str, metrics: Sequence[str]) -> DataFrame:
    """Minute rows with ``<metric>_diff`` to the opponent's row of the same minute (null without one)."""
    other = minutes.select(F.col(match).alias("_m"), F.col(who).alias("_w"), F.col(minute).alias("_t"),
                           *[F.col(c).alias(f"_{c}") for c in metrics])
    mine = minutes.join(pairs.select(match, who, opponent), [match, who], "left")
    on = (mine[match] == other["_m"]) & (mine[opponent] == other["_w"]) & (mine[minute] == other["_t"])
    joined = mine.join(other, on, "left")
    return joined.select(*[mine[c] for c in mine.columns],
                         *[(mine[c] - other[f"_{c}"]).alias(f"{c}_diff") for c in metrics])


def in_scope(df: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(scope.select(*keys).distinct(), list(keys), "left_semi")


def pending(source: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` without a current result."""
    return source.join(done.select(*keys), list(keys), "left_anti")


def null_safe_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]],
                   how: str = "inner") -> DataFrame:
    """Equi join in which null equals null (minute null = whole game)."""
    on = None
    for a, b in pairs:
        part = left[a].eqNullSafe(right[b])
        on = part if on is None else on & part
    return left.join(right, on, how)


def _stacked(left, right, keys, left_time, right_time, values, right_low, tie):
    """Both sides as one sequence per key; left rows keep their columns beside them, one by one, so that those
    nobody reads are never shuffled.

    At equal times the right row sorts below the left one if ``right_low``, right rows by ``tie``.
    """
    right_side = 0 if right_low else 1
    types = dict(right.dtypes)
    carried = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1 - right_side).alias("_side"),
                    *[F.col(c).alias(f"_l_{c}") for c in carried],
                    *[F.lit(None).cast(types[c]).alias(f"_r_{n}") for n, c in values.items()],
                    F.lit(None).cast(types[right_time]).alias("_rt"), *[F.lit(None).cast(types[c]).alias(f"_tie{i}") for i, c in enumerate(tie)])
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(right_side).alias("_side"),
                     *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in carried],
                     *[F.col(c).alias(f"_r_{n}") for n, c in values.items()], F.col(right_time).alias("_rt"),
                     *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)])
    return a.unionByName(b)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
         values: dict[str, str], direction: str = "backward", strict: bool = False,
         matched_time: str | None = None, kinds: dict[str, str] | None = None, tie: Sequence[str] | None = None,
         hot: HotKeys | None | str = "measure") -> DataFrame:
    """Left rows with the values of the nearest right row at or before (after) their time.

    Of right rows with equal times the one with the largest (forward: the smallest) ``tie`` columns counts;
    without ``tie`` these are the columns looked up, so the result never depends on the partitioning.

    One shuffle of the union and one running scan, and no shuffle if both sides are dealt by ``keys`` already; with
    ``kinds`` the values are running totals of the right rows ("sum", "count", "max", "min") instead of the last one.
    ``strict`` leaves equal times out. ``hot`` as in ``running``.
    """
    keys, kinds = list(keys), kinds or {}
    backward = direction == "backward"
    # The scan must meet a right row of the same time before the left row, unless strict.
    if tie is None:
        tie = [c for n, c in values.items() if kinds.get(n, "last") == "last"]
    both = _stacked(left, right, keys, left_time, right_time, values, backward != strict, tie)
    is_right = F.col("_side") == (0 if backward != strict else 1)
    boxed = lambda c: F.when(is_right, F.struct(F.col(c).alias("v")))
    wanted = {}
    for n in values:
        kind = kinds.get(n, "last")
        wanted[n] = (kind, boxed(f"_r_{n}") if kind == "last" else F.col(f"_r_{n}"))
    if matched_time:
        wanted[matched_time] = ("last", boxed("_rt"))
    out = running(both, keys, ["_t", "_side", *(f"_tie{i}" for i in range(len(tie)))], wanted, reverse=not backward, hot=hot).where(~is_right)
    cols = [F.col(c) if c in keys else F.col(f"_l_{c}").alias(c) for c in left.columns]
    for n, (kind, _) in wanted.items():
        cols.append((F.col(f"{n}.v") if kind == "last" else F.col(n)).alias(n))
    return out.select(*cols)


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
                 values: dict[str, str], tolerance: float, gap: str = "gap") -> DataFrame:
    """The nearest right row within ``tolerance`` (times are numbers); the earlier one on a tie."""
    back = asof(left, right, keys, left_time, right_time,
                {f"_b_{n}": c for n, c in values.items()}, matched_time="_bt")
    both = asof(back, right, keys, left_time, right_time,
                {f"_f_{n}": c for n, c in values.items()}, direction="forward", matched_time="_ft")
    t = F.col(left_time)
    db, df_ = t - F.col("_bt"), F.col("_ft") - t
    use_back = db.isNotNull() & (df_.isNull() | (db <= df_))
    near = F.when(use_back, db).otherwise(df_)
    ok = near <= F.lit(tolerance)
    return both.select(
        *left.columns,
        *[F.when(ok, F.when(use_back, F.col(f"_b_{n}")).otherwise(F.col(f"_f_{n}"))).alias(n) for n in values],
        F.when(ok, near).alias(gap))


def on_grid(left: DataFrame, frames: DataFrame, keys: Sequence[str], left_ms: str, minute: str,
            last_minute: str, values: Sequence[str]) -> DataFrame:
    """As-of on an exact minute grid: an equi join on the last whole minute, at most ``last_minute``."""
    at = F.least(F.floor(F.col(left_ms) / 60000), F.col(last_minute)).cast("int")
    right = frames.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(minute).alias("_minute"), *values)
    l = left.withColumn("_at", at)
    on = l["_at"] == right["_minute"]
    for k in keys:
        on = on & (l[k] == right[f"_{k}"])
    return l.join(right, on, "left").drop("_at", "_minute", *[f"_{k}" for k in keys])


def nearest_link(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, left_time: str,
                 right_id: str, right_time: str, within: float) -> DataFrame:
    """Each left row's nearest right row within ± ``within`` of it; ties go to the smaller right id.

    Solved by two as-of scans instead of a range join, so crowded moments make no pairs.
    """
    r = right.groupBy(*keys, right_time).agg(F.min(right_id).alias(right_id))
    out = asof_nearest(left, r, keys, left_time, right_time, {right_id: right_id}, within, "distance")
    return out.where(F.col(right_id).isNotNull())


def window_totals(windows: DataFrame, events: DataFrame, keys: Sequence[str], start: str, end: str,
                  time: str, totals: dict[str, str]) -> DataFrame:
    """Sums of event columns over (start, end] per window row, as a difference of running sums."""
    at_end = asof(windows, events, keys, end, time, {f"_e_{n}": c for n, c in totals.items()},
                  kinds={f"_e_{n}": "sum" for n in totals})
    both = asof(at_end, events, keys, start, time, {f"_s_{n}": c for n, c in totals.items()},
                kinds={f"_s_{n}": "sum" for n in totals})
    zero = F.lit(0)
    return both.select(*windows.columns, *[
        (F.coalesce(F.col(f"_e_{n}"), zero) - F.coalesce(F.col(f"_s_{n}"), zero)).alias(n) for n in totals])


def active_at(moments: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, start: str,
              until: str, name: str = "active", weight: Column | None = None) -> DataFrame:
    """How many intervals [start, until) cover each moment: starts so far minus ends so far."""
    w = (weight if weight is not None else F.lit(1)).cast("long")
    edges = intervals.select(*keys, F.explode(F.array(
        F.struct(F.col(start).alias("_at"), w.alias("_step")),
        F.struct(F.col(until).alias("_at"), (-w).alias("_step")))).alias("_e")).select(
            *keys, F.col("_e._at").alias("_at"), F.col("_e._step").alias("_step"))
    out = asof(moments, edges, keys, time, "_at", {name: "_step"}, kinds={name: "sum"})
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def look_ahead(moments: DataFrame, events: DataFrame, keys: Sequence[str], time: str, event_time: str,
               horizon: float, values: dict[str, str], label: str) -> DataFrame:
    """Does an event start within ``horizon`` after each moment, and the first one's values."""
    out = asof(moments, events, keys, time, event_time, values, direction="forward", strict=True,
               matched_time="_next")
    hit = F.coalesce(F.col("_next") - F.col(time) <= F.lit(horizon), F.lit(False))
    return out.select(*moments.columns, hit.alias(label),
                      *[F.when(hit, F.col(n)).alias(n) for n in values])


def pair_records(df: DataFrame, match: str, team: str, who: str, win: str) -> DataFrame:
    """(who, other, together) records: games and wins of every pair seen in a match.

    A match is first reduced to its distinct (team, who), so a match with many rows adds at most one pair
    per result row.
    """
    seats = df.groupBy(match, team, who).agg(F.max(F.col(win).cast("int")).alias("_w"))
    other = seats.select(F.col(match).alias("_m"), F.col(team).alias("_t"), F.col(who).alias("other"))
    pairs = seats.join(other, (seats[match] == other["_m"]) & (seats[who] != other["other"]))
    return (pairs.groupBy(F.col(who), "other", (F.col(team) == F.col("_t")).alias("together"))
            .agg(F.count(F.lit(1)).alias("games"), F.sum("_w").alias("wins")))


def series_offsets(a: DataFrame, b: DataFrame, keys: Sequence[str], second: str, value_a: str, value_b: str,
                   max_offset: int, min_overlap: int) -> DataFrame:
    """Per key, the offset (a.second - b.second) at which two series agree best.

    Equi join on (key, shifted second): every reading is copied once per tried offset, and the errors are
    combined before the shuffle.
    """
    shifted = b.select(*[F.col(k).alias(f"_{k}") for k in keys],
                       F.explode(F.sequence(F.lit(-max_offset), F.lit(max_offset))).alias("offset"),
                       F.col(second).alias("_s"), F.col(value_b).alias("_b"))
    on = a[second] == shifted["_s"] + shifted["offset"]
    for k in keys:
        on = on & (a[k] == shifted[f"_{k}"])
    err = (a.join(shifted, on).groupBy(*[a[k] for k in keys], "offset")
           .agg(F.count(F.lit(1)).alias("overlap"), F.round(F.avg(F.abs(F.col(value_a) - F.col("_b"))), 6).alias("error"))
           .where(F.col("overlap") >= min_overlap))
    return top_per_group(err, keys, [F.col("error"), F.abs("offset"), F.col("offset")], 1)


def best_tracking_slot(df: DataFrame, keys: Sequence[str], slot: str, value: str, target: str,
                       min_points: int, max_error: float) -> DataFrame:
    """Which slot's series follows the target best, given enough common points and a small error."""
    err = (df.where(F.col(value).isNotNull() & F.col(target).isNotNull()).groupBy(*keys, slot)
           .agg(F.count(F.lit(1)).alias("points"), F.round(F.avg(F.abs(F.col(value) - F.col(target))), 6).alias("error"))
           .where((F.col("points") >= min_points) & (F.col("error") <= max_error)))
    return top_per_group(err, keys, [F.col("error"), F.col(slot)], 1)


def likely_pick(df: DataFrame, role: str, pick: str, min_share: float) -> DataFrame:
    """For an unmatched slot: the pick most often seen in the role, if its share is above the threshold."""
    counts = df.groupBy(role, pick).agg(F.count(F.lit(1)).alias("games"))
    totals = counts.groupBy(role).agg(F.sum("games").alias("role_games"))
    shares = counts.join(totals, role).withColumn("share", F.col("games") / F.col("role_games"))
    return top_per_group(shares.where(F.col("share") > min_share), [role], [F.col("games").desc(), F.col(pick)], 1)


def fallback_baselines(needs: DataFrame, baselines: DataFrame, effects: DataFrame, lanes: DataFrame,
                       tier_order: Sequence[str], own_min_n: int, role_min_n: int,
                       lead_metrics: Sequence[str] = (), max_distance: int = 1) -> DataFrame:
    """The comparison group of every (tier, role, champion, opponent, metric, minute).

    Tried in order: the champion at the tier (n >= ``own_min_n``), the role at the tier, then the role at
    tiers up to ``max_distance`` away, the one below before the one above. Role rows are moved by the
    champion's stored effect; lane leads skip the champion's own row and are moved by the two champions'
    lane strengths instead. ``needs`` should be distinct; pass the sources through ``dimension`` first.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in tier_order]), F.col("tier"))
    quant = ["mean", "p10", "p25", "p50", "p75", "p90"]
    base = baselines.select(
        F.col("role").alias("_role"), F.col("champion").alias("_champion"), F.col("metric").alias("_metric"),
        F.col("minute").alias("_minute"), F.col("tier").alias("_tier"), rank.alias("_rank"),
        "n", "sd", *quant)
    lead = F.col("metric").isin(*lead_metrics) if lead_metrics else F.lit(False)
    asked = needs.withColumn("_my_rank", rank)
    minute0 = F.coalesce(F.col("minute"), F.lit(0))
    side = lambda who, tag: lanes.select(
        F.col("role").alias(f"_{tag}r"), F.col("champion").alias(f"_{tag}c"), F.col("metric").alias(f"_{tag}m"),
        F.col("minute").alias(f"_{tag}t"), F.col("strength").alias(f"_{tag}s"), F.col("n").alias(f"_{tag}n"))
    for who, tag in (("champion", "me"), ("opponent", "op")):
        asked = asked.join(side(who, tag), (F.col("role") == F.col(f"_{tag}r"))
                           & (F.col(who) == F.col(f"_{tag}c")) & (F.col("metric") == F.col(f"_{tag}m"))
                           & (minute0 == F.col(f"_{tag}t")) & lead, "left")
    e = effects.select(F.col("role").alias("_er"), F.col("champion").alias("_ec"), F.col("metric").alias("_em"),
                       F.col("minute").alias("_et"), "effect", F.col("n").alias("_en"))
    asked = asked.join(e, (F.col("role") == F.col("_er")) & (F.col("champion") == F.col("_ec"))
                       & (F.col("metric") == F.col("_em")) & (minute0 == F.col("_et")), "left")
    matchup = F.col("opponent").isNotNull() & lead & (F.col("_mes").isNotNull() | F.col("_ops").isNotNull())
    # One candidate row per tier distance; the role's rows are the join key, so the work is linear in needs.
    cand = asked.join(base, (F.col("role") == F.col("_role")) & (F.col("metric") == F.col("_metric"))
                      & F.col("minute").eqNullSafe(F.col("_minute"))
                      & ((F.col("_champion") == "*") | (F.col("_champion") == F.col("champion")))
                      & (F.abs(F.col("_rank") - F.col("_my_rank")) <= max_distance))
    own = F.col("_champion") != "*"
    step = F.col("_rank") - F.col("_my_rank")
    priority = (F.when(own, 0).when(step == 0, 1).otherwise(F.abs(step) * 2 + (step > 0).cast("int"))).cast("int")
    usable = F.when(own, (step == 0) & ~matchup & (F.col("n") >= max(own_min_n, role_min_n))).otherwise(
        F.col("n") >= role_min_n)
    shift = (F.when(own, F.lit(0.0))
             .when(matchup, F.coalesce("_mes", F.lit(0.0)) - F.coalesce("_ops", F.lit(0.0)))
             .otherwise(F.coalesce(F.col("effect") * F.col("sd"), F.lit(0.0))))
    source = (F.when(own, "champion").when(matchup, "matchup")
              .when(F.col("effect").isNotNull(), "adjusted").otherwise("role"))
    keys = ["tier", "role", "champion", "opponent", "metric", "minute"]
    choice = F.struct(priority.alias("priority"), F.col("_tier").alias("from_tier"), source.alias("source"),
                      F.col("n").alias("n"), F.col("sd").alias("sd"),
                      *[(F.col(q) + shift).alias(q) for q in quant])
    best = cand.where(usable).groupBy(*keys).agg(F.min(choice).alias("_b"))
    return best.select(*keys, "_b.from_tier", "_b.source", "_b.n", "_b.sd", *[f"_b.{q}" for q in quant])
