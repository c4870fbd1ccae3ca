"""Running values over ordered rows of a key, for keys of any size.

``running`` is the one primitive behind sessions, streaks, as-of joins, forward fills and "everything
before this row". For ordinary keys it is a window. A key above the hot limit is cut into ranges of the
order column; each range is scanned on its own and starts from what one summary row per earlier range
carries over, so no task ever holds the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import HotKeys, hot_keys, mark_hot

KINDS = ("sum", "count", "max", "min", "last", "first", "last_row")


def _over(kind: str, value: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "count":
        return F.count(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    if kind in ("last", "last_row"):
        return F.last(value, ignorenulls=True)
    return F.first(value, ignorenulls=True)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.when(local.isNull(), carry).when(carry.isNull(), local).otherwise(local + carry)
    if kind == "count":
        return local + F.coalesce(carry, F.lit(0))
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    if kind in ("last", "last_row"):
        return F.coalesce(local, carry)
    return F.coalesce(carry, local)


def _sorted(order: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            values: dict[str, tuple[str, Column]], strict: bool = False, reverse: bool = False,
            hot: HotKeys | None | str = "measure") -> DataFrame:
    """Add running values. ``values`` maps a new name to (kind, column).

    Kinds: sum, count, max, min, last and first (non-null). ``strict`` leaves the current row out,
    ``reverse`` runs from the end. ``order`` must end in a unique column. ``last_row`` is the previous
    row's value even if it is null (used by ``previous``).
    """
    keys, order = list(keys), list(order)
    wrapped = {n: (k, F.struct(c.alias("v")) if k == "last_row" else c) for n, (k, c) in values.items()}
    if hot == "measure":
        hot = hot_keys(df, keys, order[0])
    end = -1 if strict else Window.currentRow
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*_sorted(order, reverse)).rowsBetween(
            Window.unboundedPreceding, end)
        out = df.select("*", *[_over(k, c).over(w).alias(n) for n, (k, c) in wrapped.items()])
    else:
        out = _running_in_chunks(df, keys, order, wrapped, end, reverse, hot)
    for n, (k, _) in values.items():
        if k == "last_row":
            out = out.withColumn(n, F.col(n)["v"])
    return out


def _running_in_chunks(df, keys, order, wrapped, end, reverse, hot):
    tagged = df.select("*", *[c.alias(f"_v_{n}") for n, (_, c) in wrapped.items()])
    tagged = mark_hot(tagged, hot, order[0])
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*_sorted(order, reverse)).rowsBetween(
        Window.unboundedPreceding, end)
    local = tagged.select("*", *[_over(k, F.col(f"_v_{n}")).over(inner).alias(f"_l_{n}")
                                 for n, (k, _) in wrapped.items()])
    # One summary row per range of a hot key; ordered kinds take the range's outermost row.
    place = F.struct(*[F.col(c) for c in order])
    pick_last, pick_first = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)
    parts = []
    for n, (k, _) in wrapped.items():
        v = F.col(f"_v_{n}")
        if k in ("last", "last_row"):
            parts.append(pick_last(v, F.when(v.isNotNull(), place)).alias(f"_s_{n}"))
        elif k == "first":
            parts.append(pick_first(v, F.when(v.isNotNull(), place)).alias(f"_s_{n}"))
        else:
            parts.append(_over(k, v).alias(f"_s_{n}"))
    summary = tagged.where("_is_hot").groupBy(*keys, "_chunk").agg(*parts)
    before = Window.partitionBy(*keys).orderBy(
        F.col("_chunk").desc() if reverse else F.col("_chunk").asc()).rowsBetween(
            Window.unboundedPreceding, -1)
    again = {"count": "sum"}
    carry = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"),
        *[_over(again.get(k, k), F.col(f"_s_{n}")).over(before).alias(f"_c_{n}")
          for n, (k, _) in wrapped.items()])
    on = local["_chunk"] == carry["_k_chunk"]
    for k in keys:
        on = on & local[k].eqNullSafe(carry[f"_k_{k}"])
    joined = local.join(carry, on, "left")
    return joined.select(*df.columns, *[
        _combine(k, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (k, _) in wrapped.items()])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
             steps: int = 1, following: bool = False, hot: HotKeys | None | str = "measure") -> DataFrame:
    """The value of the row ``steps`` before (or after) in the key's order, null at the edge."""
    out = df
    for i in range(steps):
        source = values if i == 0 else {n: F.col(f"_p{i - 1}_{n}") for n in values}
        names = {f"_p{i}_{n}" if i < steps - 1 else n: ("last_row", c)
                 for (n, c) in source.items()}
        out = running(out, keys, order, names, strict=True, reverse=following, hot=hot)
    return out.drop(*[f"_p{i}_{n}" for i in range(steps - 1) for n in values])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
             reverse: bool = False) -> DataFrame:
    """Row number from 1 within the key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, reverse=reverse)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column,
            name: str = "run") -> DataFrame:
    """Number the runs of a key: a row where ``starts`` is true opens a new one."""
    return running(df, keys, order,
                   {name: ("sum", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0).cast("long"))})


def rolling_range(df: DataFrame, keys: Sequence[str], time: str, span: float,
                  values: dict[str, Column], bucket: float | None = None,
                  back_to: float = 0.0) -> DataFrame:
    """Aggregates over the rows of the last ``span`` units of ``time`` (a number), current row included.

    Rows are cut into time buckets and each bucket also receives the rows of the one before that are
    still in reach, so a key's history is spread over many tasks and the copies stay below span/bucket.
    """
    # Range frames need whole numbers: fractional times are taken in thousandths.
    scale = 1 if dict(df.dtypes)[time] in ("int", "bigint", "smallint") else 1000
    span, width = int(round(span * scale)), int(round((bucket or span * 64) * scale))
    t = F.round(F.col(time) * scale).cast("long")
    home = F.floor(t / width).cast("long")
    reach = F.when(t >= (home + 1) * F.lit(width) - F.lit(span), F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_home", home).withColumn("_bucket", F.explode(reach))
    w = Window.partitionBy(*keys, "_bucket").orderBy(t).rangeBetween(-span, -int(round(back_to * scale)))
    return (spread.select("*", *[c.over(w).alias(n) for n, c in values.items()])
            .where(F.col("_home") == F.col("_bucket")).drop("_home", "_bucket"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group. Spark cuts each map task's rows to k per group before the
    shuffle (window group limit), so a hot group costs k rows per task."""
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)
