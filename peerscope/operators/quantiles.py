"""Exact continuous percentiles per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import hot_keys, hot_rows, mark_hot


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                      min_n: int = 1) -> DataFrame:
    """n, mean, sd and exact percentiles of ``value`` per group; nulls in ``value`` are ignored.

    Ordinary groups use ``percentile``, which buffers a group's distinct values. Groups above the hot
    limit are solved by ``_bracketed`` instead, which is exact too.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    hot = hot_keys(rows, keys)
    if hot is None:
        return _plain(rows, keys, value, probs).where(F.col("n") >= min_n)
    marked = mark_hot(rows, hot, None)
    cold = _plain(marked.where(~F.col("_is_hot")), keys, value, probs)
    big = _bracketed(marked.where("_is_hot"), keys, value, probs, hot_rows(df))
    return cold.unionByName(big).where(F.col("n") >= min_n)


def counted_quantiles(counts: DataFrame, keys: Sequence[str], value: str, times: str, probs: dict[str, float],
                      min_n: int = 1) -> DataFrame:
    """``grouped_quantiles`` of values that stand for ``times`` rows each: the buffers get a value once, not once a row.

    Groups with more distinct values than the hot limit are spread out into rows again for ``_bracketed``.
    """
    keys = list(keys)
    hot = hot_keys(counts, keys)
    if hot is None:
        return _weighted(counts, keys, value, times, probs).where(F.col("n") >= min_n)
    marked = mark_hot(counts, hot, None)
    cold = _weighted(marked.where(~F.col("_is_hot")), keys, value, times, probs)
    rows = marked.where("_is_hot").select(*keys, value, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias("_i")).drop("_i")
    big = _bracketed(rows, keys, value, probs, hot_rows(counts))
    return cold.unionByName(big).where(F.col("n") >= min_n)


def _weighted(counts, keys, value, times, probs):
    v, c = F.col(value).cast("double"), F.col(times)
    q = F.percentile(v, F.array(*[F.lit(p) for p in probs.values()]), c)
    agg = counts.groupBy(*keys).agg(F.sum(c).alias("n"), (F.sum(v * c) / F.sum(c)).alias("mean"), q.alias("_q"))
    # Squares are summed around the mean, in a second pass: the difference of two sums of squares would lose digits.
    means = agg.select(*[F.col(k).alias(f"_m_{k}") for k in keys], F.col("mean").alias("_mean"))
    off = counts.join(means, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys])
    sds = off.groupBy(*[F.col(f"_m_{k}") for k in keys]).agg(
        F.when(F.sum(c) > 1, F.sqrt(F.sum(c * (v - F.col("_mean")) * (v - F.col("_mean"))) / (F.sum(c) - 1))).otherwise(F.lit(0.0)).alias("sd"))
    return agg.join(sds, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]).select(
        *keys, "n", "mean", "sd", *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])


def _moments(value: str):
    return [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")]


def _plain(rows, keys, value, probs):
    q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in probs.values()]))
    agg = rows.groupBy(*keys).agg(*_moments(value), q.alias("_q"))
    return agg.select(*keys, "n", "mean", "sd", *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])


def _bracketed(rows, keys, value, probs, at_least, accuracy: int = 10_000):
    """Exact percentiles without gathering a group.

    A sketch gives, for every percentile, a low and a high value that surely enclose it (its rank error
    is at most n / accuracy). One more pass counts what lies below the bracket and keeps only the distinct
    values inside, a few ten-thousandths of the group; the wanted ranks are read off those.
    """
    # Beyond the sketch's error the bracket also takes in two ranks either side; groups have > at_least rows.
    slack = max(3.0 / accuracy, 1.0 / accuracy + 4.0 / at_least)
    v = F.col(value).cast("double")
    names, ps = list(probs), list(probs.values())
    bounds = [min(1.0, max(0.0, p + d)) for p in ps for d in (-slack, slack)]
    sketch = rows.groupBy(*keys).agg(
        *_moments(value), F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.percentile_approx(v, F.array(*[F.lit(b) for b in bounds]), F.lit(accuracy)).alias("_b"))
    brackets = sketch.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys], "n", "mean", "sd",
        F.array(*[F.struct(
            F.lit(i).alias("i"), F.lit(p).alias("p"),
            (F.col("_min") if bounds[2 * i] == 0.0 else F.col("_b")[2 * i]).alias("lo"),
            (F.col("_max") if bounds[2 * i + 1] == 1.0 else F.col("_b")[2 * i + 1]).alias("hi"))
            for i, p in enumerate(ps)]).alias("_brackets"))
    # The sketch is used once: each row is mapped to below / inside / above in the same pass.
    placed = (
        rows.select(*keys, v.alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
        .alias("r").join(F.broadcast(brackets), [F.col(f"r.{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys])
        .select(*[F.col(f"r.{k}").alias(k) for k in keys], "n", "mean", "sd", "_v", "_c",
                F.explode("_brackets").alias("_x"))
        .select(*keys, "n", "mean", "sd", F.col("_x.i").alias("_i"), F.col("_x.p").alias("_p"),
                F.when(F.col("_v") < F.col("_x.lo"), F.lit(0)).when(F.col("_v") <= F.col("_x.hi"), F.lit(1))
                .otherwise(F.lit(2)).alias("_zone"), "_v", "_c")
        .where(F.col("_zone") < 2)
        .groupBy(*keys, "n", "mean", "sd", "_i", "_p", "_zone",
                 F.when(F.col("_zone") == 1, F.col("_v")).alias("_v"))
        .agg(F.sum("_c").alias("_c")))
    w = Window.partitionBy(*keys, "_i").orderBy("_zone", F.col("_v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_upto", F.sum("_c").over(w))
    at = F.col("_p") * (F.col("n") - 1)
    low, high = F.floor(at), F.ceil(at)
    pick = lambda r: F.min(F.when((F.col("_zone") == 1) & (F.col("_upto") > r), F.col("_v")))
    found = (ranked.withColumn("_at", at).groupBy(*keys, "n", "mean", "sd", "_i", "_at")
             .agg(pick(low).alias("_a"), pick(high).alias("_z")))
    q = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    return (found.withColumn("_q", q).groupBy(*keys, "n", "mean", "sd")
            .agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]))
