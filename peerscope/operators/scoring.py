"""Score every record against its comparison group, and read findings off the scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import goodness, percentile_in, zscore
from .joins import fallback_baselines
from .ordered import numbered, top_per_group
from .scale import dimension

GROUP = ["tier", "role", "champion", "opponent", "metric", "minute"]


def score_games(long: DataFrame, catalogue: DataFrame, baselines: DataFrame, effects: DataFrame,
                lanes: DataFrame, tier_order: Sequence[str], own_min_n: int = 200, role_min_n: int = 20,
                lead_metrics: Sequence[str] = (), max_distance: int = 1) -> DataFrame:
    """Long metric rows with baseline, percentile, goodness and z; ``source`` is null where none applies.

    ``long`` has the GROUP columns (opponent and minute may be null), ``value`` and any keys. The fallback
    runs once per distinct group, then facts meet its result in one join.
    """
    # The catalogue is one row a metric; of unknown size it would be merged, all rows of a metric in one task.
    judged = long.join(F.broadcast(catalogue), "metric").where(~F.array_contains("skip_roles", F.col("role"))).drop("skip_roles")
    needs = judged.select(*GROUP).distinct()
    chosen = dimension(fallback_baselines(needs, baselines, effects, lanes, tier_order, own_min_n, role_min_n,
                                          lead_metrics, max_distance))
    right = chosen.select(*[F.col(c).alias(f"_{c}") for c in GROUP], "from_tier", "source", "n", "sd",
                          "mean", "p10", "p25", "p50", "p75", "p90")
    on = None
    for c in GROUP:
        part = judged[c].eqNullSafe(right[f"_{c}"])
        on = part if on is None else on & part
    out = judged.join(right, on, "left").drop(*[f"_{c}" for c in GROUP])
    p = percentile_in("value", "p10", "p25", "p50", "p75", "p90", "sd")
    return (out.withColumn("percentile", F.when(F.col("source").isNotNull(), p))
            .withColumn("goodness", goodness("percentile", "higher_is_better"))
            .withColumn("z", F.when(F.col("source").isNotNull(), zscore("value", "mean", "sd"))))


def missing_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics without any comparison group, per game."""
    return (scored.where(F.col("source").isNull()).groupBy(*keys)
            .agg(F.array_sort(F.collect_set("metric")).alias("missing")))


def game_score(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One game in one number: mean goodness over its coachable whole-game metrics."""
    return (scored.where(F.col("coachable") & F.col("minute").isNull() & F.col("goodness").isNotNull())
            .groupBy(*keys).agg(F.avg("goodness").alias("score"), F.count(F.lit(1)).alias("metrics")))


def sustained_runs(curves: DataFrame, keys: Sequence[str], minute: str, value: str, low: float = 25.0,
                   high: float = 75.0, length: int = 4) -> DataFrame:
    """Runs of at least ``length`` consecutive minutes at or below ``low`` (or at or above ``high``)."""
    kind = F.when(F.col(value) <= low, "weak").when(F.col(value) >= high, "strong")
    marked = curves.withColumn("kind", kind).where(F.col("kind").isNotNull())
    # Consecutive minutes of one kind share minute - row number.
    placed = numbered(marked, [*keys, "kind"], [minute], "_rn").withColumn("_island", F.col(minute) - F.col("_rn"))
    return (placed.groupBy(*keys, "kind", "_island")
            .agg(F.min(minute).alias("first_minute"), F.max(minute).alias("last_minute"),
                 F.count(F.lit(1)).alias("minutes"), F.avg(value).alias("mean_value"))
            .where(F.col("minutes") >= length).drop("_island"))


def findings(scored: DataFrame, keys: Sequence[str], low: float = 25.0, high: float = 75.0, total: int = 8,
             per_area: int = 2, tie: Sequence[str] = ()) -> DataFrame:
    """The most telling scores of a game: at most two an area and eight in all, farthest from 50 first."""
    strength = F.round(F.abs(F.col("goodness") - 50), 4)
    kind = F.when(F.col("goodness") <= low, "weakness").when(F.col("goodness") >= high, "strength")
    cand = (scored.where(F.col("coachable")).withColumn("kind", kind).where(F.col("kind").isNotNull())
            .withColumn("weight", strength))
    order = [F.col("weight").desc(), F.col("metric"), *[F.col(c) for c in tie]]
    capped = top_per_group(cand, [*keys, "area"], order, per_area)
    return top_per_group(capped, keys, order, total, rank="position")


def death_priority(deaths: DataFrame, keys: Sequence[str], order: Sequence, k: int = 6) -> DataFrame:
    """A game's top deaths to look at: ahead in gold first, then early ones, then in order."""
    return top_per_group(deaths, keys, list(order), k, rank="position")


