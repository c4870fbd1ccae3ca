"""Percentile baselines per group, champion effects and lane strength."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import patch_key
from .ordered import top_per_group
from .quantiles import counted_quantiles, grouped_quantiles
from .scale import dimension, written

PROBS = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
ALL = "*"


def newest_patches(games: DataFrame, patch: str, k: int) -> DataFrame:
    """The k newest patches in numeric order; a table of k rows."""
    seen = games.where(F.col(patch).isNotNull()).select(patch).distinct()
    return seen.orderBy(patch_key(patch).desc()).limit(k)


def patch_window(patches: DataFrame, patch: str) -> DataFrame:
    """One row: the window's label, oldest-newest."""
    key = patch_key(patch)
    return patches.agg(F.min_by(patch, key).alias("first"), F.max_by(patch, key).alias("last")).select(
        F.when(F.col("first") == F.col("last"), F.col("first"))
        .otherwise(F.concat_ws("-", "first", "last")).alias("patch_window"))


# The ranked queue, and games too short to say anything (seconds).
QUEUE, SHORTEST = 420, 600


def baseline_source(games: DataFrame, samples: DataFrame, patches: DataFrame, include_player: bool = False, queue: int = QUEUE, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``games`` that baselines are made of, with the tier their match was sampled at.

    ``games``: match_id, queue, patch, duration_s, role, ..; ``samples``: match_id, tier, source. Counted are
    ranked games of the window's ``patches`` that lasted at least ``shortest`` seconds, of players whose role is
    known, from matches sampled by the crawl (a player's own games only if asked for). A match that was
    sampled twice counts once for each tier.
    """
    wanted = samples if include_player else samples.where("source = 'crawl'")
    rows = games.where((F.col("queue") == queue) & (F.col("duration_s") >= shortest) & (F.coalesce("role", F.lit("")) != ""))
    rows = rows.join(F.broadcast(patches.select("patch").distinct()), "patch", "left_semi")  # a window of a few patches
    return rows.join(wanted.select("match_id", "tier").distinct(), "match_id")


def explode_metrics(games: DataFrame, metrics: str, keep: Sequence[str]) -> DataFrame:
    """A {name: number} map as long rows (metric, value)."""
    return games.select(*keep, F.explode(F.col(metrics)).alias("metric", "value"))


def unpivot_metrics(rows: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns as long rows (metric, value); nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    long = rows.select(*keep, F.explode(pairs).alias("_x"))
    return long.select(*keep, "_x.metric", "_x.value").where(F.col("value").isNotNull())


def build_baselines(long: DataFrame, tier: str, role: str, champion: str, minute: str | None = None,
                    min_n: int = 20, digits: int = 6) -> DataFrame:
    """Distribution rows per (tier, role, champion, metric[, minute]) and, with champion '*', per role.

    Both levels come from one pass: equal values of a champion are counted once, and each count goes to its two groups.
    """
    keyed = long.select(F.col(tier).alias("tier"), F.col(role).alias("role"), F.col(champion).alias("champion"),
                        "metric", (F.col(minute) if minute else F.lit(None)).cast("int").alias("minute"), "value")
    keys = ["tier", "role", "champion", "metric", "minute"]
    counts = keyed.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_times"))
    counts = written(counts, "counts")  # read for the hot groups, the percentiles and the deviations
    # Expanding counts to both levels lets one percentile aggregation, and one hot-group check, serve both.
    both = counts.withColumn("champion", F.explode(F.array(F.col("champion").cast("string"), F.lit(ALL))))
    out = counted_quantiles(both, keys, "value", "_times", PROBS, min_n)
    return out.select("tier", "role", "champion", "metric", "minute", "n", F.round("mean", digits).alias("mean"),
                      F.round("sd", digits).alias("sd"), *[F.round(q, digits).alias(q) for q in PROBS])


def approximate_baselines(long: DataFrame, keys: Sequence[str], value: str = "value", accuracy: int = 10_000,
                          min_n: int = 20) -> DataFrame:
    """Sketch-based variant for exploration; the method is named in the output."""
    q = F.percentile_approx(value, F.array(*[F.lit(p) for p in PROBS.values()]), F.lit(accuracy))
    agg = long.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("_q"))
    return agg.where(F.col("n") >= min_n).select(
        *keys, "n", "mean", *[F.col("_q")[i].alias(p) for i, p in enumerate(PROBS)],
        F.lit("approximate").alias("method"))


def lane_strength(long: DataFrame, role: str, champion: str, minute: str | None = None,
                  shrink: float = 50.0) -> DataFrame:
    """A champion's shrunken mean lead over its opponents: sum / (n + shrink); minute 0 = whole game."""
    m = F.coalesce(F.col(minute), F.lit(0)) if minute else F.lit(0)
    return (long.groupBy(F.col(role).alias("role"), F.col(champion).alias("champion"), "metric",
                         m.cast("int").alias("minute"))
            .agg(F.count("value").alias("n"), (F.sum("value") / (F.count("value") + F.lit(shrink))).alias("strength")))


def champion_effects(baselines: DataFrame, min_n: int = 50, gate: float = 2.0, shrink: float = 100.0,
                     digits: int = 6) -> DataFrame:
    """How far a champion's median sits from its role's, in role standard deviations, pooled over tiers.

    Effects within ``gate`` standard errors of a median (1.25/sqrt n) are dropped, the rest shrunk.
    """
    own = baselines.where(F.col("champion") != ALL)
    role = baselines.where((F.col("champion") == ALL) & (F.col("sd") > 0)).select(
        F.col("tier").alias("_t"), F.col("role").alias("_r"), F.col("metric").alias("_m"),
        F.col("minute").alias("_mi"), F.col("p50").alias("_p50"), F.col("sd").alias("_sd"))
    joined = own.join(role, (F.col("tier") == F.col("_t")) & (F.col("role") == F.col("_r"))
                      & (F.col("metric") == F.col("_m")) & F.col("minute").eqNullSafe(F.col("_mi")))
    n = F.sum("n")
    pooled = (joined.groupBy("role", "champion", "metric", F.coalesce("minute", F.lit(0)).alias("minute"))
              .agg((F.sum(F.col("n") * (F.col("p50") - F.col("_p50")) / F.col("_sd")) / n).alias("_raw"), n.alias("n")))
    return (pooled.where((F.col("n") >= min_n) & (F.abs("_raw") >= gate * 1.25 / F.sqrt("n")))
            .select("role", "champion", "metric", "minute",
                    F.round(F.col("_raw") * F.col("n") / (F.col("n") + shrink), digits).alias("effect"), "n"))


def rebuild(df: DataFrame, path: str, log_path: str, build_id: int, label: str) -> DataFrame:
    """Atomic rebuild: write the build under its own id, then append one row to the build log.

    Readers join through the log (``current``), so a half-written build is never seen.
    """
    df.write.parquet(f"{path}/build_id={build_id}")
    stored = df.sparkSession.read.parquet(f"{path}/build_id={build_id}")
    entry = stored.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(build_id).cast("long").alias("build_id"), F.lit(label).alias("label"), "rows")
    entry.write.mode("append").parquet(log_path)
    return stored


def current(spark, path: str, log_path: str) -> DataFrame:
    """The newest logged build."""
    newest = spark.read.parquet(log_path).agg(F.max("build_id")).first()[0]
    return spark.read.parquet(f"{path}/build_id={newest}")


def rank_benchmarks(long: DataFrame, tier: str, role: str) -> DataFrame:
    """p20 / p50 / p80 of each rate per (tier, role) and per role over all tiers ('ALL')."""
    both = long.select(F.explode(F.array(F.col(tier), F.lit("ALL"))).alias("tier"), F.col(role).alias("role"),
                       "metric", "value")
    out = grouped_quantiles(both, ["tier", "role", "metric"], "value", {"p20": 0.2, "p50": 0.5, "p80": 0.8})
    return out.select("tier", "role", "metric", "n", "p20", "p50", "p80")


def role_stats(builds: DataFrame, newest: Sequence[Column], games: int = 50, least: int = 5, digits: int = 6) -> DataFrame:
    """Each player's numbers over the ``games`` newest build rows in a role: player, role, games, metric, value.

    Rates are totals over total time, kill participation the mean of the games. Fewer than ``least`` games say nothing.
    """
    rows = top_per_group(builds.where(F.coalesce(F.col("role").cast("string"), F.lit("")) != ""), ["player", "role"], newest, games)
    minutes = F.sum("duration_s") / 60.0
    part = (F.col("kills") + F.col("assists")) / F.greatest(F.col("team_kills"), F.lit(1))
    wide = rows.groupBy("player", "role").agg(
        F.count(F.lit(1)).alias("games"), (F.sum("cs") / minutes).alias("cs_min"), (F.sum("damage") / minutes).alias("dmg_min"), (F.sum("vision") / minutes).alias("vision_min"),
        F.avg(part).alias("kp"), (F.sum("deaths") / (minutes / 10.0)).alias("deaths_10")).where(F.col("games") >= least)
    long = unpivot_metrics(wide, ["player", "role", "games"], ["cs_min", "dmg_min", "vision_min", "kp", "deaths_10"])
    return long.withColumn("value", F.round("value", digits))


def ranks_matched(stats: DataFrame, benchmarks: DataFrame, tiers: Sequence[str], lower_is_better: Sequence[str] = ("deaths_10",)) -> DataFrame:
    """The highest tier whose median each number reaches (``like``, null below all), how many it reaches, and the medians it was held against.

    A role's medians of one metric travel as one array in tier order, so a number stays one row and the join is
    as wide as the roles are many.
    """
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")).cast("int")
    known = benchmarks.where(F.col("tier").isin(*tiers) & F.col("p50").isNotNull())
    ladder = known.groupBy("role", "metric").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "tier", "p50"))).alias("ladder"))
    low = F.col("metric").isin(*lower_is_better)
    rows = stats.join(dimension(ladder), ["role", "metric"])
    met = F.filter("ladder", lambda t: F.when(low, F.col("value") <= t["p50"]).otherwise(F.col("value") >= t["p50"]))
    return rows.withColumn("_met", met).select(*stats.columns, F.get("_met", F.size("_met") - 1)["tier"].alias("like"), F.size("_met").alias("n_met"), "ladder")


def next_steps(matched: DataFrame, own: DataFrame, lower_is_better: Sequence[str] = ("deaths_10",), digits: int = 6) -> DataFrame:
    """The number furthest, in relation, from the median of the tier above the player's own: player, role, next, metric, value, wanted, gap.

    ``own``: player, tier. Players at the top, or who reach every median of the next tier, have no row; of equal gaps the later name counts.
    """
    rows = matched.join(own.select("player", "tier"), "player")
    places = F.transform("ladder", lambda t: t["tier"])
    above = F.get("ladder", F.array_position(places, F.col("tier")).cast("int"))  # positions count from 1, so this is the one after
    rows = rows.where(F.array_contains(places, F.col("tier"))).withColumn("_next", above)
    short = F.when(F.col("metric").isin(*lower_is_better), F.col("value") - F.col("_next.p50")).otherwise(F.col("_next.p50") - F.col("value"))
    gap = F.round(short / F.abs("_next.p50"), digits)
    rows = rows.where((short > 0) & (F.col("_next.p50") != 0)).withColumn("gap", gap)
    best = rows.groupBy("player", "role").agg(F.max(F.struct("gap", "metric", "value", F.col("_next.p50").alias("wanted"), F.col("_next.tier").alias("next"))).alias("_b"))
    return best.select("player", "role", "_b.next", "_b.metric", "_b.value", "_b.wanted", "_b.gap")
