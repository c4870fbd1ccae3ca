"""Many logistic fits in one pass each: folds, bags by game, learning curves and cross-fitted calibration.

A fit is a set of row weights. ``newton`` solves all fits of a list together: every step is one aggregation
of the gradients and second derivatives per fit (combined before the shuffle), and only those few numbers
reach the driver. So k folds, b bags or s shares of the games cost no more passes than one model does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import logit
from .evaluation import log_loss
from .scale import written

STEPS = 8
RIDGE = 1e-6
SHARES = (0.25, 0.5, 0.75, 1.0)
ENOUGH = 30  # rows of each outcome that a calibration needs


def draw(group: Column, seed: str) -> Column:
    """A number in [0, 1) of a group, the same in every run and engine: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), group.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32


def fold_of(group: Column, k: int, seed: str = "fold") -> Column:
    return F.floor(draw(group, seed) * k).cast("int")


def bag_times(group: Column, bag: int, seed: str = "bag", most: int = 6) -> Column:
    """How often a game is in a bag: Poisson of mean 1 by its draw, so that no resampled copies are made (cut at ``most``, one in 12,000)."""
    u, times, below, term = draw(group, f"{seed}{bag}"), F.lit(0), 0.0, float(np.exp(-1.0))
    for k in range(1, most + 1):
        below += term
        term /= k
        times = times + (u >= below).cast("int")
    return times


def equal_games(df: DataFrame, group: str, name: str = "weight", boost: Column | None = None) -> DataFrame:
    """Row weights with which every game counts the same (times its ``boost``), averaging 1."""
    n = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    raw = (boost if boost is not None else F.lit(1.0)) / F.col("_n")
    d = df.join(n, F.col(group) == F.col("_g")).withColumn("_raw", raw.cast("double"))
    total = d.agg((F.sum("_raw") / F.count(F.lit(1))).alias("_mean"))
    return d.crossJoin(F.broadcast(total)).withColumn(name, F.col("_raw") / F.col("_mean")).drop("_g", "_n", "_raw", "_mean")


def _dot(beta: Column, xs: Sequence[Column]) -> Column:
    z = beta[0]
    for i, x in enumerate(xs, 1):
        z = z + beta[i] * x
    return z


@dataclass(frozen=True)
class Fits:
    """Coefficients (offset first) of each fit, in order."""

    names: tuple
    beta: np.ndarray

    def chance(self, at: Column, xs: Sequence[Column]) -> Column:
        """The chance by fit number ``at``."""
        table = F.array(*[F.array(*[F.lit(float(b)) for b in row]) for row in self.beta])
        return 1 / (1 + F.exp(-_dot(F.element_at(table, at + 1), xs)))


def newton(df: DataFrame, features: Sequence[Column], label: str, fits: dict[object, Column], steps: int = STEPS, ridge: float = RIDGE) -> Fits:
    """Weighted logistic regressions, one for each weight column of ``fits``, by ``steps`` Newton steps of one pass each.

    ``ridge`` holds the slopes (not the offset) back. A fit without rows, or with one outcome only, stays near
    the best it can be: a step that can't be solved is left out.
    """
    xs = [f"_x{i}" for i in range(len(features))]
    rows = written(df.select(F.col(label).cast("double").alias("_y"), *[x.cast("double").alias(n) for x, n in zip(features, xs, strict=True)],
                             F.array(*[F.coalesce(w.cast("double"), F.lit(0.0)) for w in fits.values()]).alias("_w")), "fits")
    one = [F.lit(1.0), *[F.col(x) for x in xs]]
    d = len(one)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    beta = np.zeros((len(fits), d))
    per = rows.select("_y", *xs, F.posexplode("_w").alias("_k", "_v")).where("_v > 0")
    for _ in range(steps):
        p = Fits(tuple(fits), beta).chance(F.col("_k"), one[1:])
        scored = per.withColumn("_p", p)
        miss, bend = F.col("_v") * (F.col("_y") - F.col("_p")), F.col("_v") * F.col("_p") * (1 - F.col("_p"))
        sums = scored.groupBy("_k").agg(*[F.sum(miss * one[i]).alias(f"g{i}") for i in range(d)], *[F.sum(bend * one[i] * one[j]).alias(f"h{i}_{j}") for i, j in pairs]).collect()
        for r in sums:
            k, h = r["_k"], np.zeros((d, d))
            for i, j in pairs:
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            slopes = np.r_[0.0, np.full(d - 1, ridge)]
            g = np.array([r[f"g{i}"] for i in range(d)]) - slopes * beta[k]
            h += np.diag(slopes)
            if np.linalg.cond(h) < 1e14:
                beta[k] = beta[k] + np.linalg.solve(h, g)
    return Fits(tuple(fits), beta)


def out_of_fold(df: DataFrame, features: Sequence[Column], label: str, group: str, k: int = 3, weight: str | None = None, name: str = "p", **fit) -> DataFrame:
    """Chances of rows whose game the fit has not seen, all folds fitted together; adds ``fold``."""
    d = df.withColumn("fold", fold_of(F.col(group), k))
    w = F.col(weight) if weight else F.lit(1.0)
    fits = newton(d, features, label, {i: F.when(F.col("fold") != i, w) for i in range(k)}, **fit)
    return d.withColumn(name, fits.chance(F.col("fold"), features))


def cross_fitted(df: DataFrame, p: str, label: str, k: int, weight: str | None = None, name: str = "calibrated", fold: str = "fold") -> DataFrame:
    """Each fold's chances calibrated by a curve fitted on the other folds; unchanged where these have too few of an outcome."""
    w = F.col(weight) if weight else F.lit(1.0)
    counts = df.groupBy(fold).agg(F.sum(F.col(label).cast("long")).alias("yes"), F.count(F.lit(1)).alias("n")).collect()
    yes, n = {r[fold]: r["yes"] for r in counts}, {r[fold]: r["n"] for r in counts}
    rest = lambda of, i: sum(v for f, v in of.items() if f != i)
    able = [i for i in range(k) if min(rest(yes, i), rest(n, i) - rest(yes, i)) >= ENOUGH]
    fits = newton(df, [logit(p)], label, {i: F.when(F.col(fold) != i, w) for i in range(k)})
    return df.withColumn(name, F.when(F.col(fold).isin(able), fits.chance(F.col(fold), [logit(p)])).otherwise(F.col(p)))


def weighted_loss(df: DataFrame, p: str, label: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*keys).agg((F.sum(w * log_loss(F.col(p), F.col(label).cast("double"))) / F.sum(w)).alias("loss"), F.count(F.lit(1)).alias("n"))


def competing(oof: DataFrame, families: dict[str, str], label: str, k: int, weight: str | None = None) -> DataFrame:
    """Held-out loss of each family and of their blend (the mean chance), all calibrated across folds first: candidate, loss, best.

    ``oof``: rows with ``fold`` and each family's out-of-fold chance in the named column.
    """
    d = oof.withColumn("_blend", sum((F.col(c) for c in families.values()), F.lit(0.0)) / len(families))
    names = {**families, "blend": "_blend"}
    for n, c in names.items():
        d = cross_fitted(d, c, label, k, weight, f"_cal_{n}")
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    one = d.agg(*[(F.sum(w * log_loss(F.col(f"_cal_{n}"), y)) / F.sum(w)).alias(n) for n in names])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(n).alias("loss")) for n in names])).alias("_c")).select("_c.*")
    best = rows.agg(F.min_by("candidate", F.struct("loss", "candidate")).alias("_best"))
    return rows.crossJoin(F.broadcast(best)).withColumn("best", F.col("candidate") == F.col("_best")).drop("_best")


def learning_curve(df: DataFrame, features: Sequence[Column], label: str, group: str, k: int = 3, shares: Sequence[float] = SHARES, weight: str | None = None) -> DataFrame:
    """Held-out loss when only a share of each fold's training games is used: share, train_games, loss, base_loss.

    Games join by their draw, so a larger share holds the smaller ones' games. All shares and folds are
    fitted together, then calibrated across folds like the heads; the base is the training games' mean outcome.
    """
    d = df.withColumn("fold", fold_of(F.col(group), k)).withColumn("_u", draw(F.col(group), "share"))
    w = F.col(weight) if weight else F.lit(1.0)
    cells = [(s, i) for s in range(len(shares)) for i in range(k)]
    inside = {(s, i): (F.col("fold") != i) & (F.col("_u") < shares[s]) for s, i in cells}
    fits = newton(d, features, label, {c: F.when(cond, w) for c, cond in inside.items()})
    y = F.col(label).cast("double")
    facts = d.agg(*[F.struct((F.sum(F.when(cond, w * y)) / F.sum(F.when(cond, w))).alias("base"), F.count_distinct(F.when(cond, F.col(group))).alias("games")).alias(f"c{s}_{i}") for (s, i), cond in inside.items()])
    base = facts.first()
    out = None
    for s, share in enumerate(shares):
        at = F.lit(s * k) + F.col("fold")
        held = d.withColumn("p", fits.chance(at, features)).withColumn("_base", F.element_at(F.array(*[F.lit(base[f"c{s}_{i}"]["base"]) for i in range(k)]), F.col("fold") + 1))
        held = cross_fitted(held, "p", label, k, weight)
        row = held.agg(F.lit(share).alias("share"), F.lit(float(np.mean([base[f"c{s}_{i}"]["games"] for i in range(k)]))).alias("train_games"),
                       *[(F.sum(w * log_loss(F.col(c), y)) / F.sum(w)).alias(n) for c, n in (("calibrated", "loss"), ("_base", "base_loss"))])
        out = row if out is None else out.unionByName(row)
    return out


def bagged(df: DataFrame, features: Sequence[Column], label: str, group: str, bags: int = 5, weight: str | None = None, seed: str = "bag") -> Fits:
    """An ensemble fitted on games resampled with replacement (Poisson weights), all bags in the same passes."""
    w = F.col(weight) if weight else F.lit(1.0)
    return newton(df, features, label, {b: w * bag_times(F.col(group), b, seed) for b in range(bags)})


def bagged_chance(df: DataFrame, fits: Fits, features: Sequence[Column], name: str = "p") -> DataFrame:
    """Mean and spread of the bags' chances: ``name``, ``name``_low and ``name``_high."""
    each = F.array(*[fits.chance(F.lit(b), features) for b in range(len(fits.names))])
    d = df.withColumn("_each", each)
    mean = F.aggregate("_each", F.lit(0.0), lambda a, x: a + x) / len(fits.names)
    return d.withColumns({name: mean, f"{name}_low": F.array_min("_each"), f"{name}_high": F.array_max("_each")}).drop("_each")


def by_role(oof: DataFrame, p: str, base: str, label: str, group: str, role: str, weight: str | None = None) -> DataFrame:
    """The held-out score within each role that has at least two games: games, situations, loss, base_loss, better."""
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    mean = lambda c: F.sum(w * log_loss(F.col(c), y)) / F.sum(w)
    d = oof.where(F.col(role).isNotNull()).groupBy(role).agg(F.count_distinct(group).alias("games"), F.count(F.lit(1)).alias("situations"), mean(p).alias("loss"), mean(base).alias("base_loss"))
    return d.where("games >= 2").withColumn("better", F.col("loss") < F.col("base_loss"))
