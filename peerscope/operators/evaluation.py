"""Quality of predictions: log loss, Brier, AUC with ties, calibration, bootstrap, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running
from .scale import written

EPS = 1e-7


def log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def auc(df: DataFrame, p: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the curve, ties counted half, without ranking rows one by one.

    Rows are first counted per distinct (rounded) score; a running count of the positives and negatives below
    each score then gives the area. The scan over scores is cut into ranges where it is long.
    """
    keys = list(keys)
    c = df.withColumn("_s", F.round(F.col(p), 9)).groupBy(*keys, "_s").agg(
        F.sum(F.col(y).cast("long")).alias("_pos"), F.sum(1 - F.col(y).cast("long")).alias("_neg"))
    c = c.withColumn("_one", F.lit(1))
    r = running(c, [*keys, "_one"], ["_s"], {"_below": ("sum", F.col("_neg"))}, strict=True)
    area = F.sum(F.col("_pos") * (F.coalesce("_below", F.lit(0)) + F.col("_neg") / 2))
    out = r.groupBy(*keys, "_one").agg((area / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("auc"))
    return out.drop("_one")


def binary_metrics(df: DataFrame, p: str, y: str, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """n, log loss, Brier, AUC and expected calibration error."""
    keys = list(keys)
    py, yy = F.col(p), F.col(y).cast("double")
    k = keys or ["_all"]
    d = df if keys else df.withColumn("_all", F.lit(1))
    base = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(py, yy)).alias("log_loss"), F.avg(F.pow(py - yy, F.lit(2))).alias("brier"))
    cal = reliability_table(d, p, y, k, bins)
    ece = cal.groupBy(*k).agg((F.sum(F.abs(F.col("mean_p") - F.col("rate")) * F.col("n")) / F.sum("n")).alias("ece"))
    out = base.join(auc(d, p, y, k), k).join(ece, k)
    return out if keys else out.drop("_all")


def reliability_table(df: DataFrame, p: str, y: str, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def split_by_group(df: DataFrame, group: str, parts: dict[str, float], seed: str = "split") -> DataFrame:
    """Whole groups into parts by a hash of their id: never by row, stable between runs."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(1_000_000)) / 1_000_000
    out, upto = None, 0.0
    names = list(parts)
    for n in names[:-1]:
        upto += parts[n]
        out = F.when(u < upto, n) if out is None else out.when(u < upto, n)
    return df.withColumn("split", out.otherwise(names[-1]))


def fold_of(group: str, k: int, seed: str = "fold") -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(k)).cast("int")


def paired_bootstrap(df: DataFrame, group: str, loss_a: Column, loss_b: Column, replicates: int = 200, seed: str = "boot") -> DataFrame:
    """Interval of the mean loss difference with whole groups resampled.

    Losses are summed per group first; a replicate weighs each group by a Poisson(1) draw from a seeded hash, so
    all replicates are one pass and run again the same.
    """
    per = df.groupBy(group).agg(F.sum(loss_a - loss_b).alias("_d"), F.count(F.lit(1)).alias("_n"))
    rep = per.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(group), F.col("replicate")), F.lit(1_000_003)) + 0.5) / 1_000_003
    w, cum, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(0, 9):
        cum += term
        w = w + (u > cum).cast("int")
        term /= k + 1
    r = rep.withColumn("_w", w).groupBy("replicate").agg((F.sum(F.col("_w") * F.col("_d")) / F.sum(F.col("_w") * F.col("_n"))).alias("difference"))
    q = F.percentile("difference", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return r.agg(q.alias("_q"), F.count(F.lit(1)).alias("replicates")).select(
        "replicates", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("high"))


def class_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision and recall per class, from the confusion counts."""
    c = written(df.groupBy(F.col(label).alias("_l"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n")), "confusion")
    hit = c.where("_l = _p").select(F.col("_l").alias("class"), F.col("_n").alias("hits"))
    said = c.groupBy(F.col("_p").alias("class")).agg(F.sum("_n").alias("predicted"))
    was = c.groupBy(F.col("_l").alias("class")).agg(F.sum("_n").alias("actual"))
    j = was.join(said, "class", "left").join(hit, "class", "left")
    h, s = F.coalesce("hits", F.lit(0)), F.coalesce("predicted", F.lit(0))
    return j.select("class", "actual", s.alias("predicted"), F.when(s > 0, h / s).otherwise(0.0).alias("precision"), (h / F.col("actual")).alias("recall"))


def majority_baselines(train: DataFrame, test: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """Accuracy of always saying the commonest label, overall and per ``by`` group (such as the minute)."""
    per = train.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    best_by = per.groupBy(*by).agg(F.max_by(label, F.struct("_n", label)).alias("_by"))
    best = per.groupBy(label).agg(F.sum("_n").alias("_n")).agg(F.max_by(label, F.struct("_n", label)).alias("_all"))
    j = test.join(best_by, list(by), "left").crossJoin(F.broadcast(best))
    hit = lambda c: F.avg((F.coalesce(F.col(c), F.col("_all")) == F.col(label)).cast("double"))
    return j.agg(F.count(F.lit(1)).alias("n"), hit("_all").alias("majority"), hit("_by").alias("by_group"))
