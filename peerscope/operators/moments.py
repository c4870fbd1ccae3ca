"""Review of a recording against written predictions: expected trades, and the moments worth looking at.

Inputs are tables:

* ``readings``: recording, t (seconds), p_trade (a trade starts within a second), net and won (of trades started here), p_hit (the
  opponent starts one), p_died (dead within 15 seconds), in_range (seconds in range so far); a prediction may be null
* ``trades``: recording, trade, start, me_lost, opponent_lost, started_by (you, opponent, both), skirmish, result (won, lost, even), died
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof
from .ordered import islands, previous, rolling_range
from .scale import written

# What counts as missed, dangerous and risky; how readings form spots; how many moments are shown.
MISSED = {"expected": 0.6, "net": 0.04, "won": 0.5}
RISK, GAP, BEFORE, APART, DECISION, WATCH, STAYED = 2.0, 0.75, 1.5, 10.0, 1.0, 3.0, 2
UNLIKELY_WIN = 0.45
EDGE = 1e-9  # borders of rounded values go up, so that they don't hang on the order of operations
LIMITS = (("weakness", 5), ("strength", 2))
MOMENT = ("recording", "t", "kind", "polarity", "impact")


def steps(readings: DataFrame) -> DataFrame:
    """Seconds a reading stands for: the median distance of a recording's readings, between 0.1 and 1 (0.25 for a single one)."""
    d = previous(readings.select("recording", "t"), ["recording"], ["t"], {"_before": F.col("t")})
    median = F.percentile(F.col("t") - F.col("_before"), F.lit(0.5))
    return d.groupBy("recording").agg(F.coalesce(F.least(F.greatest(median, F.lit(0.1)), F.lit(1.0)), F.lit(0.25)).alias("step"))


def own(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("started_by").isin("you", "both"))


def before_trades(readings: DataFrame, trades: DataFrame) -> DataFrame:
    """Own trades outside skirmishes with the predictions of the last reading less than 1.5 seconds before them."""
    mine = own(trades).where(~F.col("skirmish"))
    seen = asof(mine, readings, ["recording"], "start", "t", {f"at_{c}": c for c in ("p_trade", "net", "won", "p_died")}, strict=True, matched_time="_at")
    return seen.where(F.col("start") - F.col("_at") <= BEFORE).drop("_at")


def summary(readings: DataFrame, trades: DataFrame) -> DataFrame:
    """recording, expected (the integral of the chances over time), trades started, expected_net and actual_net of their spots, style."""
    total = readings.groupBy("recording").agg(F.sum("p_trade").alias("_p")).join(steps(readings), "recording")
    started = own(trades).groupBy("recording").agg(F.count(F.lit(1)).alias("trades"))
    nets = before_trades(readings, trades).groupBy("recording").agg(F.avg("at_net").alias("expected_net"), F.avg(F.col("opponent_lost") - F.col("me_lost")).alias("actual_net"))
    s = total.join(started, "recording", "left").join(nets, "recording", "left")
    e, n = F.round(F.col("_p") * F.col("step") / DECISION + EDGE, 1), F.coalesce("trades", F.lit(0))
    style = F.when((e >= 3) & (n < 0.5 * e), "passive").when((n >= 3) & (n > 2 * F.greatest(e, F.lit(0.5))), "aggressive")
    return s.select("recording", e.alias("expected"), n.alias("trades"), "expected_net", "actual_net", style.alias("style"))


def missed(readings: DataFrame, trades: DataFrame) -> DataFrame:
    """Spots near the opponent (readings at most 0.75 seconds apart) where trades were to be expected, good ones, and none was started."""
    r = previous(readings, ["recording"], ["t"], {"_before": F.col("t")})
    r = islands(r, ["recording"], ["t"], F.col("_before").isNull() | (F.col("t") - F.col("_before") > GAP), "spot")
    w = F.coalesce("p_trade", F.lit(0.0))
    mean = lambda c: F.sum(F.col(c) * w) / F.when(F.sum(w) > 0, F.sum(w))
    spots = r.groupBy("recording", "spot").agg(F.min("t").alias("t"), (F.max("t") + DECISION).alias("_until"), F.sum(w).alias("_p"), mean("net").alias("net"), mean("won").alias("won"))
    spots = spots.join(steps(readings), "recording").withColumn("expected", F.col("_p") * F.col("step") / DECISION)
    spots = asof(spots, own(trades).select("recording", "start"), ["recording"], "_until", "start", {"_started": "start"})
    net, won = F.col("net"), F.col("won")
    good = F.coalesce(net >= MISSED["net"], F.lit(True)) & F.coalesce(won >= MISSED["won"], F.lit(True)) & (net.isNotNull() | won.isNotNull() | (F.col("expected") >= 1.0))
    gain = F.when(net.isNull() | (net == 0), 0.05).otherwise(F.greatest(net, F.lit(0.05)))
    return spots.where((F.col("expected") >= MISSED["expected"]) & ~F.coalesce(F.col("_started") >= F.col("t"), F.lit(False)) & good).select(
        "recording", "t", F.lit("missed_trade").alias("kind"), F.lit("weakness").alias("polarity"), (F.col("expected") * gain * 100).alias("impact"))


def _moment(rows: DataFrame, kind: str, polarity: str, impact: Column) -> DataFrame:
    return rows.select("recording", F.col("start").alias("t"), F.lit(kind).alias("kind"), F.lit(polarity).alias("polarity"), impact.cast("double").alias("impact"))


def chosen(before: DataFrame, rare: float, common: float) -> DataFrame:
    """Lost trades from spots where hardly any are started, and won ones from common spots (of ``before_trades``)."""
    p, net, won = F.col("at_p_trade"), F.col("at_net"), F.col("at_won")
    bad = (p < rare) & (F.col("result") == "lost") & (F.coalesce(net < 0, F.lit(False)) | F.coalesce(won < UNLIKELY_WIN, F.lit(False)))
    good = ~F.coalesce(bad, F.lit(False)) & (p >= common) & (F.col("result") == "won")
    return _moment(before.where(bad), "rare_trade", "weakness", 100 * (F.col("me_lost") - F.col("opponent_lost"))).unionByName(
        _moment(before.where(good), "good_trade", "strength", 100 * (F.col("opponent_lost") - F.col("me_lost"))))


def spacing(readings: DataFrame, trades: DataFrame, threat: float) -> DataFrame:
    """Lost trades that the opponent started after three seconds rated dangerous, the player staying in range."""
    theirs = trades.where((F.col("started_by") == "opponent") & ~F.col("skirmish") & (F.col("result") == "lost"))
    seconds = F.col("t").cast("double").alias("t")
    rows = readings.select("recording", seconds, "p_hit", F.lit(None).cast("string").alias("trade"), F.lit(0.0).alias("_loss")).unionByName(
        theirs.select("recording", F.col("start").cast("double").alias("t"), F.lit(None).cast("double").alias("p_hit"), F.col("trade").cast("string").alias("trade"), (F.col("me_lost") - F.col("opponent_lost")).alias("_loss")))
    worst = rolling_range(rows, ["recording"], "t", WATCH, {"_worst": F.max("p_hit")}, back_to=0.001).where("trade IS NOT NULL")
    last = asof(worst.withColumnRenamed("t", "start"), readings, ["recording"], "start", "t", {"_range": "in_range"}, strict=True, matched_time="_at")
    return _moment(last.where((F.col("_worst") >= threat) & (F.col("start") - F.col("_at") <= WATCH) & (F.col("_range") >= STAYED)), "spacing", "weakness", 100 * F.col("_loss"))


def risky(before: DataFrame, rate: float) -> DataFrame:
    """Trades that ended in a death, from spots at least twice as deadly as usual."""
    return _moment(before.where(F.col("died") & (F.col("at_p_died") >= RISK * rate)), "risky_trade", "weakness", F.lit(100.0))


def separated(moments: DataFrame, apart: float = APART, limits=LIMITS) -> DataFrame:
    """The biggest weaknesses, then strengths, of each recording, no two of either kind closer than ``apart``.

    Non-maximum suppression by rounds: every round takes each recording's biggest moment left and removes
    what is near it, so a recording of any length costs one row a round and no list is gathered. There are
    as many rounds as moments shown. Equal impacts are taken in the order of time and kind.
    """
    left = written(moments.select(*MOMENT), "moments")
    best_first = F.struct(F.col("impact"), -F.col("t"), F.col("kind"))
    picked = None
    for polarity, limit in limits:
        for _ in range(limit):
            top = written(left.where(F.col("polarity") == polarity).groupBy("recording").agg(F.max_by(F.struct("t", "kind", "polarity", "impact"), best_first).alias("_m")).select("recording", "_m.*"), "picked")
            if top.isEmpty():
                break
            picked = top if picked is None else picked.unionByName(top)
            near = top.select("recording", F.col("t").alias("_t"))
            left = written(left.join(near, "recording", "left").where(F.col("_t").isNull() | (F.abs(F.col("t") - F.col("_t")) >= apart)).select(*MOMENT), "moments")
    return moments.select(*MOMENT).limit(0) if picked is None else picked.select(*MOMENT)


def review(readings: DataFrame, trades: DataFrame, rare: float, common: float, threat: float, death_rate: float) -> DataFrame:
    """All moments of the recordings (before ``separated``). The four numbers come with the model: its tenth and median chance at
    trades, its highest tenth of the opponent's chance, and how often the usual spot ends in a death."""
    before = written(before_trades(readings, trades), "before")
    return missed(readings, trades).unionByName(chosen(before, rare, common)).unionByName(spacing(readings, trades, threat)).unionByName(risky(before, death_rate))
