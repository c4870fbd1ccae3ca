"""Notes about a game, grounding of written claims in their evidence, quality of answers, event logs, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import written_numbers
from .ordered import numbered, top_per_group
from .scale import beside, written



def note_rules(comeback: float = 2500.0, lead: float = 800.0, cs: float = 30.0) -> list[tuple[str, str, Column, Column]]:
    """(note, kind, condition, weight) over one wide row per participant: own numbers, the match's and team's
    totals, the opponent's numbers, and the rank's 20/50/80 percentiles as ``<metric>_p20`` and so on."""
    c = F.col
    minutes = F.greatest(F.lit(1.0), c("duration_s") / 60)
    share = c("damage") / F.greatest(c("team_damage"), F.lit(1))
    kp = (c("kills") + c("assists")) / F.greatest(c("team_kills"), F.lit(1))
    csd = c("cs") - c("opp_cs")
    top_damage = c("damage") >= c("match_damage")
    rules = [
        ("most_damage", "good", top_damage, F.lit(3.0)),
        ("damage_share", "good", ~top_damage & (share >= 0.30), F.lit(2.2)),
        ("kp_high", "good", (c("team_kills") >= 10) & (kp >= 0.68), 1.6 + 3 * (kp - 0.68)),
        ("kp_low", "bad", (c("team_kills") >= 10) & (kp < 0.35) & ~c("is_top"), 1.8 + 3 * (0.35 - kp)),
        ("vision_most", "good", (c("vision") >= c("match_vision")) & (c("vision") >= minutes), F.lit(1.7)),
        ("deathless", "good", (c("deaths") == 0) & (minutes >= 15), F.lit(2.6)),
        ("first_blood", "good", c("first_blood"), F.lit(1.2)),
        ("multikill", "good", c("largest_multikill") >= 3, 1.5 + c("largest_multikill") - 3),
        ("comeback", "good", c("win") & (c("team_lead") <= -comeback), 2.4 + F.least(-c("team_lead"), F.lit(8000)) / 4000),
        ("throw", "bad", ~c("win") & (c("team_lead") >= comeback), 2.2 + F.least(c("team_lead"), F.lit(8000)) / 4000),
        ("cs_up", "good", ~c("is_support") & (csd >= cs), 1.4 + F.least(csd, F.lit(120)) / 60),
        ("cs_down", "bad", ~c("is_support") & (csd <= -cs), 1.4 + F.least(-csd, F.lit(120)) / 60),
        ("gold_up", "good", c("lane_gold") >= lead, 1.5 + F.least(c("lane_gold"), F.lit(3000)) / 1500),
        ("gold_down", "bad", c("lane_gold") <= -lead, 1.5 + F.least(-c("lane_gold"), F.lit(3000)) / 1500)]
    known = minutes >= 15
    for metric, name, scale, applies in (("cs_min", "farm", 1.0, ~c("is_support")), ("vision_min", "vision", 0.9, F.lit(True)), ("dmg_min", "damage", 0.9, ~c("is_support"))):
        v, lo, mid, hi = c(metric), c(f"{metric}_p20"), c(f"{metric}_p50"), c(f"{metric}_p80")
        over = F.when(hi > mid, (v - hi) / F.when(hi > mid, hi - mid))
        under = F.when(mid > lo, (lo - v) / F.when(mid > lo, mid - lo))
        rules.append((f"{name}_high", "good", known & applies & (hi > mid) & (v >= hi), scale * (1.4 + F.least(over, F.lit(2.0)))))
        rules.append((f"{name}_low", "bad", known & applies & (mid > lo) & (v <= lo), scale * (1.4 + F.least(under, F.lit(2.0)))))
    d, mid, hi = c("deaths_10"), c("deaths_10_p50"), c("deaths_10_p80")
    over = F.when(hi > mid, (d - hi) / F.when(hi > mid, hi - mid))
    rules.append(("deaths_high", "bad", F.when(mid.isNotNull() & known, (c("deaths") >= 6) & (d >= hi) & (hi > mid)).otherwise(c("deaths") >= 10),
                  F.when(mid.isNotNull() & known, 1.6 + F.least(over, F.lit(2.0))).otherwise(1.8)))
    return rules


def wide_rows(builds: DataFrame) -> DataFrame:
    """Own numbers beside the match's best and the team's totals."""
    w = beside(builds, ["match_id"], {"match_damage": F.max("damage"), "match_vision": F.max("vision")})
    return beside(w, ["match_id", "team"], {"team_damage": F.sum("damage")})


def match_notes(wide: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str, Column, Column]], each: int = 2) -> DataFrame:
    """The strongest ``each`` notes of both kinds per participant. Rules are cut inside the row first, so the
    ranking never moves more rows than it keeps candidates for."""
    cand = F.array(*[F.struct(F.round(-w.cast("double"), 9).alias("w"), F.lit(n).alias("note"), F.lit(k).alias("kind"), F.coalesce(cond, F.lit(False)).alias("on"))
                     for n, k, cond, w in rules])
    def best(kind: str) -> Column:
        return F.slice(F.array_sort(F.filter(cand, lambda x: x["on"] & (x["kind"] == kind))), 1, each)
    picked = wide.withColumn("_n", F.concat(best("good"), best("bad")))
    return picked.select(*keys, F.posexplode("_n").alias("_i", "_x")).select(*keys, F.col("_x.note").alias("note"), F.col("_x.kind").alias("kind"), (-F.col("_x.w")).alias("weight"))


def all_notes(wide: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    cand = F.array(*[F.struct(F.lit(n).alias("note"), F.lit(k).alias("kind"), F.coalesce(cond, F.lit(False)).alias("on")) for n, k, cond, _ in rules])
    return wide.select(*keys, F.explode(cand).alias("_x")).where("_x.on").select(*keys, "_x.note", "_x.kind")


# -- grounding -------------------------------------------------------------------------------------

def unsupported_numbers(claims: DataFrame, evidence: DataFrame, claim: str, group: str, text: str, cites: str | None = None,
                        evidence_id: str | None = None, digits: int = 4) -> DataFrame:
    """Numbers of a claim that none of its cited evidence states at the precision they are written with.

    Claims and evidence meet on (group[, citation], decimals, rounded value): an anti join, so a claim is never
    compared with every number of its evidence.
    """
    if cites:
        c = claims.select(group, claim, text, F.explode_outer(cites).alias("_cite"))
    else:
        c = claims.select(group, claim, text, F.lit(None).cast("string").alias("_cite"))
    numbers = claims.select(group, claim, F.explode(written_numbers(text)).alias("n")).select(
        group, claim, "n.raw", "n.value", F.least(F.col("n.decimals"), F.lit(digits)).alias("decimals"))
    stated = evidence.select(F.col(group).alias("_g"), *([F.col(evidence_id).alias("_e")] if cites else []), F.explode(written_numbers("text")).alias("n"))
    stated = stated.select("_g", *(["_e"] if cites else []), F.explode(F.sequence(F.lit(0), F.lit(digits))).alias("_d"), F.col("n.value").alias("_v"))
    rounded = F.round(F.col("_v") * F.pow(F.lit(10.0), F.col("_d")), 0).cast("decimal(30,0)")
    stated = stated.select("_g", *(["_e"] if cites else []), "_d", rounded.alias("_r")).distinct()
    wanted = numbers.withColumn("_w", F.round(F.col("value") * F.pow(F.lit(10.0), F.col("decimals")), 0).cast("decimal(30,0)"))
    if cites:
        cited = c.where("_cite IS NOT NULL").select(group, claim, "_cite").distinct()
        pool = cited.join(stated, (F.col(group) == F.col("_g")) & (F.col("_cite") == F.col("_e"))).select(F.col(group).alias("_pg"), F.col(claim).alias("_pc"), "_d", "_r").distinct()
        on = (wanted[group] == pool["_pg"]) & (wanted[claim] == pool["_pc"]) & (wanted["decimals"] == pool["_d"]) & (wanted["_w"] == pool["_r"])
        return wanted.join(pool, on, "left_anti").drop("_w")
    on = (wanted[group] == stated["_g"]) & (wanted["decimals"] == stated["_d"]) & (wanted["_w"] == stated["_r"])
    return wanted.join(stated, on, "left_anti").drop("_w")


def citation_problems(claims: DataFrame, evidence: DataFrame, claim: str, group: str, cites: str, evidence_id: str) -> DataFrame:
    """Claims that cite nothing, and citations of evidence that does not exist."""
    none = claims.where(F.size(F.coalesce(cites, F.array().cast("array<string>"))) == 0).select(group, claim, F.lit("cites no evidence").alias("problem"))
    each = claims.select(group, claim, F.explode(cites).alias("_c"))
    known = evidence.select(F.col(group).alias("_g"), F.col(evidence_id).alias("_e"))
    unknown = each.join(known, (F.col(group) == F.col("_g")) & (F.col("_c") == F.col("_e")), "left_anti")
    return none.unionByName(unknown.select(group, claim, F.concat(F.lit("cites unknown evidence "), F.col("_c").cast("string")).alias("problem")))


def grounded_claims(claims: DataFrame, *problems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims without any violation."""
    out = claims
    for p in problems:
        out = out.join(p.select(*keys), list(keys), "left_anti")
    return out


def answer_quality(points: DataFrame, evidence: DataFrame, group: str, point: str, top: int = 3) -> DataFrame:
    """Per answer: points whose polarity or area differs from their evidence, advice with numbers, points on
    context only or on evidence already used, and how many of the top weaknesses are cited.

    ``points``: group, point (order), kind, area, advice, cites[]. ``evidence``: group, evidence_id, kind, area,
    polarity, severity.
    """
    c = F.col
    e = evidence.select(c(group).alias("_g"), "evidence_id", c("kind").alias("_k"), c("area").alias("_a"), "polarity")
    cited = points.select(group, point, c("kind").alias("pk"), c("area").alias("pa"), F.explode_outer("cites").alias("_c")).join(
        e, (c(group) == c("_g")) & (c("_c") == c("evidence_id")), "left")
    real = c("_k").isNotNull() & (c("_k") != "context")
    first = cited.where(real).groupBy(group, "evidence_id").agg(F.min(point).alias("_first"))
    cited = cited.join(first.withColumnRenamed(group, "_fg").withColumnRenamed("evidence_id", "_fe"), (c(group) == c("_fg")) & (c("evidence_id") == c("_fe")), "left")
    pol = real & (c("polarity") != "neutral")
    area = real & c("_k").isin("metric", "curve", "trend")
    n = lambda cond: F.count(F.when(cond, 1))
    per = cited.groupBy(group, point).agg(
        n(real).alias("_real"), n(pol).alias("_pol"), n(pol & (c("polarity") == c("pk"))).alias("_same"), n(area).alias("_area"), n(area & (c("_a") == c("pa"))).alias("_same_area"),
        n(real & (c("_first") < c(point))).alias("_used"))
    advice = points.select(group, point, (F.size(written_numbers("advice")) > 0).alias("_adv"))
    per = per.join(advice, [group, point])
    q = per.groupBy(group).agg(
        F.count(F.lit(1)).alias("points"), n((c("_pol") > 0) & (c("_same") == 0)).alias("kind_mismatches"), n((c("_area") > 0) & (c("_same_area") == 0)).alias("area_mismatches"),
        n(c("_adv")).alias("advice_with_numbers"), n(c("_real") == 0).alias("context_only"), n((c("_real") > 0) & (c("_used") == c("_real"))).alias("shared_evidence"))
    weak = top_per_group(evidence.where("polarity = 'weakness'"), [group], [c("severity").desc(), c("evidence_id")], top)
    hit = points.select(c(group).alias("_hg"), F.explode("cites").alias("_hc")).distinct()
    w = weak.join(hit, (c(group) == c("_hg")) & (c("evidence_id") == c("_hc")), "left").groupBy(group).agg((F.count("_hc") / F.count(F.lit(1))).alias("_addr"))
    return q.join(w, group, "left").withColumn("top_weaknesses_addressed", F.coalesce("_addr", F.lit(1.0))).drop("_addr")


# -- logs and summaries ------------------------------------------------------------------------------

def readable_log(events: DataFrame, name_of: Column) -> DataFrame:
    """Events worth reading, in order, as text."""
    c = F.col
    text = (F.when(c("kind") == "kill", F.concat(name_of, F.lit(" killed "), c("victim").cast("string")))
            .when(c("kind") == "tower", F.concat(F.when(c("side") == 100, "Blue").otherwise("Red"), F.lit(" destroyed a tower")))
            .when(c("kind") == "monster", F.concat(F.when(c("side") == 100, "Blue").otherwise("Red"), F.lit(" took "), F.initcap("monster"))))
    seconds = F.floor(c("t") / 1000)
    clock = F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))
    return events.where(text.isNotNull()).select("match_id", "seq", clock.alias("clock"), text.alias("text"))


def credit_summary(credit: DataFrame) -> DataFrame:
    """A player's attribution in one game: rank of ten and the opposite number's total.

    The credit is written once: it is read for the ranks, for the opposite numbers and to count a match's rows.
    """
    credit = written(credit, "credit")
    r = numbered(credit.withColumn("_neg", -F.round("total", 6)), ["match_id"], ["_neg", "player"], "rank")
    o = credit.select(F.col("match_id").alias("_m"), F.when(F.col("player") <= 5, F.col("player") + 5).otherwise(F.col("player") - 5).alias("_p"), F.col("total").alias("opponent_total"))
    return r.join(o, (F.col("match_id") == F.col("_m")) & (F.col("player") == F.col("_p"))).select("match_id", "player", "rank", "total", "opponent_total")
