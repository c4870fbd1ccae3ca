"""Baselines, fallback and scores on the star binding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines as B
from ..operators import scoring as S
from ..operators.joins import fallback_baselines
from ..operators.scale import dimension, written
from ..session import parts
from .registry import query
from .star import GAMES_SQL, LINES_SQL, TIERS, Star, with_sql

OWN_MIN_N, ROLE_MIN_N = 100, 20
LEAD_METRICS = ("quantity",)

LONG_SQL = LINES_SQL + """,
long AS (SELECT game_id, player, tier, role, champion, metric, value FROM (
  SELECT game_id, player, tier, role, champion, 'quantity' AS metric, CAST(quantity AS DOUBLE) AS value FROM lines UNION ALL
  SELECT game_id, player, tier, role, champion, 'price', CAST(price AS DOUBLE) FROM lines UNION ALL
  SELECT game_id, player, tier, role, champion, 'discount', CAST(discount AS DOUBLE) FROM lines UNION ALL
  SELECT game_id, player, tier, role, champion, 'tax', CAST(tax AS DOUBLE) FROM lines))"""
_STATS_SQL = """count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd,
  round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
  round(quantile_cont(value, 0.9), 6) AS p90"""
BASE_SQL = LONG_SQL + f""",
base AS (
  SELECT tier, role, champion, metric, CAST(NULL AS INTEGER) AS minute, {_STATS_SQL}
  FROM long GROUP BY tier, role, champion, metric HAVING count(*) >= 20
  UNION ALL
  SELECT tier, role, '*', metric, NULL, {_STATS_SQL}
  FROM long GROUP BY tier, role, metric HAVING count(*) >= 20)"""
EFFECTS_SQL = """
eff AS (SELECT role, champion, metric, 0 AS minute, round(raw * n / (n + 100.0), 6) AS effect, n FROM (
  SELECT c.role, c.champion, c.metric, sum(c.n * (c.p50 - r.p50) / r.sd) / sum(c.n) AS raw, CAST(sum(c.n) AS BIGINT) AS n
  FROM base c JOIN base r ON r.champion = '*' AND r.tier = c.tier AND r.role = c.role AND r.metric = c.metric
  WHERE c.champion <> '*' AND r.sd > 0 GROUP BY c.role, c.champion, c.metric)
  WHERE n >= 50 AND abs(raw) >= 0.25 * 1.25 / sqrt(n))"""
LANES_SQL = """
lanes AS (SELECT role, champion, metric, 0 AS minute, count(*) AS n, sum(value) / (count(*) + 50.0) AS strength
  FROM long GROUP BY role, champion, metric)"""
TIER_RANK_SQL = "CASE {t} " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(TIERS)) + " END"

# The lane metric is judged against a named opponent: the champion whose number follows.
OPPONENT_SQL = "'Brand#' || CAST(1 + CAST(substr(champion, 7) AS INTEGER) % 25 AS VARCHAR)"
CHOSEN_SQL = f"""
needs AS (SELECT DISTINCT tier, role, champion,
    CASE WHEN metric = 'quantity' THEN {OPPONENT_SQL} END AS opponent, metric FROM long),
cand AS (
  SELECT n.tier, n.role, n.champion, n.opponent, n.metric, b.tier AS from_tier, b.champion <> '*' AS own,
         {TIER_RANK_SQL.format(t='b.tier')} - {TIER_RANK_SQL.format(t='n.tier')} AS step,
         b.n, b.sd, b.mean, b.p10, b.p25, b.p50, b.p75, b.p90, e.effect, me.strength AS mes, op.strength AS ops
  FROM needs n
  LEFT JOIN eff e ON e.role = n.role AND e.champion = n.champion AND e.metric = n.metric
  LEFT JOIN lanes me ON n.metric = 'quantity' AND me.role = n.role AND me.champion = n.champion AND me.metric = n.metric
  LEFT JOIN lanes op ON n.metric = 'quantity' AND op.role = n.role AND op.champion = n.opponent AND op.metric = n.metric
  JOIN base b ON b.role = n.role AND b.metric = n.metric AND (b.champion = '*' OR b.champion = n.champion)
   AND abs({TIER_RANK_SQL.format(t='b.tier')} - {TIER_RANK_SQL.format(t='n.tier')}) <= 1),
scoped AS (
  SELECT *, opponent IS NOT NULL AND (mes IS NOT NULL OR ops IS NOT NULL) AS matchup,
         CASE WHEN own THEN 0 WHEN step = 0 THEN 1 WHEN step < 0 THEN 2 ELSE 3 END AS priority FROM cand),
usable AS (
  SELECT *, CASE WHEN own THEN 0.0 WHEN matchup THEN coalesce(mes, 0.0) - coalesce(ops, 0.0)
                 ELSE coalesce(effect * sd, 0.0) END AS shift,
         CASE WHEN own THEN 'champion' WHEN matchup THEN 'matchup' WHEN effect IS NOT NULL THEN 'adjusted' ELSE 'role' END AS source,
         row_number() OVER (PARTITION BY tier, role, champion, opponent, metric ORDER BY priority) AS rn
  FROM scoped WHERE (own AND step = 0 AND NOT matchup AND n >= {OWN_MIN_N}) OR (NOT own AND n >= {ROLE_MIN_N})),
chosen AS (
  SELECT tier, role, champion, opponent, metric, from_tier, source, n, sd, mean + shift AS mean, p10 + shift AS p10,
         p25 + shift AS p25, p50 + shift AS p50, p75 + shift AS p75, p90 + shift AS p90 FROM usable WHERE rn = 1)"""
_GAP = "CASE WHEN {a} - {b} <> 0 THEN {a} - {b} WHEN sd <> 0 THEN sd ELSE 1.0 END"
PERCENTILE_SQL = f"""CASE
  WHEN value IN (p10, p25, p50, p75, p90) THEN (
    CASE value WHEN p10 THEN 10.0 WHEN p25 THEN 25.0 WHEN p50 THEN 50.0 WHEN p75 THEN 75.0 ELSE 90.0 END +
    CASE value WHEN p90 THEN 90.0 WHEN p75 THEN 75.0 WHEN p50 THEN 50.0 WHEN p25 THEN 25.0 ELSE 10.0 END) / 2
  WHEN value < p10 THEN greatest(1.0, 10 - 15 * (p10 - value) / ({_GAP.format(a='p25', b='p10')}))
  WHEN value > p90 THEN least(99.0, 90 + 15 * (value - p90) / ({_GAP.format(a='p90', b='p75')}))
  WHEN value < p25 THEN 10 + 15 * (value - p10) / (p25 - p10)
  WHEN value < p50 THEN 25 + 25 * (value - p25) / (p50 - p25)
  WHEN value < p75 THEN 50 + 25 * (value - p50) / (p75 - p50)
  ELSE 75 + 15 * (value - p75) / (p90 - p75) END"""
SCORED_SQL = f"""
catalogue(metric, area, hib, coachable) AS (VALUES ('quantity','farming',true,true),('price','economy',true,true),
  ('discount','survival',false,true),('tax','vision',true,true)),
scored AS (
  SELECT *, CASE WHEN hib THEN pct ELSE 100 - pct END AS goodness,
         CASE WHEN sd <> 0 THEN (value - mean) / sd ELSE 0 END AS z FROM (
    SELECT l.*, c.area, c.hib, c.coachable, h.source, h.from_tier, h.n, h.sd, h.mean, {PERCENTILE_SQL} AS pct
    FROM long l JOIN catalogue c ON c.metric = l.metric
    JOIN chosen h ON h.tier = l.tier AND h.role = l.role AND h.champion = l.champion AND h.metric = l.metric
     AND h.opponent IS NOT DISTINCT FROM (CASE WHEN l.metric = 'quantity' THEN {OPPONENT_SQL.replace('champion', 'l.champion')} END)
    WHERE NOT (l.metric = 'tax' AND l.role = '2-HIGH')))"""
ALL_SCORED_SQL = (BASE_SQL, EFFECTS_SQL, LANES_SQL, CHOSEN_SQL, SCORED_SQL)


def base_table(s: Star, long: DataFrame | None = None) -> DataFrame:
    return B.build_baselines(s.metric_rows() if long is None else long, "tier", "role", "champion", None, 20)


@query("baseline_game", with_sql(BASE_SQL) + """
SELECT tier, role, champion, metric, n, mean, sd, p10, p25, p50, p75, p90 FROM base WHERE champion <> '*'""")
def baseline_game(s: Star) -> DataFrame:
    return base_table(s).where(F.col("champion") != B.ALL).drop("minute")


@query("baseline_rollup", with_sql(BASE_SQL) + "SELECT tier, role, champion, metric, n, mean, sd, p10, p25, p50, p75, p90 FROM base")
def baseline_rollup(s: Star) -> DataFrame:
    return base_table(s).drop("minute")


CURVES_SQL = LINES_SQL + """,
curve AS (SELECT tier, role, slot AS minute, metric, value FROM (
  SELECT tier, role, slot, 'quantity' AS metric, CAST(quantity AS DOUBLE) AS value FROM lines UNION ALL
  SELECT tier, role, slot, 'discount', CAST(discount AS DOUBLE) FROM lines))"""


@query("baseline_curves", with_sql(CURVES_SQL) + f"""
SELECT tier, role, metric, CAST(minute AS INTEGER) AS minute, {_STATS_SQL} FROM curve GROUP BY tier, role, metric, minute HAVING count(*) >= 20""")
def baseline_curves(s: Star) -> DataFrame:
    long = B.unpivot_metrics(s.lines(), ["tier", "role", "champion", "slot"], ["quantity", "discount"])
    out = B.build_baselines(long, "tier", "role", "champion", "slot", 20)
    return out.where(F.col("champion") == B.ALL).drop("champion")


@query("lane_strength", with_sql(LONG_SQL, LANES_SQL) + "SELECT role, champion, metric, minute, n, strength FROM lanes")
def lane_strength(s: Star) -> DataFrame:
    return B.lane_strength(s.metric_rows(), "role", "champion")


@query("champion_effects", with_sql(BASE_SQL, EFFECTS_SQL) + "SELECT role, champion, metric, minute, effect, n FROM eff")
def champion_effects(s: Star) -> DataFrame:
    return B.champion_effects(base_table(s), gate=0.25)


def _sources(s: Star):
    # The lines are joined once: baselines, strengths, needs and the scores all read the written ones.
    rows = s.metric_rows(written(s.metric_lines(), "lines"))
    base = dimension(base_table(s, rows))
    opponent = F.when(F.col("metric").isin(*LEAD_METRICS),
                      F.concat(F.lit("Brand#"), (1 + F.substring("champion", 7, 3).cast("int") % 25).cast("string")))
    long = rows.withColumn("opponent", opponent).withColumn("minute", F.lit(None).cast("int"))
    effects = dimension(B.champion_effects(base, gate=0.25))
    return long, base, effects, dimension(B.lane_strength(rows, "role", "champion"))


@query("baseline_fallback", with_sql(BASE_SQL, EFFECTS_SQL, LANES_SQL, CHOSEN_SQL) + """
SELECT tier, role, champion, opponent, metric, from_tier, source, n, sd, round(mean, 9) AS mean, round(p10, 9) AS p10,
  round(p25, 9) AS p25, round(p50, 9) AS p50, round(p75, 9) AS p75, round(p90, 9) AS p90 FROM chosen""")
def baseline_fallback(s: Star) -> DataFrame:
    long, base, effects, lanes = _sources(s)
    needs = long.select("tier", "role", "champion", "opponent", "metric", "minute").distinct()
    out = fallback_baselines(needs, base, effects, lanes, TIERS, OWN_MIN_N, ROLE_MIN_N, LEAD_METRICS)
    return out.select("tier", "role", "champion", "opponent", "metric", "from_tier", "source", "n", "sd",
                      *[F.round(c, 9).alias(c) for c in ("mean", "p10", "p25", "p50", "p75", "p90")])


def scored(s: Star) -> DataFrame:
    long, base, effects, lanes = _sources(s)
    return S.score_games(long, s.catalogue(), base, effects, lanes, TIERS, OWN_MIN_N, ROLE_MIN_N, LEAD_METRICS)


@query("score_games", with_sql(*ALL_SCORED_SQL) + """
SELECT game_id, player, champion, metric, value, source, round(pct, 5) AS percentile, round(goodness, 5) AS goodness,
  round(z, 5) AS z FROM scored""")
def score_games(s: Star) -> DataFrame:
    return scored(s).select("game_id", "player", "champion", "metric", "value", "source", *[
        F.round(c, 5).alias(c) for c in ("percentile", "goodness", "z")])


@query("game_score", with_sql(*ALL_SCORED_SQL) + """
SELECT game_id, player, round(avg(goodness), 5) AS score, count(*) AS metrics FROM scored GROUP BY game_id, player""")
def game_score(s: Star) -> DataFrame:
    return S.game_score(scored(s), ["game_id", "player"]).withColumn("score", F.round("score", 5))


@query("missing_metrics", with_sql(*ALL_SCORED_SQL) + """
SELECT l.game_id, count(*) AS missing FROM long l JOIN catalogue c ON c.metric = l.metric LEFT JOIN chosen h
  ON h.tier = l.tier AND h.role = l.role AND h.champion = l.champion AND h.metric = l.metric
WHERE h.source IS NULL AND NOT (l.metric = 'tax' AND l.role = '2-HIGH') GROUP BY l.game_id""")
def missing_metrics(s: Star) -> DataFrame:
    return scored(s).where(F.col("source").isNull()).groupBy("game_id").agg(F.count(F.lit(1)).alias("missing"))


@query("evidence_table", with_sql(*ALL_SCORED_SQL) + """
, best AS (SELECT game_id, champion, metric, area, round(avg(goodness), 5) AS goodness FROM scored
           GROUP BY game_id, champion, metric, area),
marked AS (SELECT *, CASE WHEN goodness <= 25 THEN 'weakness' WHEN goodness >= 75 THEN 'strength' END AS kind,
           round(abs(goodness - 50), 4) AS weight FROM best),
capped AS (SELECT *, row_number() OVER (PARTITION BY game_id, area ORDER BY weight DESC, metric, champion) AS a FROM marked WHERE kind IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY weight DESC, metric, champion) AS position FROM capped WHERE a <= 2)
SELECT game_id, champion, metric, area, goodness, kind, position FROM placed WHERE position <= 8""")
def evidence_table(s: Star) -> DataFrame:
    # Dealt by the game alone, once, for the means and both rankings; a fixed number of parts is not put together again.
    rows = scored(s).select("game_id", "champion", "metric", "area", "coachable", "goodness").repartition(parts(s.spark), "game_id")
    best = rows.groupBy("game_id", "champion", "metric", "area", "coachable").agg(
        F.round(F.avg("goodness"), 5).alias("goodness"))
    out = S.findings(best, ["game_id"], tie=["champion"])
    return out.select("game_id", "champion", "metric", "area", "goodness", "kind", "position")
