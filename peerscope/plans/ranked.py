"""A player's own numbers against the typical ones of each rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines as B
from ..operators import statistics as G
from ..operators.scale import written
from .grouped import RATES_SQL, bench_table
from .registry import query
from .star import TIERS, Star, with_sql

# The columns of the builds that players' numbers and rates read.
READ = ("match_id", "player", "team", "role", "tier", "start_s", "kills", "deaths", "assists", "cs", "damage", "vision", "duration_s", "team_kills")
NAMES_SQL = "[" + ", ".join(f"'{t}'" for t in TIERS) + "]"
MINE_SQL = RATES_SQL + """,
newest AS (SELECT * FROM builds QUALIFY row_number() OVER (PARTITION BY player, role ORDER BY start_s DESC, match_id DESC, team) <= 50),
totals AS (
  SELECT player, role, count(*) AS games, sum(cs) / (sum(duration_s) / 60.0) AS cs_min, sum(damage) / (sum(duration_s) / 60.0) AS dmg_min, sum(vision) / (sum(duration_s) / 60.0) AS vision_min,
         avg((kills + assists) / greatest(team_kills, 1)) AS kp, sum(deaths) / (sum(duration_s) / 600.0) AS deaths_10
  FROM newest GROUP BY player, role HAVING count(*) >= 5),
mine AS (SELECT player, role, games, metric, round(value, 6) AS value FROM (UNPIVOT totals ON cs_min, dmg_min, vision_min, kp, deaths_10 INTO NAME metric VALUE value))"""
RANKED_SQL = MINE_SQL + f""",
rungs AS (SELECT role, metric, tier, p50, list_position({NAMES_SQL}, tier) AS place FROM bench WHERE tier <> 'ALL')"""


def mine(s: Star, builds: DataFrame | None = None) -> DataFrame:
    return B.role_stats(s.builds() if builds is None else builds, [F.col("start_s").desc(), F.col("match_id").desc(), F.col("team")])


def played(s: Star) -> DataFrame:
    """The build rows, worked out once: players' numbers, the ranks' medians and the list of players all read them."""
    return written(s.builds().select(*READ), "builds")


def matched(s: Star, builds: DataFrame) -> DataFrame:
    return B.ranks_matched(mine(s, builds), bench_table(s, G.rates(builds)), TIERS)


@query("role_stats", with_sql(MINE_SQL) + " SELECT * FROM mine")
def role_stats(s: Star) -> DataFrame:
    return mine(s)


@query("ranks_matched", with_sql(RANKED_SQL) + """,
held AS (SELECT m.*, r.tier, r.place, CASE metric WHEN 'deaths_10' THEN value <= p50 ELSE value >= p50 END AS met FROM mine m JOIN rungs r USING (role, metric))
SELECT player, role, games, metric, value, arg_max(tier, place) FILTER (WHERE met) AS "like", count(*) FILTER (WHERE met) AS n_met FROM held GROUP BY player, role, games, metric, value""")
def ranks_matched(s: Star) -> DataFrame:
    return matched(s, played(s)).drop("ladder")


@query("next_steps", with_sql(RANKED_SQL) + f""",
short AS (
  SELECT m.player, m.role, r.tier AS next, m.metric, m.value, p50 AS wanted, CASE m.metric WHEN 'deaths_10' THEN m.value - p50 ELSE p50 - m.value END AS d
  FROM mine m JOIN rungs r ON r.role = m.role AND r.metric = m.metric AND r.place = m.player % {len(TIERS)} + 2)
SELECT player, role, next, metric, value, wanted, round(d / abs(wanted), 6) AS gap FROM short WHERE d > 0 AND wanted <> 0
QUALIFY row_number() OVER (PARTITION BY player, role ORDER BY round(d / abs(wanted), 6) DESC, metric DESC) = 1""")
def next_steps(s: Star) -> DataFrame:
    """A player's tier is that of the player's number."""
    builds = played(s)
    own = builds.select("player").distinct().withColumn("tier", F.get(F.array(*map(F.lit, TIERS)), (F.col("player") % len(TIERS)).cast("int")))
    return B.next_steps(matched(s, builds), own)
