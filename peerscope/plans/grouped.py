"""Grouped statistics on the star binding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import baselines as B
from ..operators import statistics as G
from ..operators.ordered import previous, top_per_group
from ..operators.scale import dimension, written
from .registry import query
from .star import BUILDS_SQL, CARTS_SQL, EVENTS_SQL, GAMES_SQL, LINES_SQL, TIERS, Star, with_sql

RATES = ("cs_min", "vision_min", "dmg_min", "deaths_10", "kp")
RATES_SQL = BUILDS_SQL + """,
rates AS (SELECT *, cs / (duration_s / 60.0) AS cs_min, vision / (duration_s / 60.0) AS vision_min, damage / (duration_s / 60.0) AS dmg_min,
  deaths / (duration_s / 600.0) AS deaths_10, (kills + assists) / greatest(team_kills, 1) AS kp FROM builds),
longr AS (UNPIVOT (SELECT tier, role, cs_min, vision_min, dmg_min, deaths_10, kp FROM rates) ON cs_min, vision_min, dmg_min, deaths_10, kp INTO NAME metric VALUE value),
bench AS (SELECT t AS tier, role, metric, count(*) AS n, round(quantile_cont(value, 0.2), 6) AS p20, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.8), 6) AS p80
  FROM (SELECT tier AS t, role, metric, value FROM longr UNION ALL SELECT 'ALL', role, metric, value FROM longr) GROUP BY ALL)"""


def bench_table(s: Star, rates: DataFrame | None = None) -> DataFrame:
    """Percentiles of the ranks; ``rates`` are the build rows with their rates if the caller has them already."""
    rates = G.rates(s.builds()) if rates is None else rates
    long = B.unpivot_metrics(written(rates.select("tier", "role", *RATES), "rates"), ["tier", "role"], RATES)
    out = B.rank_benchmarks(long, "tier", "role")
    return out.select("tier", "role", "metric", "n", *[F.round(c, 6).alias(c) for c in ("p20", "p50", "p80")])


@query("rank_benchmarks", with_sql(RATES_SQL) + "SELECT * FROM bench")
def rank_benchmarks(s: Star) -> DataFrame:
    return bench_table(s)


_RANK = "CASE tier " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(TIERS)) + " END"


@query("benchmark_steps", with_sql(RATES_SQL) + f""",
r AS (SELECT *, {_RANK} AS rk FROM bench WHERE tier <> 'ALL'),
n AS (SELECT *, lead(p50) OVER (PARTITION BY role, metric ORDER BY rk) AS nxt, lead(tier) OVER (PARTITION BY role, metric ORDER BY rk) AS next_tier FROM r),
g AS (SELECT *, round(CASE WHEN metric = 'deaths_10' THEN p50 - nxt ELSE nxt - p50 END / abs(nxt), 5) AS gap FROM n WHERE nxt IS NOT NULL AND nxt <> 0)
SELECT tier, role, arg_max(metric, (gap, metric)) AS metric, max(gap) AS gap FROM g WHERE gap > 0 GROUP BY tier, role""")
def benchmark_steps(s: Star) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    t = bench_table(s).where("tier <> 'ALL'").withColumn("_rk", rank)
    t = previous(t, ["role", "metric"], ["_rk"], {"_next": F.col("p50")}, following=True)
    t = t.where(F.col("_next").isNotNull() & (F.col("_next") != 0))
    step = F.when(F.col("metric") == "deaths_10", F.col("p50") - F.col("_next")).otherwise(F.col("_next") - F.col("p50"))
    t = t.withColumn("gap", F.round(step / F.abs("_next"), 5)).where("gap > 0")
    return t.groupBy("tier", "role").agg(F.max_by("metric", F.struct("gap", "metric")).alias("metric"), F.max("gap").alias("gap"))


CHANGES_SQL = """
changes AS (SELECT p_brand AS champion, CAST(1995 + p_size % 7 AS BIGINT) AS patch, CASE p_size % 3 WHEN 0 THEN 'buff' WHEN 1 THEN 'nerf' ELSE 'adjust' END AS kind,
  CASE WHEN p_size % 5 = 0 THEN 'preview' ELSE 'live' END AS status, p_partkey % 40 AS item FROM part)"""
SHIFT_SQL = CHANGES_SQL + """,
cnt AS (SELECT patch, count(*) AS n FROM games GROUP BY patch),
before AS (SELECT c.patch, coalesce(sum(n.n), 0) / (SELECT sum(n) FROM cnt) AS share_before FROM (SELECT DISTINCT patch FROM changes) c LEFT JOIN cnt n ON n.patch < c.patch GROUP BY c.patch),
weighted AS (SELECT c.*, share_before * CASE kind WHEN 'buff' THEN 1.0 WHEN 'nerf' THEN -1.0 ELSE 0.0 END * CASE WHEN status = 'preview' THEN 0.6 ELSE 1.0 END AS w FROM changes c JOIN before USING (patch)),
shifts AS (SELECT champion, round(sum(w), 5) AS shift, count(*) AS changes FROM weighted GROUP BY champion)"""


def changes(s: Star) -> DataFrame:
    size = F.col("p_size")
    return s.table("part").select(
        F.col("p_brand").alias("champion"), (F.lit(1995) + size % 7).cast("long").alias("patch"),
        F.when(size % 3 == 0, "buff").when(size % 3 == 1, "nerf").otherwise("adjust").alias("kind"),
        F.when(size % 5 == 0, "preview").otherwise("live").alias("status"), (F.col("p_partkey") % 40).alias("item"))


@query("patch_shift", with_sql(GAMES_SQL, SHIFT_SQL) + "SELECT * FROM shifts")
def patch_shift(s: Star) -> DataFrame:
    return G.patch_shift(changes(s), s.games()).withColumn("shift", F.round("shift", 5))


@query("item_patch_shift", with_sql(CARTS_SQL, SHIFT_SQL) + """,
u AS (SELECT champion, item, count(DISTINCT match_id) AS games FROM (SELECT champion, match_id, unnest(list_distinct(purchases)) AS item FROM carts) GROUP BY ALL),
g AS (SELECT champion, count(*) AS n FROM carts GROUP BY 1)
SELECT u.champion, round(sum(w.w * u.games / g.n), 5) AS shift, count(*) AS changes FROM u JOIN g USING (champion) JOIN weighted w ON w.item = u.item
WHERE u.games / g.n >= 0.08 GROUP BY u.champion""")
def item_patch_shift(s: Star) -> DataFrame:
    usage = G.item_usage(s.carts(), ["champion"])
    out = G.patch_shift(changes(s).drop("champion"), s.games(), ["champion"], usage=usage, min_usage=0.08)
    return out.withColumn("shift", F.round("shift", 5))


def bans(s: Star) -> DataFrame:
    return s.lines().where("flag = 'R'").select(F.col("game_id").alias("match_id"), "champion")


BANS_SQL = """
bans AS (SELECT champion, count(DISTINCT game_id) AS bans FROM lines WHERE flag = 'R' GROUP BY champion),
total AS (SELECT count(DISTINCT match_id) AS t FROM builds)"""


@query("ban_rates", with_sql(BUILDS_SQL, BANS_SQL) + "SELECT champion, bans, 100 * bans / t AS ban_rate FROM bans, total")
def ban_rates(s: Star) -> DataFrame:
    return G.ban_rates(bans(s), s.builds())


TIERLIST_SQL = BUILDS_SQL + "," + BANS_SQL + "," + SHIFT_SQL + """,
picks AS (SELECT champion, role, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, sum(kills) AS k, sum(deaths) AS d, sum(assists) AS a FROM builds GROUP BY ALL),
pc AS (SELECT champion, CAST(sum(games) AS BIGINT) AS all_ FROM picks GROUP BY 1),
t AS (SELECT p.champion, p.role, p.games, p.wins, 100 * p.wins / p.games AS win_rate, 100 * ((p.wins + 20.0) / (p.games + 40)) AS win_rate_shrunk, 100 * p.games / t AS pick_rate,
  coalesce(100 * b.bans / t, 0) AS ban_rate, 100 * p.games / all_ AS role_share, CAST(k + a AS DOUBLE) / greatest(CAST(d AS DOUBLE), CAST(0.01 AS DOUBLE) * p.games) AS kda
  FROM picks p JOIN pc USING (champion) LEFT JOIN bans b ON b.champion = p.champion, total WHERE p.games >= 20 AND p.games >= 0.08 * all_),
m AS (SELECT *, round(win_rate_shrunk - 50 + 1.5 * ln(pick_rate / quantile_cont(pick_rate, 0.5) OVER (PARTITION BY role)), 6) AS score_raw FROM t),
sc AS (SELECT m.*, score_raw + coalesce(shift, 0) AS score FROM m LEFT JOIN shifts USING (champion)),
rk AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, champion) AS role_rank, row_number() OVER (PARTITION BY role ORDER BY score_raw DESC, champion) AS rr, count(*) OVER (PARTITION BY role) AS n FROM sc),
tiers AS (
SELECT champion, role, games, wins, win_rate, win_rate_shrunk, pick_rate, ban_rate, role_share, round(kda, 6) AS kda, score_raw, round(score, 9) AS score, role_rank,
  CASE WHEN (rr - 0.5) / n < 0.05 THEN 'S+' WHEN (rr - 0.5) / n < 0.17 THEN 'S' WHEN (rr - 0.5) / n < 0.4 THEN 'A' WHEN (rr - 0.5) / n < 0.7 THEN 'B' WHEN (rr - 0.5) / n < 0.9 THEN 'C' ELSE 'D' END AS tier_raw,
  CASE WHEN (role_rank - 0.5) / n < 0.05 THEN 'S+' WHEN (role_rank - 0.5) / n < 0.17 THEN 'S' WHEN (role_rank - 0.5) / n < 0.4 THEN 'A' WHEN (role_rank - 0.5) / n < 0.7 THEN 'B' WHEN (role_rank - 0.5) / n < 0.9 THEN 'C' ELSE 'D' END AS tier
FROM rk)"""


@query("tier_list", with_sql(TIERLIST_SQL) + "SELECT * FROM tiers")
def tier_list(s: Star) -> DataFrame:
    shifts = patch_shift(s).drop("changes")
    out = G.tier_list(s.builds(), bans(s), shifts)
    return out.withColumn("kda", F.round("kda", 6)).withColumn("score", F.round("score", 9))


@query("item_usage", with_sql(CARTS_SQL) + """,
u AS (SELECT champion, role, item, count(DISTINCT match_id) AS games FROM (SELECT champion, role, match_id, unnest(list_distinct(purchases)) AS item FROM carts) GROUP BY ALL),
g AS (SELECT champion, role, count(*) AS n FROM carts GROUP BY ALL)
SELECT u.champion, u.role, u.item, u.games, g.n AS group_games, u.games / g.n AS share FROM u JOIN g USING (champion, role)""")
def item_usage(s: Star) -> DataFrame:
    return G.item_usage(s.carts(), ["champion", "role"])


@query("matchup_table", with_sql(BUILDS_SQL) + """
SELECT champion, role, opponent, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, avg(gold_diff) AS gold_diff, avg(cs_diff) AS cs_diff, count(gold_diff) AS lane_games,
  100 * ((sum(win::INT) + 20.0) / (count(*) + 40)) AS shrunk FROM builds WHERE opponent IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""")
def matchup_table(s: Star) -> DataFrame:
    return G.matchups(s.builds(), ["gold_diff", "cs_diff"], 3)


@query("counter_picks", with_sql(BUILDS_SQL) + """,
m AS (SELECT opponent, role, champion, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, round(100 * ((sum(win::INT) + 20.0) / (count(*) + 40)), 9) AS shrunk
  FROM builds WHERE opponent IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY opponent, role ORDER BY shrunk DESC, champion) <= 6""")
def counter_picks(s: Star) -> DataFrame:
    m = G.matchups(s.builds(), ["gold_diff"], 2).withColumn("shrunk", F.round("shrunk", 9))
    out = top_per_group(m, ["opponent", "role"], [F.col("shrunk").desc(), F.col("champion")], 6)
    return out.select("opponent", "role", "champion", "games", "wins", "shrunk")


@query("lane_report", with_sql(BUILDS_SQL) + """,
b AS (SELECT *, '*' AS o FROM builds WHERE opponent IS NOT NULL UNION ALL SELECT *, opponent FROM builds WHERE opponent IS NOT NULL)
SELECT champion, o AS opponent, role, count(*) AS n, avg(gold_diff) AS gold, avg(cs_diff) AS cs, avg((gold_diff > 0)::INT) AS ahead, avg((deaths > 4)::INT) AS died, avg((opp_deaths > 4)::INT) AS opp_died,
  avg(win::INT) FILTER (WHERE gold_diff > 0) AS win_ahead, avg(win::INT) FILTER (WHERE gold_diff < 0) AS win_behind,
  count(*) FILTER (WHERE duration_s < 1500) AS short_games, CAST(coalesce(sum(win::INT) FILTER (WHERE duration_s < 1500), 0) AS BIGINT) AS short_wins,
  count(*) FILTER (WHERE duration_s > 1920) AS long_games, CAST(coalesce(sum(win::INT) FILTER (WHERE duration_s > 1920), 0) AS BIGINT) AS long_wins FROM b GROUP BY champion, o, role""")
def lane_report(s: Star) -> DataFrame:
    rows = s.builds().withColumn("deaths", F.greatest(F.col("deaths") - 4, F.lit(0))).withColumn("opp_deaths", F.greatest(F.col("opp_deaths") - 4, F.lit(0)))
    return G.lane_report(rows, "role", "gold_diff", "cs_diff", "deaths", "opp_deaths")


@query("top_choices", with_sql(CARTS_SQL) + """,
x AS (SELECT *, list_filter(list_transform(purchases, lambda p, i: CASE WHEN purchase_s[i] <= 60 THEN p END), lambda p: p IS NOT NULL) AS early FROM carts),
u AS (SELECT match_id, list(item ORDER BY first_pos) AS uniq FROM (SELECT match_id, item, min(pos) AS first_pos FROM (SELECT match_id, unnest(purchases) AS item, generate_subscripts(purchases, 1) AS pos FROM carts) GROUP BY ALL) GROUP BY match_id),
k AS (SELECT x.role, x.win, kind, key FROM (
  SELECT x.role, x.win, 'start' AS kind, CASE WHEN len(early) > 0 THEN array_to_string(list_sort(early), '-') END AS key FROM x UNION ALL
  SELECT x.role, x.win, 'core', CASE WHEN len(uniq) >= 3 THEN array_to_string(uniq[1:3], '-') END FROM x JOIN u USING (match_id) UNION ALL
  SELECT x.role, x.win, 'first', CAST(uniq[1] AS VARCHAR) FROM x JOIN u USING (match_id) UNION ALL
  SELECT x.role, x.win, 'fourth', CAST(uniq[4] AS VARCHAR) FROM x JOIN u USING (match_id) UNION ALL
  SELECT x.role, x.win, 'fifth', CAST(uniq[5] AS VARCHAR) FROM x JOIN u USING (match_id) UNION ALL
  SELECT x.role, x.win, 'sixth', CAST(uniq[6] AS VARCHAR) FROM x JOIN u USING (match_id)) x),
n AS (SELECT role, kind, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT role, kind, key, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM k WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
SELECT r.role, r.kind, r.key, games, wins, 100 * wins / games AS win_rate, 100 * games / n AS pick_rate, row_number() OVER (PARTITION BY r.role, r.kind ORDER BY games DESC, wins DESC, key) AS place
FROM r JOIN n ON n.role = r.role AND n.kind = r.kind QUALIFY place <= 3""")
def top_choices(s: Star) -> DataFrame:
    return G.top_choices(G.build_choices(s.carts()).select("role", "kind", "key", "win"), ["role"])


UNIQ_SQL = CARTS_SQL + """,
u AS (SELECT match_id, list(item ORDER BY first_pos) AS uniq FROM (SELECT match_id, item, min(pos) AS first_pos FROM (SELECT match_id, unnest(purchases) AS item, generate_subscripts(purchases, 1) AS pos FROM carts) GROUP BY ALL) GROUP BY match_id),
seq AS (SELECT c.*, uniq[1] AS item, uniq[2] AS nxt FROM carts c JOIN u USING (match_id))"""


@query("build_paths", with_sql(UNIQ_SQL) + """,
f AS (SELECT role, item, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM seq GROUP BY role, item HAVING count(*) >= 10 QUALIFY row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, item) <= 4),
p AS (SELECT role, item, nxt AS next, count(*) AS next_games, CAST(sum(win::INT) AS BIGINT) AS next_wins FROM seq WHERE nxt IS NOT NULL GROUP BY role, item, nxt HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY role, item ORDER BY count(*) DESC, nxt) <= 3)
SELECT f.role, f.item, f.games, f.wins, p.next, p.next_games, p.next_wins FROM f LEFT JOIN p ON p.role = f.role AND p.item = f.item""")
def build_paths(s: Star) -> DataFrame:
    return G.build_paths(s.carts(), ["role"], min_pair=2)


@query("item_board", with_sql(CARTS_SQL) + """,
h AS (SELECT champion, win, unnest(purchases) AS item FROM carts),
p AS (SELECT item, champion, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM h GROUP BY ALL),
i AS (SELECT item, CAST(sum(games) AS BIGINT) AS games, CAST(sum(wins) AS BIGINT) AS wins FROM p GROUP BY 1 HAVING sum(games) >= 30),
t AS (SELECT item, string_agg(champion, ',' ORDER BY games DESC, champion) AS builders FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY item ORDER BY games DESC, champion) <= 4) GROUP BY item)
SELECT item, games, wins, 100 * wins / games AS win_rate, 100 * ((wins + 20.0) / (games + 40)) AS shrunk, 100 * games / (SELECT count(*) FROM carts) AS pick_rate, builders FROM i JOIN t USING (item)""")
def item_board(s: Star) -> DataFrame:
    return G.item_board(s.carts())


@query("matchup_detail", with_sql(BUILDS_SQL) + """
SELECT champion, opponent, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, count(*) FILTER (WHERE tier = 'AUTOMOBILE') AS high_games,
  CAST(coalesce(sum(win::INT) FILTER (WHERE tier = 'AUTOMOBILE'), 0) AS BIGINT) AS high_wins, max(match_id) FILTER (WHERE tier = 'AUTOMOBILE') AS last_high_game FROM builds WHERE opponent IS NOT NULL GROUP BY ALL""")
def matchup_detail(s: Star) -> DataFrame:
    high = F.col("tier") == "AUTOMOBILE"
    return G.record(s.builds().where("opponent IS NOT NULL"), ["champion", "opponent"], F.count(F.when(high, 1)).alias("high_games"),
                    F.coalesce(F.sum(F.when(high, F.col("win").cast("int"))), F.lit(0)).alias("high_wins"),
                    F.max(F.when(high, F.col("match_id"))).alias("last_high_game"))


LENGTH_SQL = "CASE WHEN duration_s < 1200 THEN 'under 20' WHEN duration_s < 1500 THEN '20-25' WHEN duration_s < 1800 THEN '25-30' WHEN duration_s < 2100 THEN '30-35' WHEN duration_s < 2400 THEN '35-40' ELSE '40+' END"


@query("win_by_length", with_sql(BUILDS_SQL) + f"SELECT champion, {LENGTH_SQL} AS length, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM builds GROUP BY ALL")
def win_by_length(s: Star) -> DataFrame:
    b = s.builds().withColumn("length", E.bucket("duration_s", E.LENGTH_EDGES, E.LENGTH_LABELS))
    return G.record(b, ["champion", "length"])


@query("win_by_patch", with_sql(BUILDS_SQL) + """
SELECT champion, patch, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM builds GROUP BY champion, patch HAVING count(*) >= 10 QUALIFY row_number() OVER (PARTITION BY champion ORDER BY patch DESC) <= 5""")
def win_by_patch(s: Star) -> DataFrame:
    r = G.record(s.builds(), ["champion", "patch"]).where("games >= 10")
    return top_per_group(r, ["champion"], [E.patch_key("patch").desc()], 5)


@query("mains", with_sql(BUILDS_SQL) + """,
p AS (SELECT player, champion, count(*) AS games FROM builds GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY games DESC, champion) AS place FROM p),
r AS (SELECT player, role, count(*) AS n FROM builds GROUP BY ALL), m AS (SELECT player, role AS main_role FROM r QUALIFY row_number() OVER (PARTITION BY player ORDER BY n DESC, role) = 1)
SELECT player, place, champion, games, main_role FROM t JOIN m USING (player) WHERE place <= 3""")
def mains(s: Star) -> DataFrame:
    return G.mains(s.builds())


OBJ_SQL = LINES_SQL + """,
o AS (SELECT game_id AS match_id, team, class AS objective, count(*) AS kills, min(slot) AS first_slot, bool_or(win) AS win, min(duration_s) AS duration_s FROM lines GROUP BY ALL),
obj AS (SELECT *, row_number() OVER (PARTITION BY match_id, objective ORDER BY first_slot, team) = 1 AS first FROM o)"""


def objectives(s: Star) -> DataFrame:
    o = s.lines().groupBy(F.col("game_id").alias("match_id"), "team", F.col("class").alias("objective")).agg(
        F.count(F.lit(1)).alias("kills"), F.min("slot").alias("first_slot"), F.bool_or("win").alias("win"), F.min("duration_s").alias("duration_s"))
    first = o.groupBy("match_id", "objective").agg(F.min(F.struct("first_slot", "team")).alias("_f"))
    return o.join(first, ["match_id", "objective"]).withColumn("first", F.col("_f.team") == F.col("team")).drop("_f")


@query("first_objectives", with_sql(OBJ_SQL) + """,
g AS (SELECT count(DISTINCT match_id) AS n FROM obj)
SELECT objective, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, 100 * count(*) / any_value(n) AS happened, 100 * sum(win::INT) / count(*) AS win_rate FROM obj, g WHERE first GROUP BY objective HAVING 100 * count(*) / any_value(n) >= 5""")
def first_objectives(s: Star) -> DataFrame:
    return G.first_objectives(objectives(s))


@query("objective_counts", with_sql(OBJ_SQL) + """
SELECT team, least(kills, 4) AS taken, count(*) AS teams, CAST(sum(win::INT) AS BIGINT) AS wins FROM obj WHERE objective = 'ECONOMY' GROUP BY ALL""")
def objective_counts(s: Star) -> DataFrame:
    o = objectives(s).where("objective = 'ECONOMY'").withColumn("taken", F.least("kills", F.lit(4)))
    return o.groupBy("team", "taken").agg(F.count(F.lit(1)).alias("teams"), G.wins().alias("wins"))


@query("game_lengths", with_sql(GAMES_SQL) + f"""
SELECT {LENGTH_SQL} AS length, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, 100 * count(*) / (SELECT count(*) FROM games) AS share FROM games GROUP BY 1""")
def game_lengths(s: Star) -> DataFrame:
    g = s.games().withColumn("length", E.bucket("duration_s", E.LENGTH_EDGES, E.LENGTH_LABELS))
    total = g.select(F.count(F.lit(1)).alias("_t"))
    return G.record(g, ["length"]).crossJoin(F.broadcast(total)).withColumn("share", 100 * F.col("games") / F.col("_t")).drop("_t")


@query("lead_buckets", with_sql(LINES_SQL) + """,
t AS (SELECT game_id, team, CAST(sum(price) AS BIGINT) AS gold, bool_or(win) AS win FROM lines WHERE slot <= 5 GROUP BY ALL),
l AS (SELECT a.win, a.gold // 20 - b.gold // 20 AS lead FROM t a JOIN t b ON a.game_id = b.game_id AND a.team <> b.team)
SELECT CASE WHEN lead < -5000 THEN '5k+ behind' WHEN lead < -3000 THEN '3-5k behind' WHEN lead < -1500 THEN '1.5-3k behind' WHEN lead < -500 THEN '0.5-1.5k behind' WHEN lead < 500 THEN 'even'
  WHEN lead < 1500 THEN '0.5-1.5k ahead' WHEN lead < 3000 THEN '1.5-3k ahead' WHEN lead < 5000 THEN '3-5k ahead' ELSE '5k+ ahead' END AS label,
  count(*) AS teams, CAST(sum(win::INT) AS BIGINT) AS wins, count(*) FILTER (WHERE lead <= -3000) AS behind, CAST(coalesce(sum(win::INT) FILTER (WHERE lead <= -3000), 0) AS BIGINT) AS comebacks FROM l GROUP BY 1""")
def lead_buckets(s: Star) -> DataFrame:
    t = s.lines().where("slot <= 5").groupBy(F.col("game_id").alias("match_id"), "team").agg(
        F.floor(F.sum("price") / 20).alias("gold"), F.bool_or("win").alias("win"))
    return G.lead_buckets(t, "gold", E.LEAD_EDGES, E.LEAD_LABELS, -3000)


TOT_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in G.TOTALS)


def _rate_sql(p: str = "") -> list[str]:
    m = f"({p}duration_s / 60)"
    return [f"100 * {p}wins / {p}games", f"({p}kills + {p}assists) / greatest({p}deaths, 1)", f"{p}cs / {m}", f"{p}damage / {m}", f"{p}gold / {m}", f"{p}vision / {m}", f"{p}deaths / ({m} / 10)"]


_RATE_NAMES = ("win_rate", "kda", "cs_min", "dmg_min", "gold_min", "vision_min", "deaths_10")
_NUM = ("games", "wins", *G.TOTALS)


@query("peer_comparison", with_sql(BUILDS_SQL) + f""",
mine AS (SELECT player, champion, tier, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, {TOT_SQL} FROM builds GROUP BY ALL),
at_ AS (SELECT champion, tier, {", ".join(f"CAST(sum({c}) AS BIGINT) AS t_{c}" for c in _NUM)} FROM mine GROUP BY ALL),
al AS (SELECT champion, {", ".join(f"CAST(sum({c}) AS BIGINT) AS a_{c}" for c in _NUM)} FROM mine GROUP BY ALL),
ow AS (SELECT champion, player, {", ".join(f"CAST(sum({c}) AS BIGINT) AS o_{c}" for c in _NUM)} FROM mine GROUP BY ALL),
j AS (SELECT m.*, CASE WHEN t_games - games >= 20 THEN 'tier' ELSE 'all' END AS peers, {", ".join(f"CASE WHEN t_games - games >= 20 THEN t_{c} - {c} ELSE a_{c} - o_{c} END AS p_{c}" for c in _NUM)}
  FROM mine m JOIN at_ USING (champion, tier) JOIN al USING (champion) JOIN ow USING (champion, player))
SELECT player, champion, tier, games, peers, p_games AS peer_games, {", ".join(f"{x} AS {n}" for x, n in zip(_rate_sql(), _RATE_NAMES))}, {", ".join(f"{x} AS peer_{n}" for x, n in zip(_rate_sql("p_"), _RATE_NAMES))}
FROM j WHERE p_games > 0""")
def peer_comparison(s: Star) -> DataFrame:
    return G.against_peers(s.builds())


@query("champion_table", with_sql(BUILDS_SQL) + f""",
t AS (SELECT player, patch, champion, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, {TOT_SQL}, max(kills) AS best_kills FROM builds GROUP BY ALL)
SELECT player, patch, champion, games, wins, best_kills, {", ".join(f"{x} AS {n}" for x, n in zip(_rate_sql(), _RATE_NAMES))} FROM t""")
def champion_table(s: Star) -> DataFrame:
    t = G.record(s.builds(), ["player", "patch", "champion"], *[F.sum(c).alias(c) for c in G.TOTALS], F.max("kills").alias("best_kills"))
    return t.select("player", "patch", "champion", "games", "wins", "best_kills", *G.total_rates(t))


FORM_SQL = BUILDS_SQL + """,
l AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY start_s DESC, match_id DESC, role, team) AS b FROM builds QUALIFY b <= 20),
form AS (SELECT player, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, avg(kills) AS kills, avg(deaths) AS deaths, avg(assists) AS assists, count(DISTINCT champion) AS champions,
  CAST(CASE WHEN coalesce(min(b) FILTER (WHERE win), 99) = 1 THEN coalesce(min(b) FILTER (WHERE NOT win), count(*) + 1) - 1 ELSE -(coalesce(min(b) FILTER (WHERE win), count(*) + 1) - 1) END AS BIGINT) AS streak,
  arg_max(match_id, (damage, match_id)) AS best_game FROM l GROUP BY player)"""


@query("form_summary", with_sql(FORM_SQL) + "SELECT * FROM form")
def form_summary(s: Star) -> DataFrame:
    return G.form(s.builds(), 20)


@query("compare_players", with_sql(FORM_SQL) + """,
x AS (UNPIVOT (SELECT player, CAST(wins AS DOUBLE) AS wins, CAST(kills AS DOUBLE) AS kills, CAST(deaths AS DOUBLE) AS deaths, CAST(champions AS DOUBLE) AS champions FROM form) ON wins, kills, deaths, champions INTO NAME stat VALUE v)
SELECT a.player AS a, b.player AS b, a.stat, a.v AS va, b.v AS vb, CASE WHEN a.v = b.v THEN 'even' WHEN (a.v > b.v) = (a.stat <> 'deaths') THEN 'a' ELSE 'b' END AS better
FROM x a JOIN x b ON b.player = a.player + 1 AND b.stat = a.stat""")
def compare_players(s: Star) -> DataFrame:
    """Each player beside the next one."""
    stats = dimension(G.form(s.builds(), 20))
    pairs = stats.select(F.col("player").alias("a"), (F.col("player") + 1).alias("b"))
    return G.compare(stats, pairs, {"wins": True, "kills": True, "deaths": False, "champions": True})


@query("champion_players", with_sql(BUILDS_SQL) + f""",
t AS (SELECT champion, player, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, CAST(sum(cs) AS BIGINT) AS cs, CAST(sum(duration_s) AS BIGINT) AS d FROM builds GROUP BY ALL HAVING count(*) >= 5)
SELECT champion, player, games, wins, cs / (d / 60.0) AS cs_min FROM t QUALIFY row_number() OVER (PARTITION BY champion ORDER BY games DESC, wins DESC, player) <= 8""")
def champion_players(s: Star) -> DataFrame:
    t = G.record(s.builds(), ["champion", "player"], F.sum("cs").alias("_cs"), F.sum("duration_s").alias("_d")).where("games >= 5")
    t = top_per_group(t, ["champion"], [F.col("games").desc(), F.col("wins").desc(), F.col("player")], 8)
    return t.select("champion", "player", "games", "wins", (F.col("_cs") / (F.col("_d") / 60.0)).alias("cs_min"))


@query("personal_matchups", with_sql(BUILDS_SQL) + """,
r AS (SELECT player, champion, opponent, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM builds WHERE opponent IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT *, (wins - games / 2) / sqrt(games) AS edge FROM r)
SELECT player, champion, opponent, games, wins, edge, CASE WHEN edge < 0 THEN 'hard' ELSE 'easy' END AS side FROM e WHERE edge <> 0
QUALIFY row_number() OVER (PARTITION BY player, edge < 0 ORDER BY abs(edge) DESC, champion, opponent) <= 6""")
def personal_matchups(s: Star) -> DataFrame:
    return G.personal_matchups(s.builds())


PERF_SQL = BUILDS_SQL + """,
f AS (SELECT *, least(10.0, (kills + assists) / greatest(1, deaths)) AS c1, (kills + assists) / greatest(1, team_kills) AS c2, damage / greatest(1.0, duration_s / 60) AS c3, gold / greatest(1.0, duration_s / 60) AS c4,
  cs / greatest(1.0, duration_s / 60) AS c5, vision / greatest(1.0, duration_s / 60) AS c6, CAST(-deaths AS DOUBLE) AS c7 FROM builds),
z AS (SELECT *, CASE WHEN win THEN 0.6 ELSE 0.0 END""" + "".join(
    f" + {w} * (c{i} - avg(c{i}) OVER m) / CASE WHEN stddev_pop(c{i}) OVER m > 1e-9 THEN stddev_pop(c{i}) OVER m ELSE 1.0 END"
    for i, w in enumerate((1.4, 1.2, 1.0, 0.8, 0.5, 0.5, 0.8), 1)) + """ AS raw FROM f WINDOW m AS (PARTITION BY match_id)),
sp AS (SELECT *, min(raw) OVER m AS lo, max(raw) OVER m AS hi, row_number() OVER (PARTITION BY match_id, win ORDER BY round(raw, 6) DESC, role, team DESC) AS rk FROM z WINDOW m AS (PARTITION BY match_id))"""


@query("performance_score", with_sql(PERF_SQL) + """
SELECT match_id, team, role, round(CASE WHEN hi - lo > 1e-9 THEN 3 + 7 * (raw - lo) / (hi - lo) ELSE 5.0 END, 4) AS score, CASE WHEN rk = 1 THEN CASE WHEN win THEN 'MVP' ELSE 'ACE' END END AS award FROM sp""")
def performance_score(s: Star) -> DataFrame:
    return G.performance(s.builds(), digits=4).select("match_id", "team", "role", "score", "award")


@query("season_recap", with_sql(BUILDS_SQL) + f""",
b AS (SELECT player, patch, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins, {TOT_SQL} FROM builds GROUP BY ALL),
c AS (SELECT player, patch, champion, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM builds GROUP BY ALL),
t AS (SELECT player, patch, count(*) AS champions, arg_max(champion, (games, champion)) AS top_champion, arg_max(champion, ((wins + 20.0) / (games + 40), champion)) FILTER (WHERE games >= 8) AS best_champion FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, row_number() OVER w - row_number() OVER (PARTITION BY player, patch, win ORDER BY start_s, match_id, role, team) AS g FROM builds WINDOW w AS (PARTITION BY player, patch ORDER BY start_s, match_id, role, team)),
u AS (SELECT player, patch, win, g, count(*) AS n, max(rn) AS last FROM r GROUP BY ALL),
k AS (SELECT player, patch, coalesce(max(n) FILTER (WHERE win), 0) AS longest_win, coalesce(max(n) FILTER (WHERE NOT win), 0) AS longest_loss, arg_max(CASE WHEN win THEN n ELSE -n END, last) AS current_run FROM u GROUP BY ALL)
SELECT b.*, duration_s / 3600.0 AS hours, champions, top_champion, best_champion, longest_win, longest_loss, current_run FROM b JOIN t USING (player, patch) JOIN k USING (player, patch)""")
def season_recap(s: Star) -> DataFrame:
    return G.recap(s.builds())


@query("activity_heat_map", """
SELECT user_id, dayofweek(l) + 1 AS weekday, hour(l) AS hour, count(*) AS games, CAST(sum((event_type = 'purchase')::INT) AS BIGINT) AS wins
FROM (SELECT *, ts + INTERVAL 9 HOUR AS l FROM events) GROUP BY ALL""")
def activity_heat_map(s: Star) -> DataFrame:
    e = s.events().withColumn("win", F.col("event_type") == "purchase")
    return G.heat_map(e, "ts", "Asia/Tokyo", ["user_id"])


@query("season_badges", with_sql(BUILDS_SQL) + """,
f AS (SELECT player, patch, count(*) AS n, sum(win::INT) AS w, count(*) FILTER (WHERE deaths = 0) AS clean, count(*) FILTER (WHERE win AND gold_diff <= -25000) AS back, 60 * sum(vision) / sum(duration_s) AS vis,
  count(*) FILTER (WHERE duration_s >= 2400) AS long_, max(cs) AS cs FROM builds GROUP BY ALL)
SELECT player, patch, unnest(list_filter([CASE WHEN clean >= 5 THEN 'untouchable' END, CASE WHEN back >= 3 THEN 'comeback' END, CASE WHEN vis >= 0.9 AND n >= 20 THEN 'eyes' END, CASE WHEN long_ >= 20 THEN 'marathon' END,
  CASE WHEN n >= 100 THEN 'grinder' END, CASE WHEN cs >= 150 THEN 'farmer' END], lambda x: x IS NOT NULL)) AS badge FROM f""")
def season_badges(s: Star) -> DataFrame:
    c = lambda cond: F.count(F.when(cond, 1))
    facts = s.builds().groupBy("player", "patch").agg(
        F.count(F.lit(1)).alias("n"), c(F.col("deaths") == 0).alias("clean"), c(F.col("win") & (F.col("gold_diff") <= -25000)).alias("back"),
        (60 * F.sum("vision") / F.sum("duration_s")).alias("vis"), c(F.col("duration_s") >= 2400).alias("long"), F.max("cs").alias("cs"))
    col = F.col
    rules = [("untouchable", col("clean") >= 5), ("comeback", col("back") >= 3), ("eyes", (col("vis") >= 0.9) & (col("n") >= 20)),
             ("marathon", col("long") >= 20), ("grinder", col("n") >= 100), ("farmer", col("cs") >= 150)]
    return G.badges(facts, ["player", "patch"], rules)


@query("personal_records", with_sql(BUILDS_SQL) + """,
v AS (SELECT player, match_id, role, team, 'most_kills' AS record, CAST(kills AS DOUBLE) AS value FROM builds UNION ALL
  SELECT player, match_id, role, team, 'most_damage', CAST(damage AS DOUBLE) FROM builds UNION ALL
  SELECT player, match_id, role, team, 'best_farm', CAST(cs / (duration_s / 60) AS DOUBLE) FROM builds WHERE duration_s >= 1200 UNION ALL
  SELECT player, match_id, role, team, 'fastest_win', CAST(-duration_s AS DOUBLE) FROM builds WHERE win)
SELECT player, record, value, match_id, role, team FROM v QUALIFY row_number() OVER (PARTITION BY player, record ORDER BY value DESC, match_id DESC, role DESC, team DESC) = 1""")
def personal_records(s: Star) -> DataFrame:
    c = F.col
    specs = {"most_kills": c("kills"), "most_damage": c("damage"), "best_farm": F.when(c("duration_s") >= 1200, c("cs") / (c("duration_s") / 60)),
             "fastest_win": F.when(c("win"), -c("duration_s"))}
    return G.records(s.builds(), "player", specs, ["match_id", "role", "team"])


@query("champions_to_try", with_sql(TIERLIST_SQL) + """,
cls AS (SELECT DISTINCT p_brand AS champion, p_type AS class FROM part WHERE p_partkey % 7 = 0),
per AS (SELECT player, champion, role, count(*) AS games, sum(win::INT) AS wins FROM builds GROUP BY ALL),
main AS (SELECT player, role FROM (SELECT player, role, sum(games) AS n FROM per GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY player ORDER BY n DESC, role) = 1),
played AS (SELECT player, champion, sum(games) AS played FROM per GROUP BY ALL),
best AS (SELECT p.player, p.champion FROM per p JOIN main USING (player, role) WHERE games >= 2 QUALIFY row_number() OVER (PARTITION BY p.player ORDER BY round((wins + 20.0) / (games + 40), 9) DESC, p.champion) <= 2),
tags AS (SELECT DISTINCT player, class FROM best JOIN cls USING (champion)),
shared AS (SELECT t.player, c.champion, count(*) AS n FROM tags t JOIN cls c USING (class) GROUP BY ALL),
cand AS (SELECT m.player, m.role, t.champion, t.tier, round(CASE t.tier WHEN 'S+' THEN 3 WHEN 'S' THEN 2 ELSE 1 END + coalesce(h.n, 0) + t.win_rate / 100, 6) AS score
  FROM main m JOIN tiers t ON t.role = m.role AND t.tier IN ('S+', 'S', 'A') LEFT JOIN played p ON p.player = m.player AND p.champion = t.champion
  LEFT JOIN shared h ON h.player = m.player AND h.champion = t.champion WHERE coalesce(played, 0) < 20 AND t.champion IN (SELECT champion FROM cls))
SELECT player, role, row_number() OVER (PARTITION BY player ORDER BY score DESC, champion) AS place, champion, tier, score FROM cand QUALIFY place <= 4""")
def champions_to_try(s: Star) -> DataFrame:
    classes = s.table("part").select(F.col("p_brand").alias("champion"), F.col("p_type").alias("class"), "p_partkey").where("p_partkey % 7 = 0")
    return G.to_try(tier_list(s), s.builds(), classes.drop("p_partkey").distinct(), min_best=2, max_played=20)


@query("champion_magic_share", with_sql(LINES_SQL) + "SELECT champion, sum(discount) / sum(quantity) AS magic_share FROM lines GROUP BY champion")
def champion_magic_share(s: Star) -> DataFrame:
    return G.magic_share(s.lines(), "discount", "quantity")


@query("popular_items", with_sql(CARTS_SQL) + """
SELECT champion, item, count(*) AS games FROM (SELECT champion, unnest(purchases) AS item FROM carts) GROUP BY champion, item QUALIFY row_number() OVER (PARTITION BY champion ORDER BY count(*) DESC, item) <= 8""")
def popular_items(s: Star) -> DataFrame:
    held = s.carts().select("champion", F.explode("purchases").alias("item")).groupBy("champion", "item").agg(F.count(F.lit(1)).alias("games"))
    return top_per_group(held, ["champion"], [F.col("games").desc(), F.col("item")], 8)


@query("composition_table", with_sql(LINES_SQL) + """,
t AS (SELECT game_id, team, sum(discount) / sum(quantity) AS share, bool_or(win) AS win, sum((class = 'LARGE')::INT) AS tanks FROM lines GROUP BY ALL)
SELECT CAST(least(tanks, 2) AS BIGINT) AS tanks, least(9, CAST(floor(share * 10) AS BIGINT)) AS tenth, count(*) AS teams, CAST(sum(win::INT) AS BIGINT) AS wins FROM t GROUP BY ALL""")
def composition_table(s: Star) -> DataFrame:
    t = composition(s)
    return t.groupBy("tanks", "tenth").agg(F.count(F.lit(1)).alias("teams"), G.wins().alias("wins"))


def composition(s: Star) -> DataFrame:
    share = F.sum("discount") / F.sum("quantity")
    t = s.lines().groupBy("game_id", "team").agg(share.alias("share"), F.bool_or("win").alias("win"),
                                               F.sum((F.col("class") == "LARGE").cast("int")).alias("_tanks"))
    return t.select("win", F.least(F.col("_tanks"), F.lit(2)).alias("tanks"), F.least(F.lit(9), F.floor(F.col("share") * 10)).cast("long").alias("tenth"))


@query("merged_bins", with_sql(LINES_SQL) + """,
t AS (SELECT sum(discount) / sum(quantity) AS share, bool_or(win) AS win FROM lines GROUP BY game_id, team),
b AS (SELECT least(9, CAST(floor(share * 10) AS BIGINT)) AS lo, count(*) AS n, CAST(sum(win::INT) AS BIGINT) AS w, row_number() OVER (ORDER BY lo) AS rn FROM t GROUP BY 1),
r AS (WITH RECURSIVE f(rn, bin, lo, n, w) AS (SELECT rn, 1, lo, n, w FROM b WHERE rn = 1
   UNION ALL SELECT b.rn, CASE WHEN f.n < 800 THEN f.bin ELSE f.bin + 1 END, CASE WHEN f.n < 800 THEN f.lo ELSE b.lo END, CASE WHEN f.n < 800 THEN f.n + b.n ELSE b.n END, CASE WHEN f.n < 800 THEN f.w + b.w ELSE b.w END FROM f JOIN b ON b.rn = f.rn + 1) SELECT * FROM f),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bin ORDER BY rn DESC) = 1),
m AS (SELECT *, CASE WHEN bin = max(bin) OVER () AND n < 800 AND bin > 1 THEN bin - 1 ELSE bin END AS g FROM l)
SELECT CAST(min(lo) AS DOUBLE) AS lo, CAST(sum(n) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS w FROM m GROUP BY g""")
def merged_bins(s: Star) -> DataFrame:
    bins = composition(s).groupBy("tenth").agg(F.count(F.lit(1)).alias("n"), G.wins().alias("w"))
    return G.merged_bins(bins, "tenth", "n", "w", 800)


@query("comfort_table", with_sql(GAMES_SQL) + """,
p AS (SELECT win, row_number() OVER (PARTITION BY player, role ORDER BY start_s, game_id) - 1 AS prior FROM games)
SELECT CASE WHEN prior < 1 THEN '0' WHEN prior < 3 THEN '1-2' WHEN prior < 10 THEN '3-9' WHEN prior < 30 THEN '10-29' ELSE '30+' END AS comfort, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM p GROUP BY 1""")
def comfort_table(s: Star) -> DataFrame:
    from ..operators.history import prior_games
    p = prior_games(s.games(), ["player", "role"], ["start_s", "game_id"])
    return G.record(p.withColumn("comfort", E.bucket("prior_games", E.COMFORT_EDGES, E.COMFORT_LABELS)), ["comfort"])


@query("source_checks", with_sql(EVENTS_SQL) + """,
p AS (SELECT user_id, count(*) AS readings, count(*) FILTER (WHERE event_type = 'error') AS bad, count(*) FILTER (WHERE event_type = 'error') / count(*) AS rate FROM ev GROUP BY user_id),
q AS (SELECT quantile_cont(rate, 0.25) AS q1, quantile_cont(rate, 0.75) AS q3 FROM p)
SELECT user_id, readings, bad, rate, round(q3 + 0.5 * (q3 - q1), 6) AS "limit", rate > q3 + 0.5 * (q3 - q1) AS outlier FROM p, q""")
def source_checks(s: Star) -> DataFrame:
    bad = F.count(F.when(F.col("event_type") == "error", 1))
    per = s.events().groupBy("user_id").agg(F.count(F.lit(1)).alias("readings"), bad.alias("bad"), (bad / F.count(F.lit(1))).alias("rate"))
    return G.outlier_sources(per, "rate", 0.5).withColumn("limit", F.round("limit", 6))


@query("coverage_counts", with_sql(GAMES_SQL) + "SELECT tier, patch, count(DISTINCT game_id) AS games, greatest(0, 500 - count(DISTINCT game_id)) AS missing FROM games GROUP BY ALL")
def coverage_counts(s: Star) -> DataFrame:
    return G.coverage(s.games(), ["tier", "patch"], "game_id", 500)


@query("stratified_sample", with_sql(GAMES_SQL) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY tier, role ORDER BY sha256('seed|' || game_id)) AS round FROM games)
SELECT game_id, tier, role, round FROM r ORDER BY round, sha256('seed|' || tier || '|' || role) LIMIT 60""")
def stratified_sample(s: Star) -> DataFrame:
    return G.stratified_sample(s.games(), ["tier", "role"], "game_id", 60, "seed").select("game_id", "tier", "role", "round")


@query("window_counters", with_sql(EVENTS_SQL) + """
SELECT user_id, (s // 86400) * 86400 AS from_s, count(*) AS requests, CAST(sum(cents) AS BIGINT) AS spent, count(*) > 3 AS over_limit FROM ev GROUP BY ALL""")
def window_counters(s: Star) -> DataFrame:
    return G.window_counters(s.events(), "ts", ["user_id"], "1 day", 3, "cents")


@query("patch_window", with_sql(GAMES_SQL) + """,
p AS (SELECT DISTINCT (patch - 1980) || '.' || (game_id % 3 + 8) AS patch FROM games), k AS (SELECT patch FROM p ORDER BY CAST(split_part(patch, '.', 1) AS INT) DESC, CAST(split_part(patch, '.', 2) AS INT) DESC LIMIT 3)
SELECT patch, CAST(split_part(patch, '.', 1) AS INT) * 24 + CAST(split_part(patch, '.', 2) AS INT) AS running, CASE WHEN CAST(split_part(patch, '.', 1) AS INT) >= 20 THEN CAST(split_part(patch, '.', 1) AS INT) ELSE CAST(split_part(patch, '.', 1) AS INT) + 10 END AS major,
  (SELECT arg_min(patch, CAST(split_part(patch, '.', 1) AS INT) * 100 + CAST(split_part(patch, '.', 2) AS INT)) || '-' || arg_max(patch, CAST(split_part(patch, '.', 1) AS INT) * 100 + CAST(split_part(patch, '.', 2) AS INT)) FROM k) AS patch_window FROM k""")
def patch_window(s: Star) -> DataFrame:
    g = s.games().select(F.concat((F.col("patch") - 1980).cast("string"), F.lit("."), (F.col("game_id") % 3 + 8).cast("string")).alias("patch"))
    newest = B.newest_patches(g, "patch", 3)
    window = B.patch_window(newest, "patch")
    return newest.crossJoin(F.broadcast(window)).select("patch", E.patch_number("patch").alias("running"), E.aligned_patch("patch")["major"].alias("major"), "patch_window")
