"""Ratings, reliability, choices, habits, plans and drafts on the star binding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import joins as J
from ..operators import ratings as R
from ..operators.evaluation import binary_metrics
from ..operators.ordered import top_per_group
from ..operators.scale import written
from .registry import query
from .star import LINES_SQL, Star, with_sql

ORDER = ["start_s", "game_id", "slot", "item", "price"]
STATS = ("quantity", "discount", "tax")
HALVES_SQL = LINES_SQL + """,
m AS (SELECT role, avg(quantity) AS q, avg(discount) AS d, avg(tax) AS t FROM lines GROUP BY role),
adj AS (SELECT l.*, quantity - q AS quantity_adj, discount - d AS discount_adj, tax - t AS tax_adj FROM lines l JOIN m USING (role)),
rn AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY start_s, game_id, slot, item, price) AS rn, count(*) OVER (PARTITION BY supplier) AS n FROM adj),
longs AS (UNPIVOT (SELECT supplier, rn, n, win::INT AS win, quantity_adj, discount_adj, tax_adj FROM rn WHERE n >= 20) ON quantity_adj, discount_adj, tax_adj INTO NAME stat VALUE v),
h AS (SELECT supplier, stat, avg(v) FILTER (WHERE rn % 2 = 1) AS odd, avg(v) FILTER (WHERE rn % 2 = 0) AS even, avg(v) FILTER (WHERE rn <= n // 2) AS early, avg(win) FILTER (WHERE rn > n // 2) AS late_win,
  avg(win) FILTER (WHERE rn <= n // 2) AS early_win, avg(win) FILTER (WHERE rn > n // 2 AND (rn - n // 2) % 2 = 1) AS la, avg(win) FILTER (WHERE rn > n // 2 AND (rn - n // 2) % 2 = 0) AS lb, var_samp(v) AS within FROM longs GROUP BY ALL)"""
MODEL_SQL = """
model AS (SELECT sqrt(greatest(covar_samp(odd, even), 0.25)) AS tau, sqrt(avg(within)) AS sigma, avg(within) / greatest(covar_samp(odd, even), 0.25) AS k FROM h WHERE stat = 'quantity_adj')"""


def adjusted(s: Star) -> DataFrame:
    return R.role_adjusted(s.lines(), "role", STATS)


def half_means(s: Star) -> DataFrame:
    return R.halves(adjusted(s), "supplier", ORDER, [f"{x}_adj" for x in STATS], 20)


@query("reliability", with_sql(HALVES_SQL) + """,
r AS (SELECT stat, count(*) AS players, corr(odd, even) AS s, corr(early, late_win) AS p, corr(early_win, late_win) AS rw, corr(early, early_win) AS rb, corr(la, lb) AS rl FROM h GROUP BY stat)
SELECT stat, players, round(s, 5) AS split_half, round(2 * s / (1 + s), 5) AS reliability, round(p, 5) AS predicts, round(tanh(atanh(p) - 1.96 / sqrt(players - 3)), 5) AS predicts_low, round(tanh(atanh(p) + 1.96 / sqrt(players - 3)), 5) AS predicts_high,
  round((p - rw * rb) / sqrt((1 - rw * rw) * (1 - rb * rb)), 5) AS beyond_win_rate, round(sqrt(greatest(0.0, 2 * rl / (1 + rl))), 5) AS ceiling FROM r""")
def reliability(s: Star) -> DataFrame:
    r = R.reliability(half_means(s))
    return r.select("stat", "players", *[F.round(c, 5).alias(c) for c in r.columns if c not in ("stat", "players")])


@query("rating_model", with_sql(HALVES_SQL, MODEL_SQL) + "SELECT round(tau, 5) AS tau, round(sigma, 5) AS sigma, round(k, 4) AS k FROM model")
def rating_model(s: Star) -> DataFrame:
    m = R.rating_model(half_means(s).where("stat = 'quantity_adj'"))
    return m.select(F.round("tau", 5).alias("tau"), F.round("sigma", 5).alias("sigma"), F.round("k", 4).alias("k"))


RATINGS_SQL = """
ratings AS (SELECT supplier, count(*) AS games, avg(quantity_adj) AS raw, avg(quantity_adj) * any_value(tau) ** 2 / (any_value(tau) ** 2 + any_value(sigma) ** 2 / count(*)) AS rating,
  sqrt(1 / (1 / any_value(tau) ** 2 + count(*) / any_value(sigma) ** 2)) AS sd FROM adj, model GROUP BY supplier)"""


def ratings(s: Star) -> DataFrame:
    model = R.rating_model(half_means(s).where("stat = 'quantity_adj'"))
    return R.player_ratings(adjusted(s), "supplier", "quantity_adj", model)


@query("player_rating", with_sql(HALVES_SQL, MODEL_SQL, RATINGS_SQL) + "SELECT supplier, games, round(raw, 5) AS raw, round(rating, 5) AS rating, round(sd, 5) AS sd FROM ratings")
def player_rating(s: Star) -> DataFrame:
    return ratings(s).select("supplier", "games", *[F.round(c, 5).alias(c) for c in ("raw", "rating", "sd")])


@query("rating_ladder", with_sql(HALVES_SQL, MODEL_SQL, RATINGS_SQL) + """,
mr AS (SELECT supplier, role FROM (SELECT supplier, role, count(*) AS n FROM lines GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY n DESC, role DESC) = 1)
SELECT role, supplier, games, row_number() OVER (PARTITION BY role ORDER BY round(rating, 6) DESC, supplier) AS place FROM ratings JOIN mr USING (supplier) WHERE games >= 10 QUALIFY place <= 15""")
def rating_ladder(s: Star) -> DataFrame:
    roles = s.lines().groupBy("supplier", "role").agg(F.count(F.lit(1)).alias("n"))
    main = roles.groupBy("supplier").agg(F.max_by("role", F.struct("n", "role")).alias("role"))
    return R.ladder(ratings(s), main, "supplier", "role").select("role", "supplier", "games", "place")


CHOICES_SQL = LINES_SQL + """,
ch AS (SELECT game_id, champion, 'item' AS kind, slot, flag AS choice, unnest(CASE WHEN team = 'F' THEN ['all', 'ap_heavy'] ELSE ['all'] END) AS context, (20 + quantity) / 100 AS p, win::INT AS won FROM lines UNION ALL
  SELECT game_id, champion, 'skill', 0, class, 'all', (20 + quantity) / 100, win::INT FROM lines),
cells AS (SELECT champion, kind, slot, choice, context, count(*) AS n, avg(won - p) AS raw, avg(p * (1 - p)) / count(*) AS noise, avg(p) AS expected, avg(won) AS win_rate FROM ch GROUP BY ALL),
sig AS (SELECT kind, count(*) AS cells, CASE WHEN count(*) < 5 THEN 0.0001 ELSE greatest(var_pop(raw) - avg(noise), 0.000016) END AS tau2 FROM cells WHERE context = 'all' AND n >= 20 GROUP BY kind)"""


def choices(s: Star) -> DataFrame:
    l = s.lines()
    p = (20 + F.col("quantity")) / 100
    contexts = F.when(F.col("team") == "F", F.array(F.lit("all"), F.lit("ap_heavy"))).otherwise(F.array(F.lit("all")))
    item = l.select("game_id", "champion", F.lit("item").alias("kind"), "slot", F.col("flag").alias("choice"), F.explode(contexts).alias("context"), p.alias("p"), F.col("win").cast("int").alias("won"))
    skill = l.select("game_id", "champion", F.lit("skill").alias("kind"), F.lit(0).alias("slot"), F.col("class").alias("choice"), F.lit("all").alias("context"), p.alias("p"), F.col("win").cast("int").alias("won"))
    return item.unionByName(skill)


@query("choice_values", with_sql(CHOICES_SQL) + """
SELECT champion, kind, slot, choice, context, n AS games, round(100 * raw, 9) + 0.0 AS raw, round(100 * raw * tau2 / (tau2 + noise), 9) + 0.0 AS value, round(100 * sqrt(tau2 * noise / (tau2 + noise)), 9) AS sd,
  round(100 * expected, 9) AS expected, round(100 * win_rate, 9) AS win_rate FROM cells JOIN sig USING (kind) WHERE n >= 10""")
def choice_values(s: Star) -> DataFrame:
    cells = R.choice_cells(choices(s))
    v = R.choice_values(cells, R.choice_signal(cells))
    return v.select(*R.CELL, "games", *[(F.round(c, 9) + 0.0).alias(c) for c in ("raw", "value", "sd", "expected", "win_rate")])


@query("choice_signal", with_sql(CHOICES_SQL) + "SELECT kind, cells, round(tau2, 7) AS tau2 FROM sig")
def choice_signal(s: Star) -> DataFrame:
    return R.choice_signal(R.choice_cells(choices(s))).withColumn("tau2", F.round("tau2", 7))


@query("choice_reliability", with_sql(CHOICES_SQL) + """,
hh AS (SELECT *, ('0x' || substr(md5(CAST(game_id AS VARCHAR)), 1, 2))::INT % 2 AS h FROM ch WHERE context = 'all'),
pr AS (SELECT champion, kind, slot, choice, count(*) FILTER (WHERE h = 0) AS n0, count(*) FILTER (WHERE h = 1) AS n1, avg(won - p) FILTER (WHERE h = 0) AS r0, avg(won - p) FILTER (WHERE h = 1) AS r1 FROM hh GROUP BY ALL)
SELECT kind, count(*) AS pairs, round(corr(r0, r1), 5) AS r FROM pr WHERE n0 >= 30 AND n1 >= 30 GROUP BY kind""")
def choice_reliability(s: Star) -> DataFrame:
    return R.choice_reliability(choices(s), "game_id").withColumn("r", F.round("r", 5))


@query("attribution_board", with_sql(LINES_SQL) + """
SELECT role, count(*) AS n, avg(quantity) AS mean, avg(quantity) FILTER (WHERE win) AS in_wins, avg(quantity) FILTER (WHERE NOT win) AS in_losses, quantile_cont(quantity, 0.1) AS p10, quantile_cont(quantity, 0.9) AS p90 FROM lines GROUP BY role""")
def attribution_board(s: Star) -> DataFrame:
    return R.role_board(s.lines(), "role", "quantity")


@query("champion_board", with_sql(LINES_SQL) + """,
m AS (SELECT role, avg(quantity) AS m FROM lines GROUP BY role)
SELECT champion, l.role, count(*) AS n, avg(quantity) AS mean, round((avg(quantity) - any_value(m)) * count(*) / (count(*) + 37.0), 6) AS edge FROM lines l JOIN m USING (role) GROUP BY champion, l.role HAVING count(*) >= 15""")
def champion_board(s: Star) -> DataFrame:
    return R.champion_board(s.lines(), "champion", "role", "quantity").withColumn("edge", F.round("edge", 6))


HABIT_SQL = LINES_SQL + """,
dd AS (SELECT supplier, role, quantity AS cost, [h FOR h IN ['any', CASE WHEN discount >= 8 THEN 'while_dead' END, CASE WHEN slot >= 5 THEN 'outnumbered' END, CASE WHEN price >= 90000 THEN 'held_gold' END, CASE WHEN tax = 8 THEN 'late' END] IF h IS NOT NULL] AS hs FROM lines WHERE flag = 'R'),
lh AS (SELECT supplier, role, cost, unnest(hs) AS habit FROM dd)"""


def _habits() -> dict:
    c = F.col
    return {"while_dead": c("discount") >= 8, "outnumbered": c("slot") >= 5, "held_gold": c("price") >= 90000, "late": c("tax") == 8}


@query("habit_norms", with_sql(HABIT_SQL) + """,
g AS (SELECT role, count(*) AS games FROM lines GROUP BY role), h AS (SELECT role, habit, count(*) AS deaths, sum(cost) AS c FROM lh GROUP BY ALL)
SELECT h.role, h.habit, games, h.deaths, h.c / games AS per_game, h.deaths / a.deaths AS share FROM h JOIN g USING (role) JOIN h a ON a.role = h.role AND a.habit = 'any'""")
def habit_norms(s: Star) -> DataFrame:
    l = s.lines()
    return R.habit_norms(l.where("flag = 'R'"), l, ["role"], _habits(), "quantity")


@query("habit_excess", with_sql(HABIT_SQL) + """,
g AS (SELECT role, count(*) AS games FROM lines GROUP BY role), r AS (SELECT role, habit, sum(cost) / any_value(games) AS typical FROM lh JOIN g USING (role) GROUP BY ALL),
pg AS (SELECT supplier, role, count(*) AS games FROM lines GROUP BY ALL), p AS (SELECT supplier, role, habit, count(*) AS deaths, sum(cost) AS c FROM lh GROUP BY ALL)
SELECT p.supplier, p.role, p.habit, p.deaths, c / games AS per_game, typical, round(c / games - typical, 6) AS excess FROM p JOIN pg USING (supplier, role) JOIN r ON r.role = p.role AND r.habit = p.habit""")
def habit_excess(s: Star) -> DataFrame:
    l = s.lines()
    dead = l.where("flag = 'R'")
    mine = R.habit_norms(dead, l, ["supplier", "role"], _habits(), "quantity")
    out = R.habit_excess(mine, R.habit_norms(dead, l, ["role"], _habits(), "quantity"), ["supplier"], ["role"])
    return out.select("supplier", "role", "habit", "deaths", "per_game", "typical", F.round("excess", 6).alias("excess"))


COSTS_SQL = LINES_SQL + """,
tp AS (SELECT role, avg(quantity) AS q, avg(discount * 5) AS d FROM lines GROUP BY role),
costs AS (SELECT supplier, start_s, game_id, slot, item, price, 'deaths' AS candidate, CAST(quantity AS DOUBLE) AS cost, q AS typical FROM lines JOIN tp USING (role) UNION ALL
  SELECT supplier, start_s, game_id, slot, item, price, 'economy', CAST(discount * 5 AS DOUBLE), d FROM lines JOIN tp USING (role)),
bk AS (SELECT *, row_number() OVER (PARTITION BY supplier, candidate ORDER BY start_s DESC, game_id DESC, slot DESC, item DESC, price DESC) AS b FROM costs)"""


def plan_costs(s: Star) -> DataFrame:
    l = s.lines()
    typical = l.groupBy("role").agg(F.avg("quantity").alias("_q"), F.avg(F.col("discount") * 5).alias("_d"))
    pairs = F.array(F.struct(F.lit("deaths").alias("candidate"), F.col("quantity").cast("double").alias("cost"), F.col("_q").alias("typical")),
                    F.struct(F.lit("economy").alias("candidate"), (F.col("discount") * 5).cast("double").alias("cost"), F.col("_d").alias("typical")))
    return l.join(typical, "role").select("supplier", *ORDER, F.explode(pairs).alias("_x")).select("supplier", *ORDER, "_x.*")


@query("plan", with_sql(COSTS_SQL) + """,
p AS (SELECT supplier, candidate, count(*) AS games, avg(cost) AS mine, avg(typical) AS typical, count(*) FILTER (WHERE b BETWEEN 11 AND 30) AS nb, avg(cost) FILTER (WHERE b <= 10) AS l, avg(cost) FILTER (WHERE b BETWEEN 11 AND 30) AS o,
  1.96 * sqrt(coalesce(var_samp(cost) FILTER (WHERE b <= 10), 0) / greatest(count(*) FILTER (WHERE b <= 10), 1) + coalesce(var_samp(cost) FILTER (WHERE b BETWEEN 11 AND 30), 0) / greatest(count(*) FILTER (WHERE b BETWEEN 11 AND 30), 1)) AS margin FROM bk GROUP BY ALL),
w AS (SELECT *, round(mine - typical, 6) AS excess FROM p QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY round(mine - typical, 6) DESC, candidate) = 1)
SELECT supplier, candidate, games, mine, round(typical, 6) AS typical, excess, round(CASE WHEN excess <= 2 THEN typical ELSE mine - excess / 2 END, 5) AS target, round(margin, 5) AS margin,
  CASE WHEN nb = 0 THEN 'early' WHEN o - l > margin THEN 'better' WHEN l - o > margin THEN 'worse' ELSE 'steady' END AS verdict FROM w""")
def plan(s: Star) -> DataFrame:
    p = R.plan(plan_costs(s), "supplier", ORDER)
    return p.select("supplier", "candidate", "games", "mine", F.round("typical", 6).alias("typical"), "excess", F.round("target", 5).alias("target"), F.round("margin", 5).alias("margin"), "verdict")


@query("plan_blocks", with_sql(COSTS_SQL) + "SELECT supplier, candidate, (b - 1) // 5 AS block, avg(cost) AS cost, round(avg(typical), 6) AS typical FROM bk GROUP BY ALL HAVING count(*) = 5")
def plan_blocks(s: Star) -> DataFrame:
    return R.plan_blocks(plan_costs(s), "supplier", ORDER).withColumn("typical", F.round("typical", 6))


DRAFT_SQL = LINES_SQL + """,
st AS (SELECT role, champion, count(*) AS n, sum(win::INT) AS w FROM lines GROUP BY ALL),
seat AS (SELECT game_id, team, champion, max(win::INT) AS w FROM lines GROUP BY ALL),
pr AS (SELECT a.champion, b.champion AS other, a.team = b.team AS t, count(*) AS n, sum(a.w) AS w FROM seat a JOIN seat b ON a.game_id = b.game_id AND a.champion <> b.champion GROUP BY ALL),
dr AS (SELECT game_id AS draft, min(role) AS role, min(supplier) AS player, list_sort(list(DISTINCT champion) FILTER (WHERE team = 'F')) AS allies, list_sort(list(DISTINCT champion) FILTER (WHERE team = 'O')) AS enemies FROM lines GROUP BY game_id),
cand AS (SELECT d.*, s.champion, (s.w + 50.0) / (s.n + 100.0) AS base FROM dr d JOIN st s USING (role) WHERE s.n >= 20),
al AS (SELECT c.draft, c.champion, greatest(-0.20, least(0.20, sum(ln(((coalesce(p.w, 0) + 150.0 * base) / (coalesce(p.n, 0) + 150.0)) / (1 - (coalesce(p.w, 0) + 150.0 * base) / (coalesce(p.n, 0) + 150.0))) - ln(base / (1 - base))))) AS x
  FROM (SELECT draft, champion, base, unnest(allies) AS other FROM cand) c LEFT JOIN pr p ON p.champion = c.champion AND p.other = c.other AND p.t GROUP BY ALL)
SELECT draft, c.champion, round(ln(base / (1 - base)), 5) AS strength_x, round(coalesce(a.x, 0.0), 5) + 0.0 AS allies_x FROM cand c LEFT JOIN al a USING (draft, champion)"""


def drafts(l: DataFrame) -> DataFrame:
    """Each game asks about every champion with enough games in the role."""
    pick = lambda side: F.array_sort(F.collect_set(F.when(F.col("team") == side, F.col("champion"))))
    d = l.groupBy(F.col("game_id").alias("draft")).agg(F.min("role").alias("role"), F.min("supplier").alias("player"), pick("F").alias("allies"), pick("O").alias("enemies"))
    strong = l.groupBy("role", "champion").agg(F.count(F.lit(1)).alias("games")).where("games >= 20")
    asked = strong.groupBy("role").agg(F.sort_array(F.collect_list("champion")).alias("champions"))  # of a role's few champions
    return d.join(F.broadcast(asked), "role").withColumn("opponent", F.try_element_at("enemies", F.lit(1)))


def draft_table(s: Star) -> DataFrame:
    l = written(s.lines().select("game_id", "slot", "team", "champion", "role", "win", "supplier"), "lines")
    rec = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), F.sum(F.col("win").cast("int")).alias("wins"))
    faced = J.opponents(l.select("game_id", "slot", "team", "champion", "role", "win"), "game_id", "slot", "team", {"opponent": "champion"})
    pairs = written(J.pair_records(l, "game_id", "team", "champion", "win"), "pairs")
    return R.draft_scores(written(drafts(l), "drafts"), rec(l, ["role", "champion"]), rec(faced, ["role", "champion", "opponent"]), pairs.where("together"),
                          pairs.where("NOT together"), rec(l.withColumnRenamed("supplier", "_p").withColumn("player", F.col("_p")), ["player", "champion"]))


@query("draft_score", with_sql(DRAFT_SQL.split("\nSELECT draft")[0]) + "\nSELECT draft" + DRAFT_SQL.split("\nSELECT draft")[1])
def draft_score(s: Star) -> DataFrame:
    return draft_table(s).select("draft", "champion", F.round("strength_x", 5).alias("strength_x"), (F.round("allies_x", 5) + 0.0).alias("allies_x"))


@query("draft_top")
def draft_top(s: Star) -> DataFrame:
    """The best candidates of every draft with all parts."""
    t = draft_table(s)
    t = t.select("draft", "champion", *[F.round(c, 6).alias(c) for c in t.columns if c not in ("draft", "champion")])
    return top_per_group(t, ["draft"], [F.col("total").desc(), F.col("champion")], 3, "place")


PRE_SQL = LINES_SQL + """,
pl AS (SELECT supplier, start_s, game_id, slot, item, price, team, win, quantity - 25 AS v FROM lines),
b AS (SELECT *, avg(v) OVER w AS mean, count(v) OVER w AS n FROM pl WINDOW w AS (PARTITION BY supplier ORDER BY start_s, game_id, slot, item, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, coalesce(mean * n / (n + 37.0), 0.0) AS rating FROM b),
g AS (SELECT game_id, sum(CASE team WHEN 'F' THEN rating ELSE -rating END) AS d, sqrt(sum(9.0 / (1 + n / 37.0))) AS sd, count(*) FILTER (WHERE n > 0) AS known FROM r GROUP BY game_id)"""


def pregame_players(s: Star) -> DataFrame:
    p = s.lines().select("supplier", *ORDER, "team", "win", (F.col("quantity") - 25).alias("v"), "status")
    b = H.rating_before(p, ["supplier"], ORDER, "v")
    n = F.col("games_before")
    return b.select("game_id", F.when(F.col("team") == "F", 100).otherwise(200).alias("team"), "status",
                    F.coalesce(F.col("rating_before") * n / (n + 37.0), F.lit(0.0)).alias("rating"), F.sqrt(9.0 / (1 + n / 37.0)).alias("sd"),
                    F.lit(0.0).alias("comfort"), (n > 0).alias("known"))


@query("pregame_chance", with_sql(PRE_SQL) + """
SELECT game_id, round(d, 5) AS rating_diff, round(sd, 5) AS sd, known, round(1 / (1 + exp(-0.04 * d)), 6) AS blue, round(1 / (1 + exp(-(0.04 * d - 0.04 * sd))), 6) AS low, round(1 / (1 + exp(-(0.04 * d + 0.04 * sd))), 6) AS high FROM g""")
def pregame_chance(s: Star) -> DataFrame:
    p = R.pregame(pregame_players(s), "game_id")
    return p.select("game_id", F.round("rating_diff", 5).alias("rating_diff"), F.round("sd", 5).alias("sd"), "known", *[F.round(c, 6).alias(c) for c in ("blue", "low", "high")])


@query("pregame_backtest", with_sql(PRE_SQL) + """,
e AS (SELECT 1 / (1 + exp(-0.04 * d)) AS p, (status = 'F')::INT AS y FROM g JOIN (SELECT DISTINCT game_id, status FROM lines) USING (game_id)),
k AS (SELECT *, rank() OVER (ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY round(p, 9)) - 1) / 2.0 AS rk FROM e)
SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier, round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k""")
def pregame_backtest(s: Star) -> DataFrame:
    p = R.pregame(pregame_players(s), "game_id")
    y = s.games().select("game_id", F.col("win").cast("int").alias("y"))
    return binary_metrics(p.join(y, "game_id"), "blue", "y").select("n", *[F.round(c, 6).alias(c) for c in ("log_loss", "brier", "auc")])


