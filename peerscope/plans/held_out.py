"""Folds, bags, learning curves and calibration on the star binding: a line is a situation of its order, returned or not.

The twins unroll the Newton steps of a fit with one input, so SQL fits the same models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensembles as E
from .registry import query
from .star import Star

K, BAGS = 3, 5
X1, X2 = "(quantity - 25) / 10", "(discount - 5) / 5"
WRITTEN = {"p1": "1 / (1 + exp(-(0.8 * x1 - 0.3 * x2)))", "p2": "1 / (1 + exp(-(0.2 * x1 + 0.4 * x2 - 1)))"}


def situations(s: Star) -> DataFrame:
    d = s.played().select("game_id", "slot", "item", "supplier", "price", (F.col("flag") == "R").cast("int").alias("y"), F.expr(X1).cast("double").alias("x1"), F.expr(X2).cast("double").alias("x2"), F.col("team").alias("role"))
    d = d.withColumns({n: F.expr(v) for n, v in WRITTEN.items()})
    return E.equal_games(d, "game_id")


def draw_sql(seed: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || game_id), 1, 8) AS BIGINT) / 4294967296.0"


SITUATIONS_SQL = f"""s0 AS (SELECT l_orderkey AS game_id, l_linenumber AS slot, l_partkey AS item, l_suppkey AS supplier, CAST(round(l_extendedprice) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(round(l_discount * 100) AS BIGINT) AS discount, (l_returnflag = 'R')::INT AS y, l_linestatus AS role FROM lineitem),
s1 AS (SELECT *, CAST({X1} AS DOUBLE) AS x1, CAST({X2} AS DOUBLE) AS x2, 1.0 / count(*) OVER (PARTITION BY game_id) AS raw FROM s0),
s AS (SELECT *, {", ".join(f"{v} AS {n}" for n, v in WRITTEN.items())}, raw / (SELECT avg(raw) FROM s1) AS weight, CAST(floor({draw_sql("fold")} * {K}) AS INT) AS fold, {draw_sql("share")} AS u FROM s1)"""


def newton_sql(name: str, rows: str) -> str:
    """CTEs that fit offset ``a`` and slope ``b`` for each k of ``rows`` (k, x, y, w): the last is ``name``."""
    steps = [f"{name}_r AS ({rows})", f"{name}_0 AS (SELECT DISTINCT k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {name}_r)"]
    for i in range(1, E.STEPS + 1):
        steps.append(f"""{name}_{i} AS (SELECT k, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM (
  SELECT k, a, b, sum(w * (y - p)) AS g0, sum(w * (y - p) * x) - {E.RIDGE} * b AS g1, sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) + {E.RIDGE} AS h11
  FROM (SELECT r.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM {name}_r r JOIN {name}_{i - 1} USING (k)) GROUP BY k, a, b))""")
    return ",\n".join([*steps, f"{name} AS (SELECT * FROM {name}_{E.STEPS})"])


def calibration_sql(name: str, source: str, p: str, keys: str = "") -> str:
    """CTEs: ``name`` is ``source`` with its chance ``p`` calibrated by a fit on the other folds (``calibrated``)."""
    extra = f"{keys}, " if keys else ""
    key = f"[{extra}f.fold]" if keys else "f.fold"
    z = f"ln(greatest(least({p}, 1 - 1e-7), 1e-7) / (1 - greatest(least({p}, 1 - 1e-7), 1e-7)))"
    return newton_sql(f"{name}_m", f"SELECT {key} AS k, {z} AS x, y, weight AS w FROM {source} d JOIN (SELECT DISTINCT fold FROM {source}) f ON f.fold <> d.fold") + f""",
{name} AS (SELECT d.*, 1 / (1 + exp(-(a + b * {z}))) AS calibrated FROM {source} d JOIN {name}_m m ON m.k = {key.replace('f.fold', 'd.fold')})"""


def loss_sql(p: str) -> str:
    return f"sum(weight * -(y * ln(greatest(least({p}, 1 - 1e-7), 1e-7)) + (1 - y) * ln(1 - greatest(least({p}, 1 - 1e-7), 1e-7)))) / sum(weight)"


TIMES_SQL = " + ".join(f"({{u}} >= {b!r})::INT" for b in [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183])


@query("bag_weights", "WITH " + SITUATIONS_SQL + f""",
g AS (SELECT DISTINCT game_id FROM s), b AS (SELECT game_id, bag, CASE bag {" ".join(f"WHEN {b} THEN " + TIMES_SQL.format(u=draw_sql(f"bag{b}")) for b in range(BAGS))} END AS times FROM g, (SELECT unnest(range(0, {BAGS}))::INT AS bag))
SELECT bag, times, count(*) AS games FROM b GROUP BY ALL""")
def bag_weights(s: Star) -> DataFrame:
    """How many games are in each bag how often."""
    g = s.played().select("game_id").distinct()
    b = g.select(F.posexplode(F.array(*[E.bag_times(F.col("game_id"), i) for i in range(BAGS)])).alias("bag", "times"))
    return b.groupBy("bag", "times").agg(F.count(F.lit(1)).alias("games"))


@query("crossfit_calibration", "WITH " + SITUATIONS_SQL + ",\n" + calibration_sql("c", "s", "p1") + f""",
r AS (SELECT fold, least(floor(calibrated * 10), 9) AS bin, count(*) AS n, avg(calibrated) AS p, avg(y) AS rate FROM c GROUP BY ALL)
SELECT c.fold, count(*) AS n, round({loss_sql("p1")}, 6) AS before, round({loss_sql("calibrated")}, 6) AS after, round(any_value(e.ece), 6) AS ece FROM c JOIN (SELECT fold, sum(abs(p - rate) * n) / sum(n) AS ece FROM r GROUP BY fold) e ON e.fold = c.fold GROUP BY c.fold""")
def crossfit_calibration(s: Star) -> DataFrame:
    """Written chances calibrated by fits that never saw their game: loss before and after, and the error left."""
    from ..operators.evaluation import reliability_table

    d = situations(s).withColumn("fold", E.fold_of(F.col("game_id"), K))
    c = E.cross_fitted(d, "p1", "y", K, "weight")
    before = E.weighted_loss(c, "p1", "y", "weight", ["fold"]).select("fold", "n", F.round("loss", 6).alias("before"))
    after = E.weighted_loss(c, "calibrated", "y", "weight", ["fold"]).select("fold", F.round("loss", 6).alias("after"))
    bins = reliability_table(c, "calibrated", "y", ["fold"])
    ece = bins.groupBy("fold").agg(F.round(F.sum(F.abs(F.col("mean_p") - F.col("rate")) * F.col("n")) / F.sum("n"), 6).alias("ece"))
    return before.join(after, "fold").join(ece, "fold")


@query("blend_choice", "WITH " + SITUATIONS_SQL + ",\nt AS (SELECT *, (p1 + p2) / 2 AS pb FROM s),\n" + ",\n".join(calibration_sql(f"c{n}", "t", p) for n, p in (("a", "p1"), ("b", "p2"), ("c", "pb"))) + f""",
l AS ({" UNION ALL ".join(f"SELECT '{name}' AS candidate, {loss_sql('calibrated')} AS loss FROM c{n}" for n, name in (("a", "first"), ("b", "second"), ("c", "blend")))})
SELECT candidate, round(loss, 6) AS loss, row_number() OVER (ORDER BY loss, candidate) = 1 AS best FROM l""")
def blend_choice(s: Star) -> DataFrame:
    """Two written out-of-fold chances and their blend, compared after calibration across folds."""
    d = situations(s).withColumn("fold", E.fold_of(F.col("game_id"), K))
    return E.competing(d, {"first": "p1", "second": "p2"}, "y", K, "weight").withColumn("loss", F.round("loss", 6))


CURVE_CELLS = "SELECT s.*, c.share FROM s, (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS share) c"


@query("learning_curve", "WITH " + SITUATIONS_SQL + ",\n" + newton_sql("m", f"SELECT [d.share, f.fold] AS k, x1 AS x, y, weight AS w FROM ({CURVE_CELLS}) d JOIN (SELECT unnest(range(0, {K}))::INT AS fold) f ON f.fold <> d.fold AND d.u < d.share") + f""",
bs AS (SELECT d.share, f.fold, sum(weight * y) / sum(weight) AS base, count(DISTINCT game_id) AS games FROM ({CURVE_CELLS}) d JOIN (SELECT unnest(range(0, {K}))::INT AS fold) f ON f.fold <> d.fold AND d.u < d.share GROUP BY ALL),
o AS (SELECT d.*, 1 / (1 + exp(-(a + b * x1))) AS p, base FROM ({CURVE_CELLS}) d JOIN m ON m.k = [d.share, d.fold] JOIN bs ON bs.share = d.share AND bs.fold = d.fold),
""" + calibration_sql("c", "o", "p", "d.share") + f"""
SELECT c.share, round(any_value(g.games), 4) AS train_games, round({loss_sql("calibrated")}, 6) AS loss, round({loss_sql("base")}, 6) AS base_loss FROM c JOIN (SELECT share, avg(games) AS games FROM bs GROUP BY share) g ON g.share = c.share GROUP BY c.share""")
def learning_curve(s: Star) -> DataFrame:
    """Held-out loss by the share of training games used."""
    out = E.learning_curve(situations(s), [F.col("x1")], "y", "game_id", K, weight="weight")
    return out.select("share", F.round("train_games", 4).alias("train_games"), F.round("loss", 6).alias("loss"), F.round("base_loss", 6).alias("base_loss"))


@query("bagged_chances", "WITH " + SITUATIONS_SQL + ",\n" + newton_sql("m", "SELECT b.bag AS k, x1 AS x, y, weight * b.times AS w FROM s JOIN (SELECT game_id, bag, times FROM (SELECT DISTINCT game_id FROM s), LATERAL (" + " UNION ALL ".join(
    f"SELECT {b} AS bag, {TIMES_SQL.format(u=draw_sql(f'bag{b}'))} AS times" for b in range(BAGS)) + ") x) b USING (game_id) WHERE b.times > 0") + """,
q AS (SELECT DISTINCT x1 FROM s)
SELECT x1, round(avg(1 / (1 + exp(-(a + b * x1)))), 6) AS p, round(min(1 / (1 + exp(-(a + b * x1)))), 6) AS p_low, round(max(1 / (1 + exp(-(a + b * x1)))), 6) AS p_high FROM q, m GROUP BY x1""")
def bagged_chances(s: Star) -> DataFrame:
    """Mean and spread of the bags' chances at every value of the input."""
    d = situations(s)
    fits = E.bagged(d, [F.col("x1")], "y", "game_id", BAGS, "weight")
    rows = E.bagged_chance(d.select("x1").distinct(), fits, [F.col("x1")])
    return rows.select("x1", *[F.round(c, 6).alias(c) for c in ("p", "p_low", "p_high")])


@query("role_scores", "WITH " + SITUATIONS_SQL + ",\n" + newton_sql("m", f"SELECT f.fold AS k, x1 AS x, y, weight AS w FROM s d JOIN (SELECT unnest(range(0, {K}))::INT AS fold) f ON f.fold <> d.fold") + f""",
o AS (SELECT s.*, 1 / (1 + exp(-(a + b * x1))) AS p, (SELECT sum(t.weight * t.y) / sum(t.weight) FROM s t) AS base FROM s JOIN m ON m.k = s.fold)
SELECT role, count(DISTINCT game_id) AS games, count(*) AS situations, round({loss_sql("p")}, 6) AS loss, round({loss_sql("base")}, 6) AS base_loss, {loss_sql("p")} < {loss_sql("base")} AS better FROM o GROUP BY role HAVING games >= 2""")
def role_scores(s: Star) -> DataFrame:
    """The held-out score of a pooled model within each role."""
    d = situations(s)
    oof = E.out_of_fold(d, [F.col("x1")], "y", "game_id", K, "weight")
    base = d.agg((F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("base"))
    out = E.by_role(oof.crossJoin(F.broadcast(base)), "p", "base", "y", "game_id", "role", "weight")
    return out.withColumns({c: F.round(c, 6) for c in ("loss", "base_loss")})
