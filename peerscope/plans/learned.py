"""Labels and models on the star and event bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import labels as L
from ..operators import learning as M
from ..operators import winprob as W
from ..operators.scale import written
from .chance import events as play_events
from .chance import frames as play_frames
from .chance import training_set
from .past import LANE_CASE, ZONE_CASE, lane_ctes
from .registry import query
from .sequences import TRADES_SQL, lane_trades
from .star import EVENTS_SQL, LINES_SQL, Star, with_sql

FEATURES = ["minute", "gold_diff", "xp_diff", "cs_diff", "kills_own", "kills_enemy", "towers_own", "towers_enemy", "dragons_own", "dragons_enemy", "alive_own", "alive_enemy"]


PLACED_SQL = LINES_SQL + f""",
p AS (SELECT *, CASE team WHEN 'F' THEN 100 ELSE 200 END AS side, CAST((item * 7) % 14870 AS DOUBLE) AS x, CAST((price * 3) % 14980 AS DOUBLE) AS y, ['top', 'mid', 'bot'][CAST(item % 3 AS INT) + 1] AS at_lane FROM lines), {lane_ctes()},
f AS (SELECT *, {LANE_CASE} AS lane, CASE WHEN side = 200 THEN 1 - y / 14980.0 ELSE x / 14870.0 END AS u, CASE WHEN side = 200 THEN 1 - x / 14870.0 ELSE y / 14980.0 END AS v FROM m),
z AS (SELECT *, {ZONE_CASE} AS zone FROM f)"""


@query("decision_labels", with_sql(PLACED_SQL) + """
SELECT CASE WHEN flag = 'N' AND quantity > 40 THEN 'objective' WHEN zone = 'own_base' THEN 'base' WHEN flag = 'R' THEN 'gank_' || at_lane WHEN lane IS NOT NULL AND discount * 500 <= 2000 THEN 'gank_' || lane
  WHEN zone = 'enemy_jungle' THEN 'invade' WHEN tax >= 3 THEN 'farm' WHEN lane IS NOT NULL THEN 'rotate' ELSE 'other' END AS decision, count(*) AS n FROM z GROUP BY 1""")
def decision_labels(s: Star) -> DataFrame:
    return labelled(s).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def labelled(s: Star) -> DataFrame:
    """Lines as decision minutes of junglers: place from item and price, a kill from a returned line."""
    c = F.col
    l = s.lines().select("game_id", "slot", "supplier", "item", "price", "quantity", "discount", "tax", "flag", F.when(c("team") == "F", 100).otherwise(200).alias("team"), "win",
                         (c("item") * 7 % 14870).cast("double").alias("x"), (c("price") * 3 % 14980).cast("double").alias("y"))
    lane = F.element_at(F.array(F.lit("top"), F.lit("mid"), F.lit("bot")), (c("item") % 3 + 1).cast("int"))
    e = l.select("*", ((c("flag") == "N") & (c("quantity") > 40)).alias("team_objective"), F.when(c("flag") == "R", lane).alias("kill_lane"),
                 (c("discount") * 500).alias("target_distance"), c("tax").alias("cs_gain"))
    return e.withColumn("decision", L.first_rule(L.jungle_rules()))


@query("laner_labels", with_sql(PLACED_SQL) + """
SELECT CASE WHEN flag = 'N' AND quantity > 40 THEN 'objective' WHEN zone = 'own_base' THEN 'base' WHEN flag = 'A' THEN 'push' WHEN flag = 'R' AND at_lane <> 'mid' THEN 'roam' WHEN lane <> 'mid' THEN 'roam'
  WHEN lane = 'mid' THEN 'lane' WHEN zone IN ('river', 'own_jungle', 'enemy_jungle') AND mid > 2500 THEN 'roam' WHEN mid <= 2500 THEN 'lane' ELSE 'other' END AS label, count(*) AS n FROM z GROUP BY 1""")
def laner_labels(s: Star) -> DataFrame:
    c = F.col
    e = labelled(s).withColumn("tower_hit", c("flag") == "A").withColumn("fought", c("flag") == "R").withColumn("fight_lane", c("kill_lane"))
    return e.withColumn("label", L.first_rule(L.laner_rules("mid"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_labels", with_sql(LINES_SQL) + """,
ev AS (SELECT game_id, CAST((slot - 1) * 60000 + price % 60000 AS BIGINT) AS t, flag, team FROM lines),
ex AS (SELECT DISTINCT game_id, team, m FROM lines, generate_series(0, 4) x(m)),
j AS (SELECT ex.*, ev.flag, ev.team AS et FROM ex LEFT JOIN ev ON ev.game_id = ex.game_id AND t > (m + 1) * 60000 AND t <= (m + 4) * 60000)
SELECT game_id AS match_id, CASE team WHEN 'F' THEN 100 ELSE 200 END AS team, CAST(m AS INTEGER) AS minute, (count(*) FILTER (WHERE flag = 'N' AND et = team) > 0)::INT AS team_objective, (count(*) FILTER (WHERE flag = 'N' AND et <> team) > 0)::INT AS enemy_objective,
  count(*) FILTER (WHERE flag = 'R' AND et = team) AS team_kills, count(*) FILTER (WHERE flag = 'R' AND et <> team) AS team_deaths FROM j GROUP BY ALL""")
def outcome_labels(s: Star) -> DataFrame:
    e = play_events(s)
    ex = s.lines().select(F.col("game_id").alias("match_id"), F.when(F.col("team") == "F", 100).otherwise(200).alias("team")).distinct()
    ex = ex.select("match_id", "team", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("minute")).withColumn("player", F.when(F.col("team") == 100, 1).otherwise(6))
    f = play_frames(s)
    side = lambda t: F.sum(F.when(F.col("team") == t, F.col("gold")).otherwise(0))
    gold = f.groupBy("match_id", "minute").agg((side(100) - side(200)).alias("lead_100"))
    out = L.outcome_labels(ex, e.select("match_id", "t", "kind", "side", "victim"), gold)
    return out.select("match_id", "team", "minute", "team_objective", "enemy_objective", "team_kills", "team_deaths")


def moments(s: Star) -> DataFrame:
    return s.events().select("user_id", "event_id", "s", F.col("k").alias("me"), (F.col("cents") % 100).alias("opponent"), (F.col("event_id") % 7).alias("distance"), (F.col("event_type") == "error").alias("dead"))


@query("laning_situations", with_sql(TRADES_SQL) + """
SELECT e.event_id FROM ev e WHERE e.event_id % 7 <= 5 AND e.event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM trades t WHERE t.user_id = e.user_id AND e.s >= t.start_s AND e.s <= t.end_s)""")
def laning_situations(s: Star) -> DataFrame:
    m = moments(s).withColumn("t", F.col("s").cast("double"))
    tr = lane_trades(s).select("user_id", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))
    return L.situations(m, tr, "user_id", "t", "distance", 5, 1e18).select("event_id")


@query("laning_labels", with_sql(TRADES_SQL) + """,
nx AS (SELECT e.event_id, t.started_by, t.skirmish, t.result, row_number() OVER (PARTITION BY e.event_id ORDER BY t.start_s) AS rn FROM ev e JOIN trades t ON t.user_id = e.user_id AND t.start_s > e.s AND t.start_s - e.s <= 43200),
la AS (SELECT user_id, max(s) AS last_t FROM ev GROUP BY user_id),
dd AS (SELECT e.event_id, count(d.event_id) AS n FROM ev e LEFT JOIN ev d ON d.user_id = e.user_id AND d.event_type = 'error' AND d.s > e.s AND d.s - e.s <= 86400 GROUP BY 1)
SELECT e.event_id, coalesce(started_by IN ('you', 'both'), false)::INT AS trade, coalesce(started_by = 'opponent', false)::INT AS traded_on, CASE WHEN started_by IN ('you', 'both') AND NOT skirmish THEN (result = 'won')::INT END AS trade_won,
  CASE WHEN e.s + 86400 <= last_t THEN (dd.n > 0)::INT END AS died_soon FROM ev e JOIN la USING (user_id) JOIN dd ON dd.event_id = e.event_id LEFT JOIN nx ON nx.event_id = e.event_id AND rn = 1""")
def laning_labels(s: Star) -> DataFrame:
    e = s.events()
    at = lambda k: e.where(F.col("event_type") == k).select("user_id", F.col("s").alias("at"))
    ends = e.groupBy("user_id").agg(F.max("s").alias("last_t"))
    out = L.laning_labels(moments(s), lane_trades(s), at("error"), at("purchase"), "user_id", "s", ends, 43200, 86400, 172800, 36000)
    return out.select("event_id", "trade", "traded_on", "trade_won", "died_soon")


@query("laning_features", with_sql(EVENTS_SQL) + """
SELECT event_id, max(k) OVER w AS me_max_86400s, min(k) OVER w AS me_min_86400s, k - arg_min_null(k, (s, event_id)) OVER w AS me_change_86400s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def laning_features(s: Star) -> DataFrame:
    f = L.laning_features(moments(s), "user_id", "s", ["me"], (86400,), ["event_id"])
    return f.select("event_id", "me_max_86400s", "me_min_86400s", "me_change_86400s")


def _examples(s: Star) -> DataFrame:
    t = training_set(s, FEATURES).select("match_id", "side", "won", *FEATURES)
    return written(V.split_by_group(t, "match_id", {"train": 0.7, "valid": 0.15, "test": 0.15}), "examples")


@query("win_model_quality")
def win_model_quality(s: Star) -> DataFrame:
    """Model variants on one split: gold and minute only, logistic, a small network, and the stack; both sides averaged."""
    e = _examples(s)
    train, test = e.where("split = 'train'"), e.where("split = 'test'")
    gold = M.chance_pipeline(["minute", "gold_diff"], "won", iterations=15).fit(train)
    full = M.chance_pipeline(FEATURES, "won", iterations=20, elastic=0.2).fit(train)
    net = M.chance_pipeline(FEATURES, "won", layers=[8], iterations=15).fit(train)
    top = M.stacked(e.where("split = 'valid'"), net, ["dragons_own", "dragons_enemy"], "won")
    out = None
    for name, score in (("gold", lambda d: M.chances(gold, d)), ("logistic", lambda d: M.chances(full, d)), ("network", lambda d: M.chances(net, d)), ("stacked", top)):
        s_ = score(test)
        b = M.both_sides(s_, ["match_id", "minute"], "side", "p")
        y = test.where("side = 100").select("match_id", "minute", "won")
        m = V.binary_metrics(b.join(y, ["match_id", "minute"]), "blue", "won").withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("variant", "n", *[F.round(c, 6).alias(c) for c in ("log_loss", "brier", "auc", "ece")])


@query("calibration")
def calibration(s: Star) -> DataFrame:
    e = _examples(s)
    m = M.chance_pipeline(FEATURES, "won", iterations=15).fit(e.where("split = 'train'"))
    slope, offset = M.platt(M.chances(m, e.where("split = 'valid'")), "p", "won")
    t = M.chances(m, e.where("split = 'test'")).withColumn("q", M.calibrated("p", slope, offset))
    return V.reliability_table(t, "q", "won")


@query("model_comparison")
def model_comparison(s: Star) -> DataFrame:
    """Paired bootstrap by game of the loss difference between two variants."""
    e = _examples(s)
    train, test = e.where("split = 'train'"), e.where("split = 'test'")
    a = M.chances(M.chance_pipeline(["minute", "gold_diff"], "won", iterations=10).fit(train), test, "pa")
    b = M.chances(M.chance_pipeline(FEATURES, "won", iterations=10).fit(train), a, "pb")
    y = F.col("won").cast("double")
    return V.paired_bootstrap(b, "match_id", V.log_loss(F.col("pa"), y), V.log_loss(F.col("pb"), y), 100)


@query("model_attribution")
def model_attribution(s: Star) -> DataFrame:
    """Win chances of all minutes from a fitted model in place of the closed form."""
    e = _examples(s)
    m = M.chance_pipeline(FEATURES, "won", iterations=10).fit(e.where("split = 'train'"))
    ev, fr = play_events(s), play_frames(s)
    st = W.game_state(W.minute_asks(fr, ev), fr, ev)
    p = W.model_chance(lambda d: M.chances(m, d))(st, "blue")
    return p.select("match_id", (F.col("t") / 60000).cast("int").alias("minute"), F.round("blue", 6).alias("blue"))


@query("head_quality")
def head_quality(s: Star) -> DataFrame:
    """Cross-validated by player: is 'dies soon' predictable enough to use?"""
    lab = laning_labels(s).where("died_soon IS NOT NULL")
    x = moments(s).select("event_id", "user_id", F.col("me").cast("double").alias("me"), F.col("opponent").cast("double").alias("opponent"), F.col("distance").cast("double").alias("distance"))
    d = written(x.join(lab.select("event_id", "died_soon"), "event_id"), "heads")
    oof = M.cross_validated(d, "user_id", ["me", "opponent", "distance"], "died_soon", 3, iterations=10)
    u = M.usable(oof, "died_soon")
    return u.select("n", "folds_better", "usable", *[F.round(c, 6).alias(c) for c in ("loss", "base_loss", "auc", "gain")])


@query("feature_importance")
def feature_importance(s: Star) -> DataFrame:
    e = _examples(s).withColumn("row", F.concat_ws(":", "match_id", "side", "minute"))
    m = M.chance_pipeline(FEATURES, "won", iterations=10).fit(e.where("split = 'train'"))
    imp = M.group_importance(m, e.where("split = 'test'"), "row", {"gold": ["gold_diff"], "fights": ["kills_own", "kills_enemy"], "towers": ["towers_own", "towers_enemy"]}, "won")
    return imp.select("group", F.round("loss", 6).alias("loss"), F.round("added", 6).alias("added"))


@query("controlled_contrast")
def controlled_contrast(s: Star) -> DataFrame:
    e = _examples(s)
    m = M.chance_pipeline(FEATURES, "won", iterations=10).fit(e.where("split = 'train'"))
    c = M.contrast(m, e.where("split = 'test'"), "gold_diff", -2.0, 2.0)
    return c.select("feature", "n", *[F.round(x, 6).alias(x) for x in ("at_low", "at_high", "difference")])


def _decisions(s: Star) -> DataFrame:
    d = labelled(s).select("game_id", "slot", "item", "supplier", "decision", "win", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "quantity", "discount", "tax", "price")])
    return written(V.split_by_group(d, "game_id", {"train": 0.8, "test": 0.2}), "decisions")


@query("decision_model")
def decision_model(s: Star) -> DataFrame:
    """A forest over decisions against the majority and by-minute baselines, on held-out games."""
    d = _decisions(s)
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    m = M.class_pipeline(["x", "y", "quantity", "discount", "tax"], "decision", trees=8, depth=6).fit(train)
    r = M.ranked_classes(m, test, "decision")
    acc = r.agg(F.avg(F.col("top1").cast("double")).alias("accuracy"), F.avg(F.col("in_top").cast("double")).alias("top2"))
    base = V.majority_baselines(train, test, "decision", ["slot"])
    return base.crossJoin(F.broadcast(acc)).select("n", *[F.round(c, 6).alias(c) for c in ("majority", "by_group", "accuracy", "top2")])


@query("decision_classes")
def decision_classes(s: Star) -> DataFrame:
    d = _decisions(s)
    m = M.class_pipeline(["x", "y", "quantity", "discount", "tax"], "decision", trees=6, depth=5).fit(d.where("split = 'train'"))
    out = V.class_metrics(M.ranked_classes(m, d.where("split = 'test'"), "decision"), "decision", "predicted")
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("what_if_moments")
def what_if_moments(s: Star) -> DataFrame:
    """Outcome chance of every held-out situation under every decision; the best one and its gain."""
    d = _decisions(s)
    opts = ["objective", "base", "gank_top", "gank_mid", "gank_bot", "invade", "farm", "rotate", "other"]
    for o in opts:
        d = d.withColumn(f"is_{o}", (F.col("decision") == o).cast("double"))
    number = F.row_number().over(Window.partitionBy("game_id", "slot", "item", "supplier", "price").orderBy("quantity", "discount", "tax"))  # of the few lines alike
    d = d.withColumn("won", F.col("win").cast("int")).withColumn("row", F.concat_ws(":", "game_id", "slot", "item", "supplier", "price", number))
    cols = ["x", "y", "quantity", "discount", *[f"is_{o}" for o in opts]]
    m = M.chance_pipeline(cols, "won", iterations=10).fit(d.where("split = 'train'"))
    w = M.what_if(m, d.where("split = 'test'"), opts, lambda o: f"is_{o}", ["row"])
    return w.groupBy("row").agg(F.max_by("option", F.struct(F.round("gain", 9), "option")).alias("best"), F.round(F.max("gain"), 6).alias("gain"))


@query("prediction_intervals")
def prediction_intervals(s: Star) -> DataFrame:
    e = _examples(s)
    m = M.chance_pipeline(FEATURES, "won", iterations=10).fit(e.where("split = 'train'"))
    v = M.chances(m, e.where("split = 'valid'"))
    return M.conformal_width(v.withColumn("y", F.col("won").cast("double")), "y", "p")


@query("data_needs", with_sql(LINES_SQL) + """
SELECT role, champion, count(DISTINCT game_id) AS games, 200 - count(DISTINCT game_id) AS missing FROM lines GROUP BY ALL HAVING count(DISTINCT game_id) < 200""")
def data_needs(s: Star) -> DataFrame:
    counts = s.lines().groupBy("role", "champion").agg(F.countDistinct("game_id").alias("games"))
    return M.data_needs(counts, "games", 200, ["role", "champion"])
