"""Situation examples, decision and outcome labels, laning labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from .joins import active_at, asof, look_ahead, window_totals
from .ordered import previous, rolling_range


def first_rule(rules: Sequence[tuple[str | Column, Column]], otherwise: str = "other") -> Column:
    """The label of the first rule that holds."""
    out = None
    for label, cond in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        ok = F.coalesce(cond, F.lit(False))
        out = F.when(ok, value) if out is None else out.when(ok, value)
    return out.otherwise(otherwise)


def jungle_rules(gank_range: float = 2000.0) -> list[tuple[str | Column, Column]]:
    """Priority of a jungler's next-minute decision, over: team_objective, x, y, team (next position),
    kill_lane (lane of a kill taken part in), target_distance (to the laner there), cs_gain."""
    c = F.col
    zone, lane = E.own_zone("x", "y", "team"), E.lane_at("x", "y")
    return [("objective", c("team_objective")), ("base", zone == "own_base"), (F.concat(F.lit("gank_"), c("kill_lane")), c("kill_lane").isNotNull()),
            (F.concat(F.lit("gank_"), lane), lane.isNotNull() & (c("target_distance") <= gank_range)), ("invade", zone == "enemy_jungle"),
            ("farm", c("cs_gain") >= 3), ("rotate", lane.isNotNull())]


def laner_rules(home: str, near: float = 2500.0) -> list[tuple[str | Column, Column]]:
    """Priority of a laner's decision, over: team_objective, x, y, team, tower_hit, fought, fight_lane."""
    c = F.col
    zone, lane = E.own_zone("x", "y", "team"), E.lane_at("x", "y")
    away = E.path_distance(c("x").cast("double"), c("y").cast("double"), E.LANES[home])
    out_of_lane = zone.isin("river", "own_jungle", "enemy_jungle")
    return [("objective", c("team_objective")), ("base", zone == "own_base"), ("push", c("tower_hit")),
            ("fight", c("fought") & c("fight_lane").isNull()), ("roam", c("fought") & (c("fight_lane") != home)),
            ("roam", lane.isNotNull() & (lane != home)), ("lane", lane == home), ("roam", out_of_lane & (away > near)), ("lane", away <= near)]


def outcome_labels(examples: DataFrame, events: DataFrame, gold: DataFrame, minutes: int = 3) -> DataFrame:
    """What follows a decision minute, over the next ``minutes``: objectives, kills, deaths and the gold swing.

    ``examples``: match_id, player, team, minute. ``events``: match_id, t, kind, side (the taker), victim.
    ``gold``: match_id, minute, lead_100. Events are counted as differences of running sums.
    """
    c = F.col
    e = examples.withColumn("_from", (c("minute") + 1).cast("long") * 60000).withColumn("_to", (c("minute") + 1 + minutes).cast("long") * 60000)
    one = lambda cond: F.when(cond, 1).otherwise(0).cast("long")
    rows = events.select("match_id", c("t").alias("_t"), *[one((c("kind") == k) & (c("side") == s)).alias(f"{n}_{s}") for n, k in (("obj", "monster"), ("kill", "kill")) for s in (100, 200)])
    names = [f"{n}_{s}" for n in ("obj", "kill") for s in (100, 200)]
    w = window_totals(e, rows, ["match_id"], "_from", "_to", "_t", {n: n for n in names})
    blue = c("team") == 100
    own = lambda n: F.when(blue, c(f"{n}_100")).otherwise(c(f"{n}_200"))
    foe = lambda n: F.when(blue, c(f"{n}_200")).otherwise(c(f"{n}_100"))
    died = events.where("kind = 'kill'").select("match_id", c("victim").alias("player"), c("t").alias("_dt"), F.lit(1).cast("long").alias("died"))
    w = window_totals(w, died, ["match_id", "player"], "_from", "_to", "_dt", {"died": "died"})
    last = gold.groupBy(c("match_id").alias("_lm")).agg(F.max("minute").alias("_last"))
    w = w.join(last, c("match_id") == c("_lm"))
    g = lambda tag: gold.select(c("match_id").alias(f"_{tag}m"), c("minute").alias(f"_{tag}t"), c("lead_100").alias(f"_{tag}"))
    w = w.join(g("a"), (c("match_id") == c("_am")) & (F.least(c("minute") + 1, c("_last")) == c("_at")))
    w = w.join(g("b"), (c("match_id") == c("_bm")) & (F.least(c("minute") + 1 + minutes, c("_last")) == c("_bt")))
    swing = c("_b") - c("_a")
    return w.select(*examples.columns, (own("obj") > 0).cast("int").alias("team_objective"), (foe("obj") > 0).cast("int").alias("enemy_objective"), own("kill").alias("team_kills"),
                    foe("kill").alias("team_deaths"), (c("died") > 0).cast("int").alias("player_died"), F.when(blue, swing).otherwise(-swing).alias("gold_swing"))


def add_previous(examples: DataFrame, keys: Sequence[str], order: Sequence[str], decision: str, decisions: Sequence[str], lags: int = 2) -> DataFrame:
    """One-hot decisions of the last minutes."""
    out = examples
    for lag in range(1, lags + 1):
        out = previous(out, keys, order, {f"_d{lag}": F.col(decision)}, steps=lag)
    hot = [(F.coalesce(F.col(f"_d{lag}"), F.lit("none")) == d).cast("int").alias(f"prev{lag}_{d}") for lag in range(1, lags + 1) for d in decisions]
    return out.select(*examples.columns, *hot)


def situations(moments: DataFrame, trades: DataFrame, key: str, time: str, distance: str, near: float, until: float) -> DataFrame:
    """Readings in which a decision is open: both seen, close, alive, in the laning phase, no trade going on."""
    open_ = moments.where(F.col("me").isNotNull() & F.col("opponent").isNotNull() & (F.col(distance) <= near) & ~F.coalesce(F.col("dead"), F.lit(False)) & (F.col(time) <= until))
    spans = trades.select(key, F.col("start_s").alias("_s"), (F.col("end_s") + 1e-6).alias("_e"))
    return active_at(open_, spans, [key], time, "_s", "_e", "_in").where("_in = 0").drop("_in")


def laning_labels(moments: DataFrame, trades: DataFrame, deaths: DataFrame, bases: DataFrame, key: str, time: str, ends: DataFrame,
                  decide_s: float, died_s: float, back_s: float, swing_s: float) -> DataFrame:
    """Labels read ahead of each moment; unknown ones stay null.

    A label over a horizon is null where the recording ends before it. ``ends``: key, last_t.
    """
    c = F.col
    t = trades.select(key, c("start_s").alias("_ts"), "started_by", "result", "skirmish", (c("opponent_lost") - c("me_lost")).alias("_net"))
    out = look_ahead(moments, t, [key], time, "_ts", decide_s, {"started_by": "started_by", "result": "result", "skirmish": "skirmish", "_net": "_net"}, "_any")
    mine = c("_any") & c("started_by").isin("you", "both")
    out = out.withColumn("trade", mine.cast("int")).withColumn("traded_on", (c("_any") & (c("started_by") == "opponent")).cast("int"))
    out = out.withColumn("trade_won", F.when((c("trade") == 1) & ~c("skirmish"), (c("result") == "won").cast("int")))
    out = out.withColumn("trade_net", F.when((c("trade") == 1) & ~c("skirmish"), c("_net"))).drop("started_by", "result", "skirmish", "_net", "_any")
    for name, rows, span in (("died", deaths, died_s), ("back", bases, back_s)):
        out = look_ahead(out, rows.select(key, c("at").alias("_x")), [key], time, "_x", span, {}, f"_{name}")
    out = out.join(ends, key)
    known = lambda span: c(time) + F.lit(span) <= c("last_t")
    out = out.withColumn("died_soon", F.when(known(died_s), c("_died").cast("int"))).withColumn("back_soon", F.when(known(back_s), c("_back").cast("int"))).drop("_died", "_back")
    later = out.withColumn("_later", c(time) + F.lit(swing_s))
    reads = moments.select(key, c(time).alias("_rt"), c("me").alias("_lm"), c("opponent").alias("_lo"))
    later = asof(later, reads, [key], "_later", "_rt", {"_lm": "_lm", "_lo": "_lo"})
    swing = (c("_lm") - c("_lo")) - (c("me") - c("opponent"))
    return later.withColumn("swing", F.when(known(swing_s), swing)).drop("_later", "_lm", "_lo", "last_t")


def laning_features(samples: DataFrame, key: str, time: str, values: Sequence[str], spans: Sequence[int] = (2, 5, 10), tie: Sequence[str] = ()) -> DataFrame:
    """Changes and extremes over the last seconds, from readings at or before the moment only.

    A change counts from the first reading of the span; ``tie`` orders readings of one time.
    """
    out = samples
    aggs = {}
    for s in spans:
        parts = {}
        for v in values:
            parts[f"{v}_max_{s}s"], parts[f"{v}_min_{s}s"] = F.max(v), F.min(v)
            parts[f"_{v}_first_{s}s"] = F.min_by(v, F.struct(time, *tie))
        out = rolling_range(out, [key], time, s, parts)
        aggs[s] = parts
    cols = [c for c in out.columns if not c.startswith("_")]
    return out.select(*cols, *[(F.col(v) - F.col(f"_{v}_first_{s}s")).alias(f"{v}_change_{s}s") for s in spans for v in values])
