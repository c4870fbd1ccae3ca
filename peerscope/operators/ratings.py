"""Player ratings, their reliability, values of choices, habits and plans, drafts and pre-game chances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from .ordered import numbered, top_per_group
from .quantiles import grouped_quantiles
from .scale import beside, dimension, grown, written



def role_adjusted(rows: DataFrame, role: str, stats: Sequence[str]) -> DataFrame:
    """Each stat minus its role's mean, as ``<stat>_adj``."""
    means = rows.groupBy(role).agg(*[F.avg(s).alias(f"_m_{s}") for s in stats])
    j = rows.join(F.broadcast(means), role)
    return j.select(*rows.columns, *[(F.col(s) - F.col(f"_m_{s}")).alias(f"{s}_adj") for s in stats])


def halves(rows: DataFrame, player: str, order: Sequence[str], stats: Sequence[str], min_games: int = 20) -> DataFrame:
    """Per player and stat: means of odd and even games, of the earlier half, and of later wins."""
    r = numbered(rows, [player], order, "_rn")
    r = beside(r, [player], {"_n": F.count(F.lit(1))}).where(F.col("_n") >= min_games)
    odd, early = F.col("_rn") % 2 == 1, F.col("_rn") <= F.floor(F.col("_n") / 2)
    late_rank = F.col("_rn") - F.floor(F.col("_n") / 2)
    win = F.col("win").cast("int")
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in stats])
    long = r.select(player, "_n", "win", odd.alias("_odd"), early.alias("_early"), late_rank.alias("_lr"), F.explode(pairs).alias("_x"))
    v = F.col("_x.v")
    return long.groupBy(player, F.col("_x.stat").alias("stat")).agg(
        F.max("_n").alias("games"), F.avg(F.when(F.col("_odd"), v)).alias("odd"), F.avg(F.when(~F.col("_odd"), v)).alias("even"),
        F.avg(F.when(F.col("_early"), v)).alias("early"), F.avg(F.when(~F.col("_early"), win)).alias("late_win"),
        F.avg(F.when(~F.col("_early") & (F.col("_lr") % 2 == 1), win)).alias("late_a"),
        F.avg(F.when(~F.col("_early") & (F.col("_lr") % 2 == 0), win)).alias("late_b"), F.var_samp(v).alias("within"),
        F.avg(F.when(F.col("_early"), win)).alias("early_win"))


def reliability(h: DataFrame) -> DataFrame:
    """Split-half correlation stepped up, and what the earlier half says about later wins, per stat."""
    r = h.groupBy("stat").agg(F.count(F.lit(1)).alias("players"), F.corr("odd", "even").alias("split_half"), F.corr("early", "late_win").alias("predicts"),
                              F.corr("early_win", "late_win").alias("_rw"), F.corr("early", "early_win").alias("_rb"), F.corr("late_a", "late_b").alias("_rl"))
    lo, hi = E.fisher_interval(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("predicts"))), F.col("players"))
    step = lambda c: 2 * c / (1 + c)
    partial = (F.col("predicts") - F.col("_rw") * F.col("_rb")) / F.sqrt(F.greatest(F.lit(1e-9), (1 - F.pow("_rw", F.lit(2))) * (1 - F.pow("_rb", F.lit(2)))))
    return r.select("stat", "players", "split_half", step(F.col("split_half")).alias("reliability"), "predicts", lo.alias("predicts_low"), hi.alias("predicts_high"),
                    partial.alias("beyond_win_rate"), F.sqrt(F.greatest(F.lit(0.0), step(F.col("_rl")))).alias("ceiling"))


def rating_model(h: DataFrame) -> DataFrame:
    """One row: the spread of true levels (tau, from the covariance of two halves) and of games (sigma)."""
    m = h.agg(F.greatest(F.covar_samp("odd", "even"), F.lit(0.25)).alias("_t2"), F.avg("within").alias("_s2"))
    return m.select(F.sqrt("_t2").alias("tau"), F.sqrt("_s2").alias("sigma"), (F.col("_s2") / F.col("_t2")).alias("k"))


def player_ratings(rows: DataFrame, player: str, value: str, model: DataFrame) -> DataFrame:
    """Mean against the role, pulled to zero by tau²/(tau²+sigma²/n), with its standard error."""
    per = rows.groupBy(player).agg(F.count(F.lit(1)).alias("games"), F.avg(value).alias("raw")).crossJoin(F.broadcast(model))
    t2, s2 = F.pow("tau", F.lit(2)), F.pow("sigma", F.lit(2))
    return per.select(player, "games", "raw", (F.col("raw") * t2 / (t2 + s2 / F.col("games"))).alias("rating"),
                      F.sqrt(1 / (1 / t2 + F.col("games") / s2)).alias("sd"))


def ladder(ratings: DataFrame, main_role: DataFrame, player: str, role: str, k: int = 15, min_games: int = 10) -> DataFrame:
    r = ratings.join(main_role, player).where(F.col("games") >= min_games).withColumn("_r", F.round("rating", 6))
    return top_per_group(r, [role], [F.col("_r").desc(), F.col(player)], k, "place").drop("_r")


# -- values of choices ------------------------------------------------------------------------------

CELL = ("champion", "kind", "slot", "choice", "context")


def choice_cells(choices: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Observed minus expected per cell. ``choices`` has p (expected chance) and won (0/1)."""
    return choices.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("won") - F.col("p")).alias("raw"),
                                      (F.avg(F.col("p") * (1 - F.col("p"))) / F.count(F.lit(1))).alias("noise"), F.avg("p").alias("expected"),
                                      F.avg(F.col("won").cast("double")).alias("win_rate"))


def choice_signal(cells: DataFrame, min_n: int = 20) -> DataFrame:
    """True spread per kind by the method of moments: variance of cell means minus mean noise."""
    c = cells.where((F.col("context") == "all") & (F.col("n") >= min_n))
    s = c.groupBy("kind").agg(F.count(F.lit(1)).alias("cells"), F.var_pop("raw").alias("_v"), F.avg("noise").alias("_e"))
    return s.select("kind", "cells", F.when(F.col("cells") < 5, 0.0001).otherwise(F.greatest(F.col("_v") - F.col("_e"), F.lit(0.004 ** 2))).alias("tau2"))


def choice_values(cells: DataFrame, signal: DataFrame, min_n: int = 10) -> DataFrame:
    """Cell values pulled to zero by tau²/(tau²+noise), in points, with their error."""
    j = cells.where(F.col("n") >= min_n).join(F.broadcast(signal.select("kind", "tau2")), "kind")
    w = F.col("tau2") / (F.col("tau2") + F.col("noise"))
    return j.select(*CELL, F.col("n").alias("games"), (100 * F.col("raw")).alias("raw"), (100 * F.col("raw") * w).alias("value"),
                    (100 * F.sqrt(F.col("tau2") * F.col("noise") / (F.col("tau2") + F.col("noise")))).alias("sd"),
                    (100 * F.col("expected")).alias("expected"), (100 * F.col("win_rate")).alias("win_rate"))


def choice_reliability(choices: DataFrame, match: str, min_n: int = 30) -> DataFrame:
    """Split-half check by a stable hash of the match: the same cell's raw value in either half."""
    half = choices.where("context = 'all'").withColumn("_h", E.md5_half(match))
    per = half.groupBy(*CELL).agg(*[f(F.when(F.col("_h") == h, v)).alias(f"{n}{h}") for h in (0, 1)
                                    for n, f, v in (("_n", F.count, F.lit(1)), ("_r", F.avg, F.col("won") - F.col("p")))])
    both = per.where((F.col("_n0") >= min_n) & (F.col("_n1") >= min_n))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.corr("_r0", "_r1").alias("r"))


# -- boards, habits, plans --------------------------------------------------------------------------

def role_board(rows: DataFrame, role: str, value: str, min_n: int = 20) -> DataFrame:
    """Per role: average, in wins and losses, and the 10th and 90th percentile."""
    w = F.col("win")
    base = rows.groupBy(role).agg(F.avg(F.when(w, F.col(value))).alias("in_wins"), F.avg(F.when(~w, F.col(value))).alias("in_losses"))
    q = grouped_quantiles(rows, [role], value, {"p10": 0.1, "p90": 0.9}, min_n)
    return q.join(base, role).select(role, "n", "mean", "in_wins", "in_losses", "p10", "p90")


def champion_board(rows: DataFrame, champion: str, role: str, value: str, k: float = 37.0, min_n: int = 15) -> DataFrame:
    """Per champion and role: average against the role's, shrunk."""
    role_mean = rows.groupBy(role).agg(F.avg(value).alias("_m"))
    per = rows.groupBy(champion, role).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= min_n)
    return per.join(F.broadcast(role_mean), role).select(champion, role, "n", "mean", ((F.col("mean") - F.col("_m")) * F.col("n") / (F.col("n") + k)).alias("edge"))


# The habits of deaths: what made one costly.
def habit_flags(taken: str = "taken", enemies: str = "enemies", held: str = "held", zone: str = "zone", timer: str = "timer") -> dict[str, Column]:
    return {"while_dead": F.col(taken) > 0, "outnumbered": F.col(enemies) >= 3, "held_gold": F.col(held) >= 1500,
            "deep": F.col(zone).isin("enemy_jungle", "enemy_base"), "late": F.col(timer) >= 40}


def habit_norms(deaths: DataFrame, games: DataFrame, keys: Sequence[str], flags: dict[str, Column], cost: str) -> DataFrame:
    """Per group: deaths and cost a game overall ('any') and for each habit, and the habit's share of deaths."""
    pairs = F.array(F.lit("any"), *[F.when(c, F.lit(n)) for n, c in flags.items()])
    long = deaths.select(*keys, cost, F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("habit"))
    h = long.groupBy(*keys, "habit").agg(F.count(F.lit(1)).alias("deaths"), F.sum(cost).alias("_c"))
    n = games.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"))
    total = h.where("habit = 'any'").select(*keys, F.col("deaths").alias("_all"))
    return (h.join(n, list(keys)).join(total, list(keys))
            .select(*keys, "habit", "games", "deaths", (F.col("_c") / F.col("games")).alias("per_game"), (F.col("deaths") / F.col("_all")).alias("share")))


def habit_excess(mine: DataFrame, role: DataFrame, player_keys: Sequence[str], role_keys: Sequence[str]) -> DataFrame:
    r = role.select(*role_keys, "habit", F.col("per_game").alias("typical"))
    return mine.join(r, [*role_keys, "habit"]).withColumn("excess", F.col("per_game") - F.col("typical"))


def plan(costs: DataFrame, player: str, order: Sequence[str], min_games: int = 3, last: int = 10, before: int = 20) -> DataFrame:
    """A player's worst candidate (mean cost beyond the typical), a target, and whether it got better.

    ``costs`` has player, candidate, cost, typical, one row per game. Recent games are compared with the ones
    before by a 95% normal margin; games are numbered once per candidate from the newest.
    """
    r = numbered(costs, [player, "candidate"], order, "_back", reverse=True)
    new, old = F.col("_back") <= last, (F.col("_back") > last) & (F.col("_back") <= last + before)
    c = F.col("cost")
    v = lambda cond: F.coalesce(F.var_samp(F.when(cond, c)), F.lit(0.0)) / F.greatest(F.count(F.when(cond, 1)), F.lit(1))
    per = r.groupBy(player, "candidate").agg(
        F.count(F.lit(1)).alias("games"), F.avg("cost").alias("mine"), F.avg("typical").alias("typical"), F.count(F.when(old, 1)).alias("_nb"),
        F.avg(F.when(new, c)).alias("last"), F.avg(F.when(old, c)).alias("before"), (1.96 * F.sqrt(v(new) + v(old))).alias("margin")).where(F.col("games") >= min_games)
    per = per.withColumn("excess", F.round(F.col("mine") - F.col("typical"), 6))
    worst = top_per_group(per, [player], [F.col("excess").desc(), F.col("candidate")], 1)
    target = F.when(F.col("excess") <= 2, F.col("typical")).otherwise(F.col("mine") - F.col("excess") / 2)
    better = F.col("before") - F.col("last")
    verdict = F.when(F.col("_nb") == 0, "early").when(better > F.col("margin"), "better").when(-better > F.col("margin"), "worse").otherwise("steady")
    return worst.select(player, "candidate", "games", "mine", "typical", "excess", target.alias("target"), "margin", verdict.alias("verdict"))


def plan_blocks(costs: DataFrame, player: str, order: Sequence[str], size: int = 5) -> DataFrame:
    """Cost per game in blocks from the newest back; the oldest partial block is left out."""
    r = numbered(costs, [player, "candidate"], order, "_back", reverse=True).withColumn("block", F.floor((F.col("_back") - 1) / size))
    return (r.groupBy(player, "candidate", "block").agg(F.count(F.lit(1)).alias("_n"), F.avg("cost").alias("cost"), F.avg("typical").alias("typical"))
            .where(F.col("_n") == size).drop("_n"))


# -- draft and pre-game ------------------------------------------------------------------------------

# Games each part's rate is pulled by, and the caps in log-odds.
PULL = {"strength": 100.0, "lane": 80.0, "pair": 150.0, "pool": 30.0, "class": 100.0}
PAIR_CAP, PERSONAL_CAP = 0.20, 0.50


def held_as_map(table: DataFrame, keys: Sequence[str], key: str, value: Column, name: str) -> DataFrame:
    """One row per ``keys`` with a map from ``key`` to ``value``; a null key is met by nothing and left out."""
    return table.where(F.col(key).isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), value.alias("v")))).alias(name))


def draft_evidence(drafts: DataFrame, strength: DataFrame, lane: DataFrame, allies: DataFrame, enemies: DataFrame) -> DataFrame:
    """What a draft's candidates are judged by, a row for each (role, champion) that is asked about or known.

    Base rate, and maps of log-odds changes against it: by opponent, by ally, by enemy. As large as a table of champions
    by champions, however many drafts there are.
    """
    c = F.col
    rate = lambda k: (c("wins") + k * c("_base")) / (c("games") + k)
    asked = drafts.select("role", "champions").distinct().select("role", F.explode("champions").alias("champion"))
    known = asked.unionByName(strength.select("role", "champion")).distinct()
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    s = strength.select("role", "champion", "games", "wins")
    k0 = PULL["strength"]
    base = known.join(s, same(known, s, "role", "champion"), "left").select(
        known["role"], known["champion"], ((F.coalesce("wins", F.lit(0)) + k0 * 0.5) / (F.coalesce("games", F.lit(0)) + k0)).alias("_base"))
    out = base = written(base, "base")
    for name, table, keys, other, k in (("_lane", lane, ["role", "champion"], "opponent", PULL["lane"]),
                                        ("_allies", allies, ["champion"], "other", PULL["pair"]), ("_enemies", enemies, ["champion"], "other", PULL["pair"])):
        maps = held_as_map(table.join(F.broadcast(base), keys), ["role", "champion"], other, E.logit(rate(k)) - E.logit("_base"), name)
        out = out.join(maps, same(out, maps, "role", "champion"), "left").select(*[out[n] for n in out.columns], name)
    return dimension(out.withColumnsRenamed({"role": "_role", "champion": "_champion"}))


def change_sum(changes: str, others: Column) -> Column:
    """The changes of the named others, summed inside the row; one without a record changes nothing."""
    return F.coalesce(F.aggregate(others, F.lit(0.0), lambda total, o: total + F.coalesce(F.try_element_at(F.col(changes), o), F.lit(0.0))), F.lit(0.0))


def capped(x: Column, cap: float) -> Column:
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), x))


def draft_scores(drafts: DataFrame, strength: DataFrame, lane: DataFrame, allies: DataFrame, enemies: DataFrame, comfort: DataFrame,
                 caps: tuple[float, float] = (PAIR_CAP, PERSONAL_CAP)) -> DataFrame:
    """Every (draft, candidate) with additive log-odds parts against its own base rate.

    ``drafts``: draft, role, opponent, player, allies[], enemies[], champions[] (the candidates). The evidence tables hold
    games and wins: strength (role, champion), lane (role, champion, opponent), allies / enemies (champion, other),
    comfort (player, champion). A draft is one row until it has met its player; its candidates are never shuffled.
    """
    c = F.col
    rate = lambda w, n, prior, k: (F.coalesce(w, F.lit(0)) + k * prior) / (F.coalesce(n, F.lit(0)) + k)
    record = held_as_map(comfort, ["player"], "champion", F.struct("games", "wins"), "_record")
    d = drafts.join(grown(record), "player", "left")
    asked = F.transform("champions", lambda x: F.struct(x.alias("champion"), F.try_element_at("_record", x).alias("r")))
    d = d.select("draft", "role", "opponent", "allies", "enemies", F.explode(asked).alias("_x")).select(
        "draft", "role", "opponent", "allies", "enemies", c("_x.champion").alias("champion"), c("_x.r.games").alias("_cn"), c("_x.r.wins").alias("_cw"))
    e = draft_evidence(drafts, strength, lane, allies, enemies).withColumnsRenamed({"_allies": "_am", "_enemies": "_em"})
    d = d.join(e, d["role"].eqNullSafe(e["_role"]) & d["champion"].eqNullSafe(e["_champion"]), "left")
    mine = E.logit(rate(c("_cw"), c("_cn"), c("_base"), PULL["pool"])) - E.logit("_base")
    parts = {"strength_x": E.logit("_base"), "lane_x": F.try_element_at("_lane", c("opponent")), "allies_x": capped(change_sum("_am", c("allies")), caps[0]),
             "enemies_x": capped(change_sum("_em", c("enemies")), caps[0]), "comfort_x": capped(mine, caps[1])}
    d = d.select("draft", "champion", *[F.coalesce(x, F.lit(0.0)).alias(n) for n, x in parts.items()])
    total = sum((c(n) for n in parts), F.lit(0.0))
    return d.select("draft", "champion", *parts, total.alias("total"), (100 * E.sigmoid(total)).alias("win"))


def pregame(players: DataFrame, match: str, per_point: float = 0.04) -> DataFrame:
    """Blue's chance before a game from ratings and halved comfort, with an interval from the rating errors.

    ``players``: match, team (100/200), rating, sd, comfort (log-odds), known.
    """
    sign = F.when(F.col("team") == 100, 1.0).otherwise(-1.0)
    g = players.groupBy(match).agg(F.sum(sign * F.coalesce("rating", F.lit(0.0))).alias("rating_diff"), F.sqrt(F.sum(F.pow("sd", F.lit(2)))).alias("sd"),
                                   F.sum(sign * 0.5 * F.coalesce("comfort", F.lit(0.0))).alias("_c"), F.count(F.when(F.col("known"), 1)).alias("known"))
    z = per_point * F.col("rating_diff") + F.col("_c")
    return g.select(match, "rating_diff", "sd", "known", E.sigmoid(z).alias("blue"), E.sigmoid(z - per_point * F.col("sd")).alias("low"),
                    E.sigmoid(z + per_point * F.col("sd")).alias("high"))


