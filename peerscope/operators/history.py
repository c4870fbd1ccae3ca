"""A player's history: sessions, streaks, pool, progress, trends, paired comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clear
from .joins import asof
from .ordered import islands, numbered, previous, running
from .quantiles import grouped_quantiles
from .scale import dimension


def sessions(games: DataFrame, keys: Sequence[str], start: str, end: str, tie: Sequence[str], gap_s: float = 3600,
             win: str | None = None) -> DataFrame:
    """Number sessions and games within them; a session ends at a break of ``gap_s`` or more.

    Adds session, index (from 1) and, with ``win``, losses in a row before the game in its session.
    """
    order = [start, *tie]
    out = previous(games, keys, order, {"_prev_end": F.col(end)})
    fresh = F.col("_prev_end").isNull() | (F.col(start) - F.col("_prev_end") >= F.lit(gap_s))
    out = islands(out, keys, order, fresh, "session")
    out = numbered(out, [*keys, "session"], order, "index")
    if win:
        out = losses_before(out, [*keys, "session"], order, win, "losses_before")
    return out.drop("_prev_end")


def losses_before(games: DataFrame, keys: Sequence[str], order: Sequence[str], win: str, name: str) -> DataFrame:
    """Losses in a row just before each game: losses so far minus losses at the last win."""
    lost = F.when(F.col(win), 0).otherwise(1).cast("long")
    out = running(games, keys, order, {"_lost": ("sum", lost)})
    out = running(out, keys, order, {"_lost_so_far": ("sum", lost),
                                     "_at_win": ("last", F.when(F.col(win), F.col("_lost")))}, strict=True)
    zero = F.lit(0)
    return out.withColumn(name, F.coalesce("_lost_so_far", zero) - F.coalesce("_at_win", zero)).drop(
        "_lost", "_lost_so_far", "_at_win")


def streaks(games: DataFrame, keys: Sequence[str], order: Sequence[str], win: str) -> DataFrame:
    """Longest winning and losing run and the current one (negative = losing) per key."""
    out = previous(games, keys, order, {"_before": F.col(win)})
    out = islands(out, keys, order, F.col("_before").isNull() | (F.col("_before") != F.col(win)), "_run")
    runs = out.groupBy(*keys, "_run", F.col(win).alias("_won")).agg(F.count(F.lit(1)).alias("_n"))
    signed = F.when(F.col("_won"), F.col("_n")).otherwise(-F.col("_n"))
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_won"), F.col("_n"))), F.lit(0)).alias("longest_win"),
        F.coalesce(F.max(F.when(~F.col("_won"), F.col("_n"))), F.lit(0)).alias("longest_loss"),
        F.max_by(signed, "_run").alias("current_run"))


def standard_error(value: str) -> Column:
    return F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))


def group_summary(games: DataFrame, keys: Sequence[str], win: str, score: str) -> DataFrame:
    return games.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"), F.sum(F.col(win).cast("int")).alias("wins"),
        F.avg(score).alias("mean_score"), standard_error(score).alias("se"))


def position_label(index: str = "index") -> Column:
    i = F.col(index)
    return F.when(i == 1, "1st").when(i == 2, "2nd").when(i == 3, "3rd").otherwise("4th+")


def streak_label(losses: str = "losses_before", index: str = "index") -> Column:
    """The first game of a session follows a break, not a result."""
    l = F.col(losses)
    return F.when(F.col(index) > 1, F.when(l == 0, "after a win").when(l == 1, "after 1 loss")
                  .otherwise("after 2+ losses"))


def session_groups(with_sessions: DataFrame, win: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Results by place in the session and by what came before; one pass for both groupings."""
    both = with_sessions.withColumn("_g", F.explode(F.array(
        F.struct(F.lit("position").alias("grouping"), position_label().alias("label")),
        F.struct(F.lit("streak").alias("grouping"), streak_label().alias("label")))))
    rows = both.select(*keys, "_g.grouping", "_g.label", win, score).where(F.col("label").isNotNull())
    return group_summary(rows, [*keys, "grouping", "label"], win, score)


def paired_gap(with_sessions: DataFrame, session_keys: Sequence[str], keys: Sequence[str], earlier: Column,
               later: Column, score: str, min_sessions: int = 10, name: str = "gap") -> DataFrame:
    """Mean over sessions of (mean later − mean earlier), with its error and whether it is clear."""
    per = with_sessions.groupBy(*session_keys).agg(
        F.avg(F.when(later, F.col(score))).alias("_l"), F.avg(F.when(earlier, F.col(score))).alias("_e"))
    diffs = per.where(F.col("_l").isNotNull() & F.col("_e").isNotNull()).withColumn("_d", F.col("_l") - F.col("_e"))
    out = diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions"), F.avg("_d").alias(name),
                                   standard_error("_d").alias("se")).where(F.col("sessions") >= 2)
    return out.withColumn("clear", clear(F.col(name), F.col("se"), F.col("sessions"), min_sessions))


def tilt(with_sessions: DataFrame, keys: Sequence[str], win: str, last: int = 4) -> DataFrame:
    """Win rates by game number in the session, after two losses and after a win."""
    i, l, w = F.col("index"), F.col("losses_before"), F.col(win).cast("int")

    def rate(when: Column, name: str):
        return [F.count(F.when(when, 1)).alias(f"{name}_games"),
                F.coalesce(F.sum(F.when(when, w)), F.lit(0)).alias(f"{name}_wins")]

    cols = []
    for n in range(1, last):
        cols += rate(i == n, f"game{n}")
    cols += rate(i >= last, f"game{last}plus") + rate(l >= 2, "after_two_losses") + rate((i > 1) & (l == 0), "after_win")
    return with_sessions.groupBy(*keys).agg(*cols)


def champion_pool(scored: DataFrame, player: str, champion: str, role: str, win: str, score: str,
                  min_games: int = 5, k: float = 2.0) -> DataFrame:
    """Each pick's record and score beside the player's other picks in the role.

    "Others" are the role's sums minus the pick's own (n, Σ, Σ²), so picks are never paired up.
    """
    s = F.col(score).cast("double")
    own = scored.groupBy(player, role, champion).agg(
        F.count(F.lit(1)).alias("games"), F.sum(F.col(win).cast("int")).alias("wins"),
        F.sum(s).alias("_s"), F.sum(s * s).alias("_q"), standard_error(score).alias("se"))
    total = own.groupBy(player, role).agg(F.sum("games").alias("_tn"), F.sum("_s").alias("_ts"), F.sum("_q").alias("_tq"))
    j = own.join(total, [player, role])
    n = F.col("_tn") - F.col("games")
    mean_o = F.when(n > 0, (F.col("_ts") - F.col("_s")) / F.when(n > 0, n))
    var_o = F.when(n > 1, (F.col("_tq") - F.col("_q") - n * mean_o * mean_o) / F.when(n > 1, n - 1)).otherwise(F.lit(0.0))
    enough = (F.col("games") >= min_games) & (n > 0)
    j = j.withColumn("score", F.col("_s") / F.col("games")).withColumn("others", n)
    j = j.withColumn("gap", F.when(enough, F.col("score") - mean_o))
    se_o = F.when(n > 1, F.sqrt(F.greatest(var_o, F.lit(0.0)) / F.when(n > 1, n))).otherwise(F.lit(0.0))
    far = F.abs("gap") > k * F.sqrt(F.col("se") * F.col("se") + se_o * se_o)
    verdict = F.when(far & (F.col("gap") > 0), "stronger").when(far & (F.col("gap") < 0), "weaker").otherwise("")
    return j.withColumn("se_others", se_o).withColumn("verdict", verdict).select(
        player, role, champion, "games", "wins", "score", "se", "others", "gap", "se_others", "verdict")


def weekly(games: DataFrame, keys: Sequence[str], start: str, win: str, values: Sequence[str]) -> DataFrame:
    """Monday weeks: games, wins and means."""
    return games.groupBy(*keys, F.date_trunc("week", F.col(start)).cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("games"), F.sum(F.col(win).cast("int")).alias("wins"),
        *[F.avg(v).alias(v) for v in values])


def trend(games: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, per: int = 10,
          min_games: int = 10, k: float = 2.0) -> DataFrame:
    """Least-squares slope of a value against the game's number, per ``per`` games, with error and verdict."""
    placed = numbered(games.where(F.col(value).isNotNull()), keys, order, "_x")
    x, y = F.col("_x").cast("double"), F.col(value).cast("double")
    fit = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), F.regr_slope(y, x).alias("_b"),
                                    F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    n = F.col("games")
    b = F.when(n >= 3, F.col("_b")).otherwise(F.lit(0.0))
    rss = F.greatest(F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"), F.lit(0.0))
    se = F.when(n >= 3, F.sqrt(rss / F.when(n >= 3, n - 2) / F.col("_sxx"))).otherwise(F.lit(0.0))
    out = fit.select(*keys, "games", (b * per).alias("slope"), (se * per).alias("se"))
    moved = (F.col("games") >= min_games) & (F.col("se") > 0) & (F.abs("slope") > k * F.col("se"))
    return out.withColumn("verdict", F.when(moved & (F.col("slope") > 0), "improving")
                          .when(moved, "declining").otherwise("steady"))


def recent_versus_older(rows: DataFrame, player: str, metric: str, order: Sequence[str], value: str,
                        recent: int = 20, min_games: int = 5, games: DataFrame | None = None) -> DataFrame:
    """Medians of the newest ``recent`` games against the rest, per metric.

    The split is by game: the player's games are numbered once and the rows meet their number.
    """
    who = [player]
    ids = (games if games is not None else rows).select(player, *order).distinct()
    place = numbered(ids, who, order, "_back", reverse=True)
    tagged = rows.join(place, [player, *order]).withColumn(
        "_part", F.when(F.col("_back") <= recent, "recent").otherwise("older"))
    med = grouped_quantiles(tagged, [player, metric, "_part"], value, {"median": 0.5}, 1)
    out = med.groupBy(player, metric).agg(
        F.max(F.when(F.col("_part") == "recent", F.col("n"))).alias("recent_games"),
        F.max(F.when(F.col("_part") == "recent", F.col("median"))).alias("recent_median"),
        F.coalesce(F.max(F.when(F.col("_part") == "older", F.col("n"))), F.lit(0)).alias("older_games"),
        F.max(F.when((F.col("_part") == "older") & (F.col("n") >= min_games), F.col("median"))).alias("older_median"))
    return out.where(F.col("recent_games") >= min_games).withColumn("change", F.col("recent_median") - F.col("older_median"))


def prior_games(games: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "prior_games") -> DataFrame:
    return numbered(games, keys, order, name).withColumn(name, F.col(name) - 1)


def rating_before(games: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Running mean and count over strictly earlier games."""
    out = running(games, keys, order, {"_s": ("sum", F.col(value)), "games_before": ("count", F.col(value))}, strict=True)
    return out.withColumn("rating_before", F.when(F.col("games_before") > 0, F.col("_s") / F.col("games_before"))).drop("_s")


def latest(df: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """The newest row per key: an aggregate, so a key's history never meets in one task."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]))


def changes_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Drop rows that repeat the previous row's values."""
    out = previous(df, keys, order, {"_was": F.struct(*values)})
    return out.where(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.struct(*values))).drop("_was")


def rank_line(games: DataFrame, anchors: DataFrame, player: str, start: str, tie: str, win: str, at: str,
              score: str, step: int = 22) -> DataFrame:
    """Estimated ladder score after each game, tied to the known snapshots.

    Between two snapshots games move ± ``step`` and the error is spread evenly so the line meets the later
    snapshot. Before the first snapshot the line is worked backwards and kept at or above zero; after the
    last it runs forward.
    """
    move = F.when(F.col(win), step).otherwise(-step).cast("long")
    a = previous(anchors.select(player, at, score), [player], [at], {"_next_score": F.col(score)}, following=True)
    g = games.withColumn("_move", move)
    g = asof(g, a, [player], start, at, {"_from": score, "_to": "_next_score"}, strict=True, matched_time="_since")
    keys = [player, "_since"]
    order = [start, tie]
    g = running(g, keys, order, {"_walk": ("sum", F.col("_move")), "_k": ("count", F.col("_move"))})
    piece = dimension(g.groupBy(*keys).agg(F.sum("_move").alias("_total"), F.count(F.lit(1)).alias("_n")))
    p = piece.select(F.col(player).alias("_p"), F.col("_since").alias("_s"), "_total", "_n")
    first = anchors.groupBy(F.col(player).alias("_ap")).agg(F.min_by(score, at).alias("_first"))
    g = g.join(p, (F.col(player) == F.col("_p")) & F.col("_since").eqNullSafe(F.col("_s")))
    g = g.join(first, F.col(player) == F.col("_ap"))
    middle = F.col("_from") + F.col("_walk") + (F.col("_to") - F.col("_from") - F.col("_total")) * F.col("_k") / F.col("_n")
    # A walk that may not go below zero is the larger of the plain walk and the distance to the walk's lowest
    # point on the side of the anchor, so both clamped pieces are running minima instead of a loop.
    g = running(g, keys, order, {"_low_after": ("min", F.col("_walk"))}, reverse=True)
    g = running(g, keys, order, {"_low_before": ("min", F.col("_walk"))})
    early = F.greatest(F.col("_first") - (F.col("_total") - F.col("_walk")), F.col("_walk") - F.col("_low_after"))
    late = F.greatest(F.col("_from") + F.col("_walk"), F.col("_walk") - F.col("_low_before"))
    line = (F.when(F.col("_since").isNull(), early.cast("double"))
            .when(F.col("_to").isNotNull(), middle.cast("double")).otherwise(late.cast("double")))
    return g.select(*games.columns, line.alias("ladder"))
