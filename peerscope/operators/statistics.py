"""Grouped statistics over build rows.

A build row is one participant of one game with the columns match_id, player, team, role, champion, opponent,
win, kills, deaths, assists, cs, damage, gold, vision, duration_s, patch, tier, team_kills, start_s. A cart row
carries the purchases of a game in order (``purchases``, ``purchase_s``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from .history import streaks
from .ordered import top_per_group
from .quantiles import grouped_quantiles
from .scale import beside, dimension, written



def wins() -> Column:
    return F.sum(F.col("win").cast("int"))


def record(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), wins().alias("wins"), *more)


def rates(builds: DataFrame) -> DataFrame:
    """Per-minute rates and kill participation of every build row."""
    minutes = F.col("duration_s") / 60.0
    return builds.select(
        "*", (F.col("cs") / minutes).alias("cs_min"), (F.col("vision") / minutes).alias("vision_min"),
        (F.col("damage") / minutes).alias("dmg_min"), (F.col("deaths") / (F.col("duration_s") / 600.0)).alias("deaths_10"),
        ((F.col("kills") + F.col("assists")) / F.greatest(F.col("team_kills"), F.lit(1))).alias("kp"))


# -- tier list ---------------------------------------------------------------------------------

# Cumulative shares of a role's list and the tier they end.
TIER_CUTS = ((0.05, "S+"), (0.17, "S"), (0.40, "A"), (0.70, "B"), (0.90, "C"))


def ban_rates(bans: DataFrame, matches: DataFrame) -> DataFrame:
    """Share of matches with the champion banned."""
    total = matches.select(F.countDistinct("match_id").alias("total"))
    return (bans.groupBy("champion").agg(F.countDistinct("match_id").alias("bans"))
            .crossJoin(F.broadcast(total)).select("champion", "bans", (100 * F.col("bans") / F.col("total")).alias("ban_rate")))


def tier_list(builds: DataFrame, bans: DataFrame, shifts: DataFrame | None = None, min_games: int = 20,
              min_share: float = 0.08) -> DataFrame:
    """Champions per role with win, pick and ban rate, a score and a tier.

    After the first grouping the data is champions × roles, so the rankings run on a bounded table.
    """
    picks = record(builds, ["champion", "role"], F.sum("kills").alias("_k"), F.sum("deaths").alias("_d"), F.sum("assists").alias("_a"))
    per_champion = picks.groupBy("champion").agg(F.sum("games").alias("_all"))
    rates_ = ban_rates(bans, builds)
    total = builds.select(F.countDistinct("match_id").alias("_total"))
    t = (picks.join(per_champion, "champion").join(rates_, "champion", "left").crossJoin(F.broadcast(total))
         .where((F.col("games") >= min_games) & (F.col("games") >= min_share * F.col("_all"))))
    t = t.select("champion", "role", "games", "wins", (100 * F.col("wins") / F.col("games")).alias("win_rate"),
                 (100 * E.shrunk_rate("wins", "games")).alias("win_rate_shrunk"),
                 (100 * F.col("games") / F.col("_total")).alias("pick_rate"), F.coalesce("ban_rate", F.lit(0.0)).alias("ban_rate"),
                 (100 * F.col("games") / F.col("_all")).alias("role_share"),
                 ((F.col("_k") + F.col("_a")) / F.greatest(F.col("_d"), F.lit(0.01) * F.col("games"))).alias("kda"))
    role = Window.partitionBy("role")
    mid = F.percentile("pick_rate", F.lit(0.5)).over(role)
    t = t.withColumn("_mid", mid).withColumn(
        "score_raw", F.round(F.col("win_rate_shrunk") - 50 + 1.5 * F.ln(F.col("pick_rate") / F.col("_mid")), 6))
    if shifts is not None:
        t = t.join(shifts, "champion", "left").withColumn("score", F.col("score_raw") + F.coalesce("shift", F.lit(0.0))).drop("shift")
    else:
        t = t.withColumn("score", F.col("score_raw"))
    for score, name in (("score_raw", "tier_raw"), ("score", "tier")):
        place = F.row_number().over(role.orderBy(F.col(score).desc(), "champion"))
        t = t.withColumn("role_rank", place).withColumn("_share", (place - 0.5) / F.count(F.lit(1)).over(role))
        cut = F.when(F.col("_share") < TIER_CUTS[0][0], TIER_CUTS[0][1])
        for edge, label in TIER_CUTS[1:]:
            cut = cut.when(F.col("_share") < edge, label)
        t = t.withColumn(name, cut.otherwise("D"))
    return t.drop("_share", "_mid")


# What a change of each kind is worth.
CHANGE_WEIGHT = {"buff": 1.0, "nerf": -1.0}


def patch_shift(changes: DataFrame, games: DataFrame, keys: Sequence[str] = ("champion",), preview: float = 0.6,
                usage: DataFrame | None = None, min_usage: float = 0.15) -> DataFrame:
    """Tier-score points for changes the data predates: weight × share of games before the patch.

    With ``usage`` (champion, item, share) the changes are item changes, scaled by how often the champion
    buys the item (at least ``min_usage``).
    """
    counts = games.groupBy("patch").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    patches = changes.select("patch").distinct()
    c = counts.select(F.col("patch").alias("_p"), "_n")
    before = (patches.join(F.broadcast(c), E.patch_key("_p") < E.patch_key("patch"), "left").groupBy("patch").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_b"))
              .crossJoin(F.broadcast(total)).select("patch", (F.col("_b") / F.col("_total")).alias("share_before")))
    weight = F.lit(0.0)
    for kind, w in CHANGE_WEIGHT.items():
        weight = F.when(F.col("kind") == kind, F.lit(w)).otherwise(weight)
    weight = weight * F.when(F.col("status") == "preview", preview).otherwise(1.0)
    rows = changes.join(before, "patch").withColumn("_w", weight * F.col("share_before"))
    if usage is not None:
        rows = rows.join(usage.where(F.col("share") >= min_usage), "item").withColumn("_w", F.col("_w") * F.col("share"))
    return rows.groupBy(*keys).agg(F.sum("_w").alias("shift"), F.count(F.lit(1)).alias("changes"))


def item_usage(carts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of a group's games in which each item was bought or held."""
    n = carts.groupBy(*keys).agg(F.countDistinct("match_id").alias("group_games"))
    held = carts.select(*keys, "match_id", F.explode(F.array_distinct("purchases")).alias("item"))
    used = held.groupBy(*keys, "item").agg(F.countDistinct("match_id").alias("games"))
    return used.join(n, list(keys)).withColumn("share", F.col("games") / F.col("group_games"))


# -- matchups ----------------------------------------------------------------------------------

def matchups(builds: DataFrame, leads: Sequence[str], min_games: int = 6) -> DataFrame:
    """Every (champion, role, opponent): record, shrunk rate, mean leads (unknown leads ignored)."""
    rows = builds.where(F.col("opponent").isNotNull())
    out = record(rows, ["champion", "role", "opponent"], *[F.avg(c).alias(c) for c in leads],
                 F.count(leads[0]).alias("lane_games"))
    return out.where(F.col("games") >= min_games).withColumn("shrunk", 100 * E.shrunk_rate("wins", "games"))


def lane_report(rows: DataFrame, minute: str, gold: str, cs: str, died: str, opponent_died: str) -> DataFrame:
    """A pair's lane numbers per minute beside the champion's against everyone ('*')."""
    both = rows.where(F.col("opponent").isNotNull()).withColumn("opponent", F.explode(F.array("opponent", F.lit("*"))))
    w, g = F.col("win").cast("int"), F.col(gold)
    short, long = F.col("duration_s") < 1500, F.col("duration_s") > 1920
    yes = lambda c: F.avg(c.cast("int"))
    return both.groupBy("champion", "opponent", minute).agg(
        F.count(F.lit(1)).alias("n"), F.avg(g).alias("gold"), F.avg(cs).alias("cs"), yes(g > 0).alias("ahead"),
        yes(F.col(died) > 0).alias("died"), yes(F.col(opponent_died) > 0).alias("opp_died"),
        F.avg(F.when(g > 0, w)).alias("win_ahead"), F.avg(F.when(g < 0, w)).alias("win_behind"),
        F.count(F.when(short, 1)).alias("short_games"), F.coalesce(F.sum(F.when(short, w)), F.lit(0)).alias("short_wins"),
        F.count(F.when(long, 1)).alias("long_games"), F.coalesce(F.sum(F.when(long, w)), F.lit(0)).alias("long_wins"))


def personal_matchups(builds: DataFrame, min_games: int = 2, k: int = 6) -> DataFrame:
    """A player's hardest and easiest opponents by (wins − n/2)/√n."""
    r = record(builds.where(F.col("opponent").isNotNull()), ["player", "champion", "opponent"]).where(F.col("games") >= min_games)
    r = r.withColumn("edge", (F.col("wins") - F.col("games") / 2) / F.sqrt("games"))
    r = r.withColumn("side", F.when(F.col("edge") < 0, "hard").when(F.col("edge") > 0, "easy")).where(F.col("side").isNotNull())
    return top_per_group(r, ["player", "side"], [F.abs("edge").desc(), F.col("champion"), F.col("opponent")], k)


# -- builds --------------------------------------------------------------------------------------

def top_choices(choices: DataFrame, keys: Sequence[str], k: int = 3, min_games: int = 2) -> DataFrame:
    """The most used keys of each kind with win and pick rate. ``choices`` has kind, key, win."""
    # Counted once and written: choices come from documents, which are not parsed anew for the totals.
    counted = written(record(choices, [*keys, "kind", "key"]), "choices")
    n = counted.groupBy(*keys, "kind").agg(F.sum("games").alias("_n"))
    r = counted.where(F.col("key").isNotNull() & (F.col("games") >= min_games)).join(n, [*keys, "kind"])
    r = r.withColumn("win_rate", 100 * F.col("wins") / F.col("games")).withColumn("pick_rate", 100 * F.col("games") / F.col("_n")).drop("_n")
    return top_per_group(r, [*keys, "kind"], [F.col("games").desc(), F.col("wins").desc(), F.col("key")], k, "place")


def build_choices(carts: DataFrame) -> DataFrame:
    """Long (kind, key) rows of a cart: start, core, first to sixth different item."""
    key = lambda c: F.array_join(c.cast("array<string>"), "-")
    nth = lambda n: F.get(F.array_distinct("purchases"), F.lit(n - 1)).cast("string")
    kinds = [("start", key(E.starting_set("purchases", "purchase_s"))), ("core", key(E.core_items("purchases"))),
             ("first", nth(1)), ("fourth", nth(4)), ("fifth", nth(5)), ("sixth", nth(6))]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds])
    return carts.withColumn("_x", F.explode(pairs)).select(*carts.columns, "_x.kind", "_x.key")


# How many choices of each kind are shown.
SHOWN = {"runes": 3, "rune_pages": 1, "spells": 2, "start": 3, "boots": 3, "core": 5, "first": 3, "fourth": 4, "fifth": 4, "sixth": 4, "skill_max": 2, "skill_order": 1}


def stacked_choices(rows: DataFrame, keys: Sequence[str], kinds: dict[str, Column]) -> DataFrame:
    """A (kind, key) row of every game for each kind; a game without that choice keeps its row with a null key."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds.items()])
    return rows.select(*keys, "win", F.explode(pairs).alias("_x")).select(*keys, "win", "_x.kind", "_x.key")


def loadout_choices(builds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runes (keystone and both styles), whole rune pages and spell pairs, whatever their order."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return stacked_choices(builds, keys, {
        "runes": F.when(F.col("keystone").isNotNull(), F.concat_ws("-", part("keystone"), part("primary_style"), part("sub_style"))),
        "rune_pages": F.array_join(F.col("perks").cast("array<string>"), "-"),
        "spells": F.array_join(F.array_sort("spells").cast("array<string>"), "-")})


def boots_choices(carts: DataFrame, keys: Sequence[str], boots: Sequence[int]) -> DataFrame:
    """The first of the ``boots`` (ids of the item dimension, a handful) that was bought."""
    wanted = F.array(*[F.lit(b).cast("bigint") for b in boots])
    return stacked_choices(carts, keys, {"boots": F.get(F.filter("purchases", lambda i: F.array_contains(wanted, i.cast("bigint"))), F.lit(0)).cast("string")})


def skill_choices(orders: DataFrame, keys: Sequence[str], seen: int = 15) -> DataFrame:
    """Which skill is maxed first, second and third, and the first ``seen`` level-ups (null if there were fewer)."""
    return stacked_choices(orders, keys, {
        "skill_max": E.max_order("skill_order", seen=seen),
        "skill_order": F.when(F.length("skill_order") >= seen, F.substring("skill_order", 1, seen))})


def top_shown(choices: DataFrame, keys: Sequence[str], shown: dict[str, int] = SHOWN, min_games: int = 2) -> DataFrame:
    """``top_choices`` with a number of places for each kind; kinds not named there are left out."""
    limit = F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])[F.col("kind")]
    rows = choices.where(F.col("kind").isin(*shown))
    return top_choices(rows, keys, max(shown.values()), min_games).where(F.col("place") <= limit)


def build_paths(carts: DataFrame, keys: Sequence[str], firsts: int = 4, seconds: int = 3, min_first: int = 10,
                min_pair: int = 5) -> DataFrame:
    """The most common first items and what is bought after each."""
    seq = carts.select(*keys, "win", E.nth_distinct("purchases", 1).alias("item"), E.nth_distinct("purchases", 2).alias("next"))
    seq = seq.where(F.col("item").isNotNull())
    first = record(seq, [*keys, "item"]).where(F.col("games") >= min_first)
    first = top_per_group(first, keys, [F.col("games").desc(), F.col("item")], firsts)
    pair = record(seq.where(F.col("next").isNotNull()), [*keys, "item", "next"]).where(F.col("games") >= min_pair)
    pair = top_per_group(pair, [*keys, "item"], [F.col("games").desc(), F.col("next")], seconds)
    p = pair.select(*keys, "item", "next", F.col("games").alias("next_games"), F.col("wins").alias("next_wins"))
    return first.join(p, [*keys, "item"], "left")


def item_board(carts: DataFrame, min_games: int = 30, k: int = 4) -> DataFrame:
    """Finished items: games, win and pick rate, and the champions that build them most."""
    total = carts.select(F.count(F.lit(1)).alias("_players"))
    held = carts.select("champion", "win", F.explode("purchases").alias("item"))
    per = record(held, ["item", "champion"])
    items = per.groupBy("item").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins")).where(F.col("games") >= min_games)
    top = top_per_group(per, ["item"], [F.col("games").desc(), F.col("champion")], k, "_p")
    builders = top.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "champion"))),
                                                              lambda x: x["champion"]), ",").alias("builders"))
    return (items.join(builders, "item").crossJoin(F.broadcast(total))
            .select("item", "games", "wins", (100 * F.col("wins") / F.col("games")).alias("win_rate"),
                    (100 * E.shrunk_rate("wins", "games")).alias("shrunk"),
                    (100 * F.col("games") / F.col("_players")).alias("pick_rate"), "builders"))


# -- games -----------------------------------------------------------------------------------------

def first_objectives(objectives: DataFrame, min_share: float = 5.0) -> DataFrame:
    """Win rate of the side that took an objective first; rare objectives are left out."""
    games = objectives.select(F.countDistinct("match_id").alias("_games"))
    firsts = record(objectives.where("first"), ["objective"])
    return (firsts.crossJoin(F.broadcast(games)).where(100 * F.col("games") / F.col("_games") >= min_share)
            .select("objective", "games", "wins", (100 * F.col("games") / F.col("_games")).alias("happened"),
                    (100 * F.col("wins") / F.col("games")).alias("win_rate")))


def lead_buckets(teams: DataFrame, gold: str, edges: Sequence[float], labels: Sequence[str], behind: float) -> DataFrame:
    """Win rate by gold lead over the other side, both sides counted; rows behind enough also say comeback.

    ``teams`` has one row per (match, team); a match's two sides meet in a sum, not in a join.
    """
    both = teams.groupBy("match_id").agg(F.sum(gold).alias("_sum"), F.count(F.lit(1)).alias("_n")).where("_n = 2")
    t = teams.join(both, "match_id").withColumn("lead", 2 * F.col(gold) - F.col("_sum"))
    t = t.withColumn("label", E.bucket("lead", edges, labels))
    w = F.col("win").cast("int")
    low = F.col("lead") <= behind
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("teams"), F.sum(w).alias("wins"), F.count(F.when(low, 1)).alias("behind"),
                                  F.coalesce(F.sum(F.when(low, w)), F.lit(0)).alias("comebacks"))


# -- players ---------------------------------------------------------------------------------------

TOTALS = ("kills", "deaths", "assists", "cs", "damage", "gold", "vision", "duration_s")


def totals(builds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return record(builds, keys, *[F.sum(c).alias(c) for c in TOTALS])


def total_rates(t: DataFrame, prefix: str = "") -> list[Column]:
    c = lambda n: F.col(prefix + n)
    minutes = c("duration_s") / 60
    return [(100 * c("wins") / c("games")).alias("win_rate"), ((c("kills") + c("assists")) / F.greatest(c("deaths"), F.lit(1))).alias("kda"),
            (c("cs") / minutes).alias("cs_min"), (c("damage") / minutes).alias("dmg_min"), (c("gold") / minutes).alias("gold_min"),
            (c("vision") / minutes).alias("vision_min"), (c("deaths") / (minutes / 10)).alias("deaths_10")]


def against_peers(builds: DataFrame, min_peers: int = 20) -> DataFrame:
    """A player's champion numbers beside the same pick's at the tier, the player's own games taken out.

    Peers are group totals minus the player's own totals; below ``min_peers`` games all tiers are used.
    """
    num = ["games", "wins", *TOTALS]
    mine = totals(builds, ["player", "champion", "tier"])
    at = mine.groupBy("champion", "tier").agg(*[F.sum(c).alias(f"t_{c}") for c in num])
    all_ = mine.groupBy("champion").agg(*[F.sum(c).alias(f"a_{c}") for c in num])
    own = mine.groupBy("champion", "player").agg(*[F.sum(c).alias(f"o_{c}") for c in num])
    j = mine.join(at, ["champion", "tier"]).join(all_, "champion").join(own, ["champion", "player"])
    enough = F.col("t_games") - F.col("games") >= min_peers
    j = j.select("*", F.when(enough, "tier").otherwise("all").alias("peers"),
                 *[F.when(enough, F.col(f"t_{c}") - F.col(c)).otherwise(F.col(f"a_{c}") - F.col(f"o_{c}")).alias(f"p_{c}") for c in num])
    j = j.where(F.col("p_games") > 0)
    peer = total_rates(j, "p_")
    return j.select("player", "champion", "tier", "games", "peers", F.col("p_games").alias("peer_games"),
                    *total_rates(j), *[c.alias(f"peer_{n}") for c, n in zip(peer, ("win_rate", "kda", "cs_min", "dmg_min", "gold_min", "vision_min", "deaths_10"))])


def form(builds: DataFrame, n: int = 20) -> DataFrame:
    """Each player's last n games: record, averages, current streak, best game."""
    order = [F.col("start_s").desc(), F.col("match_id").desc(), F.col("role"), F.col("team")]
    last = top_per_group(builds, ["player"], order, n, "_back")
    first_loss = F.min(F.when(~F.col("win"), F.col("_back")))
    first_win = F.min(F.when(F.col("win"), F.col("_back")))
    streak = (F.when(F.coalesce(first_win, F.lit(n + 1)) == 1, F.coalesce(first_loss, F.count(F.lit(1)) + 1) - 1)
              .otherwise(-(F.coalesce(first_win, F.count(F.lit(1)) + 1) - 1)))
    return last.groupBy("player").agg(
        F.count(F.lit(1)).alias("games"), wins().alias("wins"), F.avg("kills").alias("kills"), F.avg("deaths").alias("deaths"),
        F.avg("assists").alias("assists"), F.countDistinct("champion").alias("champions"), streak.cast("long").alias("streak"),
        F.max_by("match_id", F.struct("damage", F.col("match_id"))).alias("best_game"))


def mains(builds: DataFrame, k: int = 3) -> DataFrame:
    """Each player's most played champions and main role."""
    picks = record(builds, ["player", "champion"])
    top = top_per_group(picks, ["player"], [F.col("games").desc(), F.col("champion")], k, "place")
    roles = builds.groupBy("player", "role").agg(F.count(F.lit(1)).alias("_n"))
    main = roles.groupBy("player").agg(F.max_by("role", F.struct("_n", -F.col("role"))).alias("main_role"))
    return top.join(main, "player").select("player", "place", "champion", "games", "main_role")


def compare(stats: DataFrame, pairs: DataFrame, values: dict[str, bool]) -> DataFrame:
    """Two players side by side, per statistic which is better; ``values`` maps a name to "higher is better"."""
    a = stats.select(F.col("player").alias("a"), F.struct(*values).alias("_a"))
    b = stats.select(F.col("player").alias("b"), F.struct(*values).alias("_b"))
    rows = F.array(*[F.struct(F.lit(v).alias("stat"), F.col(f"_a.{v}").cast("double").alias("va"), F.col(f"_b.{v}").cast("double").alias("vb"),
                              F.lit(up).alias("up")) for v, up in values.items()])
    j = pairs.join(a, "a").join(b, "b").select("a", "b", F.explode(rows).alias("_r")).select("a", "b", "_r.*")
    va, vb = F.col("va"), F.col("vb")
    better = F.when(va == vb, "even").when((va > vb) == F.col("up"), "a").otherwise("b")
    return j.withColumn("better", better).drop("up")


def performance(builds: DataFrame, match: str = "match_id", digits: int = 1) -> DataFrame:
    """A 0–10 score within each match: weighted z-scores of seven statistics and a win bonus, spread to 3..10.

    MVP is the best of the winning side, ACE of the losing one.
    """
    minutes = F.greatest(F.lit(1.0), F.col("duration_s") / 60)
    kda = F.least(F.lit(10.0), (F.col("kills") + F.col("assists")) / F.greatest(F.lit(1), F.col("deaths")))
    kp = (F.col("kills") + F.col("assists")) / F.greatest(F.lit(1), F.col("team_kills"))
    # The weight of each statistic.
    parts = (("_kda", kda, 1.4), ("_kp", kp, 1.2), ("_dm", F.col("damage") / minutes, 1.0), ("_gm", F.col("gold") / minutes, 0.8),
             ("_cm", F.col("cs") / minutes, 0.5), ("_vm", F.col("vision") / minutes, 0.5), ("_nd", (-F.col("deaths")).cast("double"), 0.8))
    t = builds.select("*", *[c.alias(n) for n, c, _ in parts])
    t = beside(t, [match], {f"{n}{s}": f(n) for n, _, _ in parts for s, f in (("_m", F.avg), ("_s", F.stddev_pop))})
    raw = F.when(F.col("win"), 0.6).otherwise(0.0)
    for n, _, w in parts:
        sd = F.when(F.col(f"{n}_s") > 1e-9, F.col(f"{n}_s")).otherwise(1.0)
        raw = raw + w * (F.col(n) - F.col(f"{n}_m")) / sd
    t = t.select(*builds.columns, raw.alias("_raw"))
    t = beside(t, [match], {"_lo": F.min("_raw"), "_hi": F.max("_raw")})
    span = F.col("_hi") - F.col("_lo")
    t = t.withColumn("score", F.when(span > 1e-9, F.round(3 + 7 * (F.col("_raw") - F.col("_lo")) / F.when(span > 1e-9, span), digits)).otherwise(5.0))
    best = t.groupBy(match, "win").agg(F.max_by(F.struct("team", "role"), F.struct(F.round("_raw", 6), -F.col("role"), "team")).alias("_best"))
    b = best.select(F.col(match).alias("_bm"), F.col("win").alias("_bw"), "_best")
    t = t.join(b, (F.col(match) == F.col("_bm")) & (F.col("win") == F.col("_bw")))
    is_best = (F.col("_best.team") == F.col("team")) & (F.col("_best.role") == F.col("role"))
    label = F.when(is_best, F.when(F.col("win"), "MVP").otherwise("ACE"))
    return t.select(*builds.columns, "score", label.alias("award"))


def recap(builds: DataFrame, season: str = "patch") -> DataFrame:
    """A player's season in one row: record, hours, totals, best champion, streaks, best month."""
    keys = ["player", season]
    base = totals(builds, keys).withColumn("hours", F.col("duration_s") / 3600.0)
    champ = record(builds, [*keys, "champion"])
    top = champ.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("champions"), F.max_by("champion", F.struct("games", "champion")).alias("top_champion"),
        F.max_by(F.when(F.col("games") >= 8, F.col("champion")),
                 F.struct(F.when(F.col("games") >= 8, E.shrunk_rate("wins", "games")), "champion")).alias("best_champion"))
    runs = streaks(builds, keys, ["start_s", "match_id", "role", "team"], "win")
    return base.join(top, keys).join(runs, keys)


def heat_map(builds: DataFrame, start: str, zone: str, keys: Sequence[str] = ()) -> DataFrame:
    """Games by weekday and hour in a given time zone."""
    local = F.from_utc_timestamp(F.col(start), zone)
    return builds.groupBy(
        *keys, F.dayofweek(local).alias("weekday"), F.hour(local).alias("hour")).agg(F.count(F.lit(1)).alias("games"), wins().alias("wins"))


def badges(facts: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Earned badges of one-row-per-player facts: rules are (name, condition)."""
    rows = F.array(*[F.struct(F.lit(n).alias("badge"), F.coalesce(c, F.lit(False)).alias("earned")) for n, c in rules])
    return facts.select(*keys, F.explode(rows).alias("_b")).where("_b.earned").select(*keys, "_b.badge")


def records(builds: DataFrame, player: str, specs: dict[str, Column], ident: Sequence[str]) -> DataFrame:
    """A player's best game per statistic; ties go to the later identifier."""
    cols = [F.max(F.when(v.isNotNull(), F.struct(v.cast("double").alias("value"), *ident))).alias(n) for n, v in specs.items()]
    wide = builds.groupBy(player).agg(*cols)
    rows = F.array(*[F.struct(F.lit(n).alias("record"), F.col(n).alias("b")) for n in specs])
    return (wide.select(player, F.explode(rows).alias("_r")).where("_r.b IS NOT NULL")
            .select(player, "_r.record", "_r.b.value", *[f"_r.b.{i}" for i in ident]))


def to_try(tier_rows: DataFrame, builds: DataFrame, classes: DataFrame, min_best: int = 8, k: int = 4, max_played: int = 3) -> DataFrame:
    """Strong champions of a player's main role played less than ``max_played`` times, preferring the classes of the
    player's two best champions there. ``classes`` is (champion, class)."""
    per = record(builds, ["player", "champion", "role"])
    roles = per.groupBy("player", "role").agg(F.sum("games").alias("_n"))
    main = roles.groupBy("player").agg(F.max_by("role", F.struct("_n", -F.col("role"))).alias("role"))
    played = per.groupBy("player", "champion").agg(F.sum("games").alias("played"))
    best = top_per_group(per.join(main, ["player", "role"]).where(F.col("games") >= min_best), ["player"],
                         [F.round(E.shrunk_rate("wins", "games"), 9).desc(), F.col("champion")], 2)
    tags = best.join(classes, "champion").groupBy("player").agg(F.collect_set("class").alias("_tags"))
    bonus = F.when(F.col("tier") == "S+", 3).when(F.col("tier") == "S", 2).when(F.col("tier") == "A", 1)
    strong = dimension(tier_rows.withColumn("_bonus", bonus).where("_bonus IS NOT NULL").join(classes.groupBy("champion").agg(F.collect_set("class").alias("_cls")), "champion")
                       .select("role", "champion", "tier", "win_rate", "_bonus", "_cls"))
    cand = main.join(strong, "role").join(played, ["player", "champion"], "left").where(F.coalesce("played", F.lit(0)) < max_played)
    cand = cand.join(tags, "player", "left")
    shared = F.coalesce(F.size(F.array_intersect("_cls", F.col("_tags"))), F.lit(0))
    shared = F.when(F.col("_tags").isNull(), 0).otherwise(shared)
    cand = cand.withColumn("score", F.round(F.col("_bonus") + shared + F.col("win_rate") / 100, 6))
    return top_per_group(cand, ["player"], [F.col("score").desc(), F.col("champion")], k, "place").select(
        "player", "role", "place", "champion", "tier", "score")


# -- team composition ----------------------------------------------------------------------------------

def magic_share(builds: DataFrame, magic: str, total: str) -> DataFrame:
    return builds.groupBy("champion").agg((F.sum(magic) / F.sum(total)).alias("magic_share"))


def merged_bins(bins: DataFrame, order: str, n: str, w: str, at_least: int) -> DataFrame:
    """Merge neighbouring bins of a small ordered table until each holds ``at_least``: a fold over its rows
    (one row per tenth, so the array is fixed in size); a small rest joins the last bin."""
    zero = F.array().cast("array<struct<lo:double,n:bigint,w:bigint>>")
    rows = F.array_sort(F.collect_list(F.struct(
        F.col(order).cast("double").alias("lo"), F.col(n).cast("bigint").alias("n"), F.col(w).cast("bigint").alias("w"))))

    def merged(a, r):
        return F.struct(a["lo"].alias("lo"), (a["n"] + r["n"]).alias("n"), (a["w"] + r["w"]).alias("w"))

    def without_last(acc):
        return F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))

    def step(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        return (F.when(F.size(acc) == 0, F.array(r))
                .when(last["n"] < at_least, F.concat(without_last(acc), F.array(merged(last, r))))
                .otherwise(F.concat(acc, F.array(r))))

    def finish(acc):
        last, prior = F.try_element_at(acc, F.lit(-1)), F.try_element_at(acc, F.lit(-2))
        return F.when((F.size(acc) > 1) & (last["n"] < at_least),
                      F.concat(without_last(without_last(acc)), F.array(merged(prior, last)))).otherwise(acc)

    return bins.agg(F.aggregate(rows, zero, step, finish).alias("_b")).select(F.inline("_b"))


def outlier_sources(per_source: DataFrame, rate: str, k: float = 3.0) -> DataFrame:
    """Sources whose rate lies above Q3 + k·IQR of all sources."""
    q = grouped_quantiles(per_source.withColumn("_g", F.lit(1)), ["_g"], rate, {"q1": 0.25, "q3": 0.75})
    limit = q.select((F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("limit"))
    return per_source.crossJoin(F.broadcast(limit)).withColumn("outlier", F.col(rate) > F.col("limit"))


def coverage(samples: DataFrame, keys: Sequence[str], match: str, target: int) -> DataFrame:
    """Distinct games per bucket and what is missing to the target."""
    out = samples.groupBy(*keys).agg(F.countDistinct(match).alias("games"))
    return out.withColumn("missing", F.greatest(F.lit(0), F.lit(target) - F.col("games")))


def stratified_sample(rows: DataFrame, strata: Sequence[str], ident: str, n: int, seed: str) -> DataFrame:
    """Round-robin over strata, each in a seeded hash order, the first n rows.

    A stratum can add at most n rows, so each is cut to n before the global order."""
    h = lambda *c: F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(x).cast("string") for x in c]), 256)
    once = rows.groupBy(ident).agg(*[F.min_by(s, F.struct(*strata)).alias(s) for s in strata])
    placed = top_per_group(once, strata, [h(ident)], n, "round")
    return placed.orderBy("round", h(*strata)).limit(n)


def window_counters(events: DataFrame, time: str, keys: Sequence[str], span: str, limit: int, amount: str | None = None) -> DataFrame:
    """Tumbling-window counters per key, with an over-limit flag."""
    w = F.window(F.col(time), span)
    out = events.groupBy(*keys, w.alias("_w")).agg(F.count(F.lit(1)).alias("requests"), *([F.sum(amount).alias("spent")] if amount else []))
    return out.select(*keys, F.unix_seconds("_w.start").alias("from_s"), "requests", *(["spent"] if amount else []),
                      (F.col("requests") > limit).alias("over_limit"))


