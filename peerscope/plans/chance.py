"""Game state, win chance and attribution on the star binding.

An order is a match of eight minute frames; its lines are the events: returned lines are kills, accepted ones
towers, the rest dragons. Blue is the side of status F.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import winprob as W
from ..operators.scale import grown, written
from .registry import query
from .star import LINES_SQL, Star, with_sql

MINUTES = 8


def frames(s: Star) -> DataFrame:
    """Cumulative team sums at minutes 0..7: a line counts from its slot's minute on."""
    # Lines are dealt by their game once; the sums of a game's cells then need no other shuffle.
    lines = s.played().select("game_id", "team", "slot", "quantity", "discount").repartition("game_id")
    amounts = {"q": F.col("quantity"), "d": F.col("discount"), "n": F.lit(1).cast("long")}
    cells = [(team, m) for team in ("F", "O") for m in range(MINUTES)]
    sums = lines.groupBy("game_id").agg(*[F.sum(F.when((F.col("team") == team) & (F.col("slot") <= m), v)).alias(f"{n}_{team}_{m}") for team, m in cells for n, v in amounts.items()])
    rows = F.array(*[F.struct(F.lit(team).alias("team"), F.lit(m).alias("minute"), *[F.col(f"{n}_{team}_{m}").alias(n) for n in amounts]) for team, m in cells])
    f = sums.select("game_id", F.explode(rows).alias("_c")).select("game_id", "_c.*")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return f.select(F.col("game_id").alias("match_id"), F.col("minute").cast("int").alias("minute"),
                    F.when(F.col("team") == "F", 100).otherwise(200).alias("team"), (2500 + 100 * z("q")).alias("gold"), (300 * z("d")).alias("xp"),
                    z("q").alias("cs"), (5 + z("n")).alias("level"), (50 * z("q")).alias("held"),
                    *[F.least(F.lit(5), F.floor((5 + z("n")) / n)).alias(f"lvl{n}") for n in (6, 11, 16)])


def events(s: Star) -> DataFrame:
    """Lines as events; the losing side's number is in ``team`` for kills and towers, the taker's for dragons."""
    side = F.when(F.col("team") == "F", 100).otherwise(200)
    kind = F.when(F.col("flag") == "R", "kill").when(F.col("flag") == "A", "tower").otherwise("monster")
    actor = F.col("item") % 5 + 1 + F.when(side == 100, 0).otherwise(5)
    helper = (F.col("item") + 1) % 5 + 1 + F.when(side == 100, 0).otherwise(5)
    victim = F.col("supplier") % 5 + 1 + F.when(side == 100, 5).otherwise(0)
    # Dealt by their game whether or not a reader needs their numbers: scans beside the frames then shuffle nothing more.
    e = s.played().repartition("game_id").select(
        F.col("game_id").alias("match_id"), ((F.col("slot") - 1) * 60000 + F.col("price") % 60000).cast("long").alias("t"), "item", "supplier", "price", "quantity",
        kind.alias("kind"), side.alias("side"), F.when(kind == "monster", side).otherwise(300 - side).alias("team"),
        F.when(kind == "monster", "DRAGON").alias("monster"), F.when(kind == "tower", "outer").alias("ring"),
        F.when(kind == "kill", 300.0).alias("bounty"), F.when(kind == "kill", (F.col("discount") * 10).cast("double")).alias("shutdown"),
        (1 + F.col("slot")).cast("int").alias("victim_level"), actor.cast("int").alias("actor"),
        F.when(F.col("quantity") > 25, F.array(helper.cast("int"))).otherwise(F.array().cast("array<int>")).alias("helpers"), victim.cast("int").alias("victim"))
    return W.with_respawn(W.sequence_events(e, ["t", "item", "supplier", "price", "quantity"]))


PLAY_SQL = LINES_SQL + """,
e0 AS (SELECT game_id AS match_id, CAST((slot - 1) * 60000 + price % 60000 AS BIGINT) AS t, item, supplier, price, quantity, slot,
  CASE flag WHEN 'R' THEN 'kill' WHEN 'A' THEN 'tower' ELSE 'monster' END AS kind, CASE team WHEN 'F' THEN 100 ELSE 200 END AS side, discount FROM lines),
e AS (SELECT *, CASE WHEN kind = 'monster' THEN side ELSE 300 - side END AS team, CASE WHEN kind = 'kill' THEN 300.0 + discount * 10 ELSE 0.0 END AS bounty,
  row_number() OVER (PARTITION BY match_id ORDER BY t, item, supplier, price, quantity) AS seq FROM e0),
cells AS (SELECT match_id, team, minute FROM (SELECT DISTINCT match_id FROM e), (VALUES (100), (200)) x(team), generate_series(0, 7) y(minute)),
fr AS (SELECT c.match_id, c.team, c.minute, 2500 + 100 * coalesce(sum(quantity), 0) AS gold, 300 * coalesce(sum(discount), 0) AS xp FROM cells c
  LEFT JOIN e ON e.match_id = c.match_id AND e.side = c.team AND e.slot <= c.minute GROUP BY ALL)"""
STATE_SQL = PLAY_SQL + """,
asks AS (SELECT match_id, 'b:' || seq AS ask, seq, t, seq - 1 AS cut, 0.0 AS b1, 0.0 AS b2 FROM e UNION ALL
  SELECT match_id, 'a:' || seq, seq, t, seq, CASE WHEN team = 200 THEN bounty ELSE 0.0 END, CASE WHEN team = 100 THEN bounty ELSE 0.0 END FROM e),
run AS (SELECT match_id, seq, sum((kind = 'kill' AND team = 100)::INT) OVER w AS kl1, sum((kind = 'kill' AND team = 200)::INT) OVER w AS kl2,
  sum((kind = 'tower' AND team = 100)::INT) OVER w AS tl1, sum((kind = 'tower' AND team = 200)::INT) OVER w AS tl2,
  sum((kind = 'monster' AND team = 100)::INT) OVER w AS dr1, sum((kind = 'monster' AND team = 200)::INT) OVER w AS dr2 FROM e WINDOW w AS (PARTITION BY match_id ORDER BY seq)),
g AS (SELECT a.*, f1.gold + (coalesce(n1.gold, f1.gold) - f1.gold) * (a.t - least(a.t // 60000, 7) * 60000) / 60000 + b1 AS gold1, f2.gold + (coalesce(n2.gold, f2.gold) - f2.gold) * (a.t - least(a.t // 60000, 7) * 60000) / 60000 + b2 AS gold2
  FROM asks a JOIN fr f1 ON f1.match_id = a.match_id AND f1.team = 100 AND f1.minute = a.t // 60000 JOIN fr f2 ON f2.match_id = a.match_id AND f2.team = 200 AND f2.minute = a.t // 60000
  LEFT JOIN fr n1 ON n1.match_id = a.match_id AND n1.team = 100 AND n1.minute = a.t // 60000 + 1 LEFT JOIN fr n2 ON n2.match_id = a.match_id AND n2.team = 200 AND n2.minute = a.t // 60000 + 1),
st AS (SELECT g.match_id, g.ask, g.seq, g.t, (gold1 - gold2) / 1000 AS gold_diff, coalesce(kl2, 0) AS kills_own, coalesce(kl1, 0) AS kills_enemy, coalesce(tl2, 0) AS towers_own, coalesce(tl1, 0) AS towers_enemy,
  coalesce(dr1, 0) AS dragons_own, coalesce(dr2, 0) AS dragons_enemy FROM g LEFT JOIN run ON run.match_id = g.match_id AND run.seq = g.cut)"""


@query("state_at", with_sql(STATE_SQL) + """
SELECT match_id, ask, t, round(gold_diff, 6) AS gold_diff, CAST(kills_own AS DOUBLE) AS kills_own, CAST(kills_enemy AS DOUBLE) AS kills_enemy, CAST(towers_own AS DOUBLE) AS towers_own,
  CAST(towers_enemy AS DOUBLE) AS towers_enemy, CAST(dragons_own AS DOUBLE) AS dragons_own, CAST(dragons_enemy AS DOUBLE) AS dragons_enemy FROM st""")
def state_at(s: Star) -> DataFrame:
    e = events(s)
    st = W.game_state(W.event_asks(e), frames(s), e)
    v = W.view(100)
    cols = ("kills_own", "kills_enemy", "towers_own", "towers_enemy", "dragons_own", "dragons_enemy")
    return st.select("match_id", "ask", "t", F.round(v["gold_diff"], 6).alias("gold_diff"), *[v[c].alias(c) for c in cols])


@query("training_states")
def training_states(s: Star) -> DataFrame:
    """Every whole minute from both sides with the label: the win-probability training set."""
    inputs = ["gold_diff", "kills_own", "kills_enemy", "towers_own", "dragons_own", "alive_own"]
    return training_set(s, inputs).select("match_id", "t", "side", "won", *inputs)


def training_set(s: Star, inputs: Sequence[str]) -> DataFrame:
    """The named inputs of the view: an exploded struct is never pruned, so only these are put into it."""
    e, f = events(s), frames(s)
    st = W.game_state(W.minute_asks(f, e), f, e).where("t > 0")
    won = s.games().select(F.col("game_id").alias("match_id"), F.col("win").alias("blue_won"))
    views = {side: W.view(side) for side in W.TEAMS}
    sides = F.array(*[F.struct(F.lit(side).alias("side"), *[v[n].alias(n) for n in inputs]) for side, v in views.items()])
    rows = st.select("match_id", "t", F.explode(sides).alias("_v")).select("match_id", "t", "_v.*")
    return rows.join(grown(won), "match_id").withColumn("won", (F.col("blue_won") == (F.col("side") == 100)).cast("int")).drop("blue_won")


SWING_SQL = STATE_SQL + """,
ch AS (SELECT match_id, ask, seq, t, 1 / (1 + exp(-(0.4 * gold_diff + 0.3 * (kills_own - kills_enemy) + 0.5 * (towers_own - towers_enemy)))) AS p FROM st),
sw AS (SELECT b.match_id, b.seq, b.t, b.p AS before, a.p AS after, a.p - b.p AS d FROM ch b JOIN ch a ON a.match_id = b.match_id AND a.seq = b.seq AND a.ask = 'a:' || a.seq AND b.ask = 'b:' || b.seq)"""


def _before_after(s: Star) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = written(events(s), "events")
    st = written(W.game_state(W.event_asks(e), frames(s), e), "states")
    parts = F.split("ask", ":")
    st = st.withColumn("moment", parts[1].cast("long"))
    return e, st.where(parts[0] == "b").drop("ask"), st.where(parts[0] == "a").drop("ask")


@query("shapley_split")
def shapley_split(s: Star) -> DataFrame:
    _, before, after = _before_after(s)
    out = W.explained_changes(before, after, ["match_id", "moment"])
    return out.select("match_id", "moment", "change", *[F.round(c, 8).alias(c) for c in ("value", "before", "after", "d")])


@query("shapley_total", with_sql(SWING_SQL) + "SELECT match_id, seq AS moment, round(before, 6) AS before, round(d, 6) + 0.0 AS d, round(d, 6) + 0.0 AS explained FROM sw")
def shapley_total(s: Star) -> DataFrame:
    """The split of every change adds up to the change itself."""
    _, before, after = _before_after(s)
    out = W.explained_changes(before, after, ["match_id", "moment"])
    return out.groupBy("match_id", "moment").agg(F.round(F.max("before"), 6).alias("before"), (F.round(F.max("d"), 6) + 0.0).alias("d"), (F.round(F.sum("value"), 6) + 0.0).alias("explained"))


def swings(s: Star, e: DataFrame) -> DataFrame:
    """What each scored event did to the chance: (match, moment, d). Only what the chance reads of the states is worked out."""
    p = W.stub_chance(W.game_state(W.event_asks(e), frames(s), e), "_p")
    parts = F.split("ask", ":")
    of = lambda tag: F.max(F.when(parts[0] == tag, F.col("_p")))
    return p.groupBy("match_id", parts[1].cast("long").alias("moment")).agg((of("a") - of("b")).alias("d"))


def facts(s: Star) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts of every event, chance per minute, earnings per player and minute, results)."""
    e = written(events(s), "events")
    d = swings(s, e)
    c = F.col
    ev = e.select("match_id", c("seq").alias("moment"), "t", F.lit(MINUTES - 1).alias("last"),
                  F.when(c("kind") == "kill", "kills").when(c("kind") == "tower", "structures").otherwise("objectives").alias("kind"), "side", "team", "back",
                  c("actor").alias("killer"), "helpers", "victim", F.map_from_arrays(F.array("actor"), F.array(c("price").cast("double"))).alias("damage"),
                  F.array_distinct(F.concat(F.array("actor"), c("helpers"))).alias("got"),
                  F.when(c("quantity") < 10, F.array("victim")).otherwise(F.array().cast("array<int>")).alias("dead"), F.lit(None).cast("int").alias("by"))
    f = ev.join(grown(d), ["match_id", "moment"])
    fr = frames(s)
    curve = W.stub_chance(W.game_state(W.minute_asks(fr, e), fr, e), "p").select("match_id", (c("t") / 60000).cast("int").alias("minute"), "p")
    # A player earns the lines it acted in; every player of every minute has a row.
    acted = e.select("match_id", c("actor").alias("player"), F.floor(c("t") / 60000).cast("int").alias("minute"), (c("quantity") * 100).alias("got")).repartition("match_id")
    grid = acted.select("match_id").distinct().select("match_id", F.lit(None).cast("int").alias("player"), F.explode(F.sequence(F.lit(0), F.lit(MINUTES - 2))).alias("minute"), F.lit(0).cast("long").alias("got"))
    full = acted.where(c("minute").between(0, MINUTES - 2)).unionByName(grid).groupBy("match_id", "minute").agg(
        *[F.sum(F.when(c("player") == p, c("got")).otherwise(0)).cast("double").alias(f"got{p}") for p in W.PLAYERS])
    # Two players share a lane: the opponent is the other one of it.
    players = F.array(*[F.struct(F.lit(p).alias("player"), c(f"got{p}").alias("got"), (c(f"got{p}") - c(f"got{(p + 4) % 10 + 1}")).alias("gap")) for p in W.PLAYERS])
    earned = full.select("match_id", "minute", F.explode(players).alias("_x")).select("match_id", "_x.player", "minute", "_x.got", "_x.gap")
    results = s.games().select(c("game_id").alias("match_id"), F.when(c("win"), 100).otherwise(200).alias("winner"))
    return f, curve, earned, results


def shares(s: Star) -> DataFrame:
    f, curve, earned, results = facts(s)
    # Dealt by the match, all shares of a match are in one place: what is made of them needs no other shuffle.
    f, curve = written(f, "facts").repartition("match_id"), written(curve, "curve")
    rules = W.rules_table(s.spark, [("default", {})]).drop("rules")
    ruled = f.crossJoin(F.broadcast(rules))
    return W.event_shares(ruled).unionByName(W.drift_shares(curve, f, earned)).unionByName(W.edge_shares(curve, results))


@query("credit_share", with_sql(LINES_SQL) + """
SELECT game_id AS match_id, CASE WHEN status = 'F' THEN 50.0 ELSE -50.0 END AS blue, CASE WHEN status = 'F' THEN -50.0 ELSE 50.0 END AS red FROM (SELECT DISTINCT game_id, status FROM lines)""")
def credit_share(s: Star) -> DataFrame:
    """Each side's ten players' credit adds up to exactly half a win: the zero-sum property."""
    c = W.credit(shares(s))
    tot = lambda cond: F.round(F.sum(F.when(cond, F.col("total"))), 6) + 0.0
    return c.groupBy("match_id").agg(tot(F.col("player") <= 5).alias("blue"), tot(F.col("player") > 5).alias("red"))


@query("player_credit")
def player_credit(s: Star) -> DataFrame:
    c = W.credit(shares(s))
    return c.select("match_id", "player", *[F.round(p, 6).alias(p) for p in (*W.PARTS, "total")])


@query("credit_line")
def credit_line(s: Star) -> DataFrame:
    return W.running_line(shares(s)).withColumn("line", F.round("line", 6))


@query("best_plays")
def best_plays(s: Star) -> DataFrame:
    return W.best_plays(shares(s))


NORMS_SQL = SWING_SQL + """,
m AS (SELECT sw.*, CASE e.kind WHEN 'kill' THEN 'kills' WHEN 'tower' THEN 'structures' ELSE 'objectives' END AS kind, side FROM sw JOIN e ON e.match_id = sw.match_id AND e.seq = sw.seq)"""


@query("moment_norms", with_sql(NORMS_SQL) + """
SELECT kind, CAST(least(t // 600000, 3) AS INTEGER) AS stage, round(avg(abs(d) * 100), 6) AS typical, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 50""")
def moment_norms(s: Star) -> DataFrame:
    f = facts(s)[0]
    return W.moment_norms(f).withColumn("typical", F.round("typical", 6))


@query("moment_leverage", with_sql(NORMS_SQL) + """,
n AS (SELECT kind, avg(abs(d) * 100) AS typical FROM m GROUP BY kind)
SELECT match_id, seq AS moment, kind, round(100 * abs(d) / typical, 5) AS leverage FROM m JOIN n USING (kind)""")
def moment_leverage(s: Star) -> DataFrame:
    f = written(facts(s)[0], "facts")
    return W.leverage(f, W.moment_norms(f)).select("match_id", "moment", "kind", F.round("leverage", 5).alias("leverage"))


_RESPAWN = "[6, 6, 8, 8, 10, 12, 16, 21, 26, 32.5, 35, 37.5, 40, 42.5, 45, 47.5, 50, 52.5]"


@query("cost_while_dead", with_sql(NORMS_SQL) + f"""
SELECT k.match_id, k.seq AS moment, round(coalesce(sum(100 * abs(x.d)), 0), 5) AS cost, count(x.seq) AS taken
FROM (SELECT e.match_id, e.seq, e.t, e.team, e.t + 1000 * {_RESPAWN}[slot + 1] AS back FROM e WHERE kind = 'kill') k
LEFT JOIN m x ON x.match_id = k.match_id AND x.kind <> 'kills' AND x.side <> k.team AND x.t > k.t AND x.t <= k.back GROUP BY ALL""")
def cost_while_dead(s: Star) -> DataFrame:
    f = written(facts(s)[0], "facts")
    deaths = f.where("kind = 'kills'").select("match_id", "moment", "t", "team", "back")
    taken = f.where("kind <> 'kills'").select("match_id", "side", "t", "d")
    return W.while_away(deaths, taken).select("match_id", "moment", F.round("cost", 5).alias("cost"), "taken")


@query("rule_sensitivity")
def rule_sensitivity(s: Star) -> DataFrame:
    """The same attribution under other sharing rules: correlation and mean change against the default."""
    f, curve, earned, results = facts(s)
    f, curve = written(f, "facts"), written(curve, "curve")
    variants = W.rules_table(s.spark, [("default", {}), ("half", {"kill_split": "half"}), ("earned", {"economy_split": "earned"}),
                                       ("no_team", {"team_share": 0.0}), ("all_dead", {"dead_share": 1.0})])
    ruled = f.crossJoin(F.broadcast(variants))
    drift = W.drift_shares(curve, ruled, earned, ["rules", "even_economy", "economy_split"])
    all_ = W.event_shares(ruled).unionByName(drift).unionByName(W.edge_shares(curve, results, variants))
    c = W.credit(all_, ["match_id", "rules"])
    base = c.where("rules = 'default'").select("match_id", "player", F.col("total").alias("_base"))
    return (c.join(grown(base), ["match_id", "player"]).groupBy("rules")
            .agg(F.round(F.corr("total", "_base"), 6).alias("r"), F.round(F.avg(F.abs(F.col("total") - F.col("_base"))), 6).alias("mean_change"),
                 F.count(F.lit(1)).alias("n")))
