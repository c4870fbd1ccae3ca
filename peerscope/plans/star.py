"""Bind the driver's star tables to the roles of the model, in Spark and (as SQL text) for the oracle.

A game is an order, a player its customer, a tier the customer's segment, a role the order's priority, a
patch its year. A line stands for a participant: its side is the line status, its slot the line number, its
champion the part's brand, its item the part. Amounts become whole numbers so sums are exact in any order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalogue import METRIC_SCHEMA
from ..operators.joins import opponents
from ..operators.scale import beside, bounded, most_rows
from ..session import deal, prepare

TIERS = ("BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE")
LINE_METRICS = ("quantity", "price", "discount", "tax")
METRIC_KEYS = ("game_id", "player", "tier", "role", "champion")

# The binding's own metrics, as rows of the catalogue.
STAR_METRICS = [
    ("quantity", "farming", True, True, []),
    ("price", "economy", True, True, []),
    ("discount", "survival", False, True, []),
    ("tax", "vision", True, True, ["2-HIGH"]),
]

GAMES_SQL = """
games AS (
  SELECT o_orderkey AS game_id, o_custkey AS player, o_orderdate AS start_at,
         CAST(epoch(o_orderdate) AS BIGINT) AS start_s, 900 + (o_orderkey * 37) % 1800 AS duration_s,
         o_orderpriority AS role, c_mktsegment AS tier, CAST(year(o_orderdate) AS BIGINT) AS patch,
         o_orderstatus = 'F' AS win, o_orderstatus AS status,
         CAST(round(o_totalprice * 100) AS BIGINT) AS total, CAST(round(o_totalprice * 100) AS BIGINT) % 10000 AS score
  FROM orders JOIN customer ON c_custkey = o_custkey)"""
LINES_SQL = GAMES_SQL + """,
lines AS (
  SELECT game_id, player, start_s, role, tier, patch, duration_s, status, score AS game_score,
         l_linenumber AS slot, l_linestatus AS team, l_linestatus = status AS win, l_returnflag AS flag,
         p_brand AS champion, p_type AS class, l_partkey AS item, l_suppkey AS supplier,
         CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice) AS BIGINT) AS price,
         CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(l_tax * 100) AS BIGINT) AS tax,
         CAST(epoch(l_shipdate) AS BIGINT) AS ship_s
  FROM lineitem JOIN games ON game_id = l_orderkey JOIN part ON p_partkey = l_partkey)"""
SEATS_SQL = LINES_SQL + """,
seats AS (
  SELECT game_id, slot, team, min(champion) AS champion, min(supplier) AS supplier, max(item) AS item,
         bool_or(win) AS win, min(duration_s) AS duration_s, min(role) AS role, min(tier) AS tier, min(patch) AS patch,
         CAST(sum(quantity) AS BIGINT) AS gold, CAST(sum(discount) AS BIGINT) AS kills, CAST(sum(tax) AS BIGINT) AS deaths,
         CAST(count(*) AS BIGINT) AS assists, CAST(sum(price) AS BIGINT) AS damage, min(start_s) AS start_s
  FROM lines GROUP BY game_id, slot, team)"""
BUILDS_SQL = SEATS_SQL + """,
builds AS (
  SELECT s.game_id AS match_id, s.supplier AS player, s.team, s.slot AS role, s.champion, o.champion AS opponent,
         s.win, s.kills, s.deaths, s.assists, s.gold AS cs, s.damage, s.gold * 100 + s.kills AS gold, s.item % 50 AS vision,
         s.duration_s, s.patch, s.tier, CAST(sum(s.kills) OVER (PARTITION BY s.game_id, s.team) AS BIGINT) AS team_kills,
         s.start_s, s.gold - o.gold AS cs_diff, s.damage - o.damage AS gold_diff, o.deaths AS opp_deaths
  FROM seats s LEFT JOIN seats o ON o.game_id = s.game_id AND o.slot = s.slot AND o.team <> s.team)"""
CARTS_SQL = LINES_SQL + """,
carts AS (
  SELECT game_id AS match_id, min(player) AS player, min(role) AS role, min(tier) AS tier, min(patch) AS patch,
         min(status) = 'F' AS win, min(champion) AS champion, list(item % 40 ORDER BY slot, item) AS purchases,
         list((slot - 1) * 20 ORDER BY slot, item) AS purchase_s
  FROM lines GROUP BY game_id)"""
EVENTS_SQL = """
ev AS (
  SELECT event_id, user_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS us, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, ts,
         CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


class Star:
    """The bound tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir
        deal(self.spark, [f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "events")])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def games(self) -> DataFrame:
        start = F.col("o_orderdate").cast("timestamp")
        total = F.round(F.col("o_totalprice") * 100).cast("long")
        return self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("game_id"), F.col("o_custkey").alias("player"), start.alias("start_at"),
            F.unix_timestamp(start).alias("start_s"), (F.lit(900) + F.col("o_orderkey") * 37 % 1800).alias("duration_s"),
            F.col("o_orderpriority").alias("role"), F.col("c_mktsegment").alias("tier"),
            F.year(start).cast("long").alias("patch"), (F.col("o_orderstatus") == "F").alias("win"),
            F.col("o_orderstatus").alias("status"), total.alias("total"), (total % 10000).alias("score"))

    def lines(self) -> DataFrame:
        cents = lambda c: F.round(F.col(c) * 100).cast("long")
        ship = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
        g = self.games().select("game_id", "player", "start_s", "role", "tier", "patch", "duration_s", "status",
                                F.col("score").alias("game_score"))
        return (self.table("lineitem").join(g, F.col("l_orderkey") == F.col("game_id"))
                .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
                .select("game_id", "player", "start_s", "role", "tier", "patch", "duration_s", "status", "game_score",
                        F.col("l_linenumber").alias("slot"), F.col("l_linestatus").alias("team"),
                        (F.col("l_linestatus") == F.col("status")).alias("win"), F.col("l_returnflag").alias("flag"),
                        F.col("p_brand").alias("champion"), F.col("p_type").alias("class"),
                        F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supplier"),
                        F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice")).cast("long").alias("price"),
                        cents("l_discount").alias("discount"), cents("l_tax").alias("tax"), ship.alias("ship_s")))

    @cached_property
    def most_lines(self) -> int | None:
        """At least the lines of the game with the most, counted once for everything made of a game's lines."""
        return most_rows(self.table("lineitem"), "l_orderkey")

    def played(self) -> DataFrame:
        """The columns of ``lines`` that the line itself has: no join, for what needs nothing of its game or item."""
        return self.table("lineitem").select(
            bounded(F.col("l_orderkey"), "game_id", self.most_lines), F.col("l_linenumber").alias("slot"), F.col("l_linestatus").alias("team"), F.col("l_returnflag").alias("flag"),
            F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("long").alias("quantity"),
            F.round(F.col("l_extendedprice")).cast("long").alias("price"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"))

    def seats(self, lines: DataFrame | None = None) -> DataFrame:
        """One row per (game, slot, side): the lines of a seat are combined, because a line number repeats."""
        lines = self.lines() if lines is None else lines
        return lines.groupBy("game_id", "slot", "team").agg(
            F.min("champion").alias("champion"), F.min("supplier").alias("supplier"), F.max("item").alias("item"),
            F.bool_or("win").alias("win"), F.min("duration_s").alias("duration_s"), F.min("role").alias("role"),
            F.min("tier").alias("tier"), F.min("patch").alias("patch"),
            F.sum("quantity").alias("gold"), F.sum("discount").alias("kills"), F.sum("tax").alias("deaths"),
            F.count(F.lit(1)).alias("assists"), F.sum("price").alias("damage"), F.min("start_s").alias("start_s"))

    def builds(self) -> DataFrame:
        seats = self.seats()
        full = beside(seats, ["game_id", "team"], {"team_kills": F.sum("kills")})
        faced = opponents(full, "game_id", "slot", "team",
                          {"opponent": "champion", "_og": "gold", "_od": "damage", "opp_deaths": "deaths"}, "left")
        return faced.select(
            F.col("game_id").alias("match_id"), F.col("supplier").alias("player"), "team", F.col("slot").alias("role"), "champion",
            "opponent", "win", "kills", "deaths", "assists", F.col("gold").alias("cs"), "damage",
            (F.col("gold") * 100 + F.col("kills")).alias("gold"), (F.col("item") % 50).alias("vision"), "duration_s", "patch",
            "tier", "team_kills", "start_s", (F.col("gold") - F.col("_og")).alias("cs_diff"),
            (F.col("damage") - F.col("_od")).alias("gold_diff"), "opp_deaths")

    def carts(self) -> DataFrame:
        """A game's lines as its purchases in order."""
        bought = F.array_sort(F.collect_list(F.struct("slot", "item")))
        return (self.lines().groupBy(F.col("game_id").alias("match_id")).agg(
            F.min("player").alias("player"), F.min("role").alias("role"), F.min("tier").alias("tier"), F.min("patch").alias("patch"),
            (F.min("status") == "F").alias("win"), F.min("champion").alias("champion"), bought.alias("_b"))
            .select("match_id", "player", "role", "tier", "patch", "win", "champion",
                    F.transform("_b", lambda x: x["item"] % 40).alias("purchases"),
                    F.transform("_b", lambda x: (x["slot"] - 1) * 20).alias("purchase_s")))

    def events(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            "event_id", "user_id", "event_type", F.unix_micros(ts).alias("us"), F.unix_seconds(ts).alias("s"),
            ts.alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"),
            F.get_json_object("props", "$.k").cast("long").alias("k"))

    def catalogue(self) -> DataFrame:
        return self.spark.createDataFrame([(*r, "game") for r in STAR_METRICS], METRIC_SCHEMA)

    def metric_lines(self) -> DataFrame:
        return self.lines().select(*METRIC_KEYS, *LINE_METRICS)

    def metric_rows(self, lines: DataFrame | None = None) -> DataFrame:
        """Lines, or the same read back, as long metric rows."""
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                          for m in LINE_METRICS])
        lines = self.metric_lines() if lines is None else lines
        return lines.select(*METRIC_KEYS, F.explode(pairs).alias("_x")).select(*METRIC_KEYS, "_x.metric", "_x.value")


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
