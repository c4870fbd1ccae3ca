"""Runes, spells, boots and skill orders: what is chosen most, and how it does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import statistics as G
from ..sources import matches as M
from .documents import matches
from .registry import query
from .star import CARTS_SQL, EVENTS_SQL, SEATS_SQL, Star, with_sql

# The runes of the documents, worked out from the seats.
RUNES_SQL = SEATS_SQL + """,
runes AS (
  SELECT 'M_' || game_id AS match_id, slot + CASE team WHEN 'F' THEN 0 ELSE 7 END AS participant_id, 'R' || slot AS role, win, item,
         CASE WHEN item % 11 <> 0 THEN 8000 + item % 4 END AS keystone, CASE WHEN item % 11 <> 0 THEN 8000 + item % 3 * 100 END AS primary_style,
         CASE WHEN item % 11 <> 0 AND item % 7 <> 3 THEN 8400 + item % 2 * 100 END AS sub_style,
         CASE WHEN item % 11 <> 0 THEN (8000 + item % 4) || '-' || (8100 + kills % 3) || CASE WHEN item % 7 <> 3 THEN '-' || (8300 + slot % 2) ELSE '' END
           || '-' || (5000 + item % 2) || CASE WHEN item % 5 <> 1 THEN '-5007' ELSE '' END || '-5002' END AS page,
         least(4, item % 5 + 1) || '-' || greatest(4, item % 5 + 1) AS spells
  FROM seats WHERE game_id % 50 <> 7)"""


def top_sql(keys: str, shown: dict[str, int]) -> str:
    """From rows k(role, win, kind, key): the places of each kind."""
    limit = " ".join(f"WHEN '{k}' THEN {n}" for k, n in shown.items())
    return f"""
n AS (SELECT {keys}, kind, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT {keys}, kind, key, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM k WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
SELECT r.{keys}, r.kind, r.key, games, wins, 100 * wins / games AS win_rate, 100 * games / n AS pick_rate,
  row_number() OVER (PARTITION BY r.{keys}, r.kind ORDER BY games DESC, wins DESC, key) AS place
FROM r JOIN n ON n.{keys} = r.{keys} AND n.kind = r.kind QUALIFY place <= CASE r.kind {limit} END"""


@query("rune_columns", with_sql(RUNES_SQL) + " SELECT match_id, participant_id, keystone, primary_style, sub_style, page FROM runes")
def rune_columns(s: Star) -> DataFrame:
    p = M.participants(matches(s))
    return p.select("match_id", "participant_id", "keystone", "primary_style", "sub_style", F.array_join(F.col("perks").cast("array<string>"), "-").alias("page"))


@query("loadout_choices", with_sql(RUNES_SQL) + """,
k AS (SELECT role, win, 'runes' AS kind, CASE WHEN keystone IS NOT NULL THEN keystone || '-' || primary_style || '-' || coalesce(CAST(sub_style AS VARCHAR), '') END AS key FROM runes
  UNION ALL SELECT role, win, 'rune_pages', page FROM runes UNION ALL SELECT role, win, 'spells', spells FROM runes),""" + top_sql("role", G.SHOWN))
def loadout_choices(s: Star) -> DataFrame:
    return G.top_shown(G.loadout_choices(M.participants(matches(s)), ["role"]), ["role"])


BOOTS = (3, 11, 17, 29)


@query("boots_choices", with_sql(CARTS_SQL) + f""",
b AS (SELECT role, win, list_filter(purchases, lambda i: i IN {BOOTS}) AS boots FROM carts),
k AS (SELECT role, win, 'boots' AS kind, CAST(boots[1] AS VARCHAR) AS key FROM b),""" + top_sql("role", G.SHOWN))
def boots_choices(s: Star) -> DataFrame:
    return G.top_shown(G.boots_choices(s.carts(), ["role"], BOOTS), ["role"])


# A user's five days stand for a game, the events in them for level-ups.
ORDERS_SQL = EVENTS_SQL + """,
orders_ AS (
  SELECT user_id % 3 AS role, user_id % 2 = 0 AS win, string_agg(substr('QWER', CAST(k % 4 + 1 AS INT), 1), '' ORDER BY us, event_id) AS o
  FROM ev GROUP BY user_id, s // 432000),
cut AS (SELECT *, substr(o, 1, 15) AS f FROM orders_),
ups AS (SELECT *, list_transform(['Q', 'W', 'E'], lambda c: list_filter(range(1, length(f) + 1), lambda i: substr(f, i, 1) = c)) AS hits FROM cut),
ranked AS (
  SELECT role, win, o, f, list_sort(list_transform([1, 2, 3], lambda i: CASE WHEN len(hits[i]) >= 5 THEN hits[i][5] ELSE 1000 - 10 * len(hits[i]) END * 10 + i)) AS marks FROM ups)"""


@query("skill_choices", with_sql(ORDERS_SQL) + """,
k AS (SELECT role, win, 'skill_max' AS kind, CASE WHEN length(f) >= 9 THEN array_to_string(list_transform(marks, lambda m: substr('QWE', CAST(m % 10 AS INT), 1)), '') END AS key FROM ranked
  UNION ALL SELECT role, win, 'skill_order', CASE WHEN length(o) >= 15 THEN f END FROM ranked),""" + top_sql("role", G.SHOWN))
def skill_choices(s: Star) -> DataFrame:
    log = s.events().select(F.concat_ws("_", "user_id", F.floor(F.col("s") / 432000).cast("string")).alias("match_id"), F.col("user_id").alias("participantId"), F.lit("SKILL_LEVEL_UP").alias("type"),
                            F.lit("NORMAL").alias("levelUpType"), (F.col("k") % 4 + 1).cast("int").alias("skillSlot"), F.col("us").alias("timestamp"), F.col("event_id").alias("pos"))
    orders = M.skill_orders(log).select((F.col("participant_id") % 3).alias("role"), (F.col("participant_id") % 2 == 0).alias("win"), "skill_order")
    return G.top_shown(G.skill_choices(orders, ["role"]), ["role"])
