"""Moment review on the event binding: a user is a recording, an event a reading with written predictions, some of them trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import moments as M
from ..operators.ordered import running
from ..operators.scale import written
from .registry import query
from .star import EVENTS_SQL, Star, with_sql

RARE, COMMON, THREAT, DEATH_RATE = 0.25, 0.5, 0.6, 0.05
GAP = "CASE WHEN event_id % 9 = 0 THEN 3.0 + cents % 100 * 0.25 ELSE 0.25 * (1 + event_id % 3) END"
READING = {"p_trade": "cents % 100 / 125", "net": "CASE WHEN event_id % 8 <> 0 THEN (cents % 21 - 8) / 50 END", "won": "CASE WHEN event_id % 8 <> 0 THEN cents % 13 / 13 END",
           "p_hit": "cents % 37 / 37", "p_died": "cents % 11 / 50", "in_range": "event_id % 6"}
TRADE = {"me_lost": "cents % 20 / 100", "opponent_lost": "cents % 17 / 100", "started_by": "CASE cents % 3 WHEN 0 THEN 'you' WHEN 1 THEN 'opponent' ELSE 'both' END", "skirmish": "event_id % 9 = 4",
         "result": "CASE WHEN cents % 20 > cents % 17 THEN 'lost' WHEN cents % 20 < cents % 17 THEN 'won' ELSE 'even' END", "died": "event_id % 4 = 0"}
IS_TRADE = "cents % 5 = 0"


def bound(s: Star) -> tuple[DataFrame, DataFrame]:
    """Readings at running times of quarter seconds, and trades an eighth of a second after theirs."""
    e = s.events().select("event_id", F.col("user_id").alias("recording"), "us", "cents").withColumn("_gap", F.expr(GAP).cast("double"))
    e = written(running(e, ["recording"], ["us", "event_id"], {"t": ("sum", F.col("_gap"))}), "timed")
    readings = e.select("recording", "t", *[F.expr(v).alias(n) for n, v in READING.items()])
    trades = e.where(IS_TRADE).select("recording", F.col("event_id").alias("trade"), (F.col("t") + 0.125).alias("start"), *[F.expr(v).alias(n) for n, v in TRADE.items()])
    return readings, trades


# The same rules with joins over each recording's readings, and a fold over its sorted moments.
REVIEW_SQL = EVENTS_SQL + f""",
tm AS (SELECT event_id, user_id AS recording, cents, sum(CAST({GAP} AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY us, event_id) AS t FROM ev),
rd AS (SELECT recording, t, {", ".join(f"{v} AS {n}" for n, v in READING.items())}, t - lag(t) OVER (PARTITION BY recording ORDER BY t) AS gap FROM tm),
tr AS (SELECT recording, event_id AS trade, t + 0.125 AS start, {", ".join(f"{v} AS {n}" for n, v in TRADE.items())} FROM tm WHERE {IS_TRADE}),
sp AS (SELECT recording, coalesce(least(greatest(median(gap), 0.1), 1.0), 0.25) AS step FROM rd GROUP BY recording),
bf AS (SELECT tr.*, rd.p_trade AS at_p, rd.net AS at_net, rd.won AS at_won, rd.p_died AS at_died FROM tr JOIN rd ON rd.recording = tr.recording AND rd.t < tr.start AND tr.start - rd.t <= 1.5
  WHERE started_by <> 'opponent' AND NOT skirmish QUALIFY row_number() OVER (PARTITION BY tr.recording, trade ORDER BY rd.t DESC) = 1),
sm AS (SELECT rd.recording, round(sum(p_trade) * any_value(step), 1) AS expected, (SELECT count(*) FROM tr WHERE tr.recording = rd.recording AND started_by <> 'opponent') AS trades,
  (SELECT avg(at_net) FROM bf WHERE bf.recording = rd.recording) AS expected_net, (SELECT avg(opponent_lost - me_lost) FROM bf WHERE bf.recording = rd.recording) AS actual_net FROM rd JOIN sp USING (recording) GROUP BY rd.recording)"""
MOMENTS_SQL = REVIEW_SQL + f""",
ns AS (SELECT *, sum((gap IS NULL OR gap > 0.75)::INT) OVER (PARTITION BY recording ORDER BY t) AS spot FROM rd),
st AS (SELECT recording, spot, min(t) AS t, max(t) + 1 AS until, sum(p_trade) AS p, sum(net * p_trade) / nullif(sum(p_trade), 0) AS net, sum(won * p_trade) / nullif(sum(p_trade), 0) AS won FROM ns GROUP BY ALL),
ms AS (SELECT st.recording, t, 'missed_trade' AS kind, 'weakness' AS polarity, p * step * greatest(coalesce(nullif(net, 0), 0.05), 0.05) * 100 AS impact FROM st JOIN sp USING (recording)
  WHERE p * step >= 0.6 AND (net IS NULL OR net >= 0.04) AND (won IS NULL OR won >= 0.5) AND (net IS NOT NULL OR won IS NOT NULL OR p * step >= 1)
  AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.recording = st.recording AND started_by <> 'opponent' AND start BETWEEN st.t AND st.until)),
ra AS (SELECT *, coalesce(at_p < {RARE} AND result = 'lost' AND (coalesce(at_net < 0, false) OR coalesce(at_won < 0.45, false)), false) AS bad FROM bf),
ch AS (SELECT recording, start AS t, 'rare_trade' AS kind, 'weakness' AS polarity, 100 * (me_lost - opponent_lost) AS impact FROM ra WHERE bad
  UNION ALL SELECT recording, start, 'good_trade', 'strength', 100 * (opponent_lost - me_lost) FROM ra WHERE NOT bad AND at_p >= {COMMON} AND result = 'won'),
sc AS (SELECT tr.recording, start AS t, 'spacing' AS kind, 'weakness' AS polarity, 100 * (any_value(me_lost) - any_value(opponent_lost)) AS impact FROM tr JOIN rd ON rd.recording = tr.recording AND rd.t >= tr.start - 3 AND rd.t < tr.start
  WHERE started_by = 'opponent' AND NOT skirmish AND result = 'lost' GROUP BY tr.recording, trade, start HAVING max(p_hit) >= {THREAT} AND arg_max(in_range, rd.t) >= 2),
ri AS (SELECT recording, start AS t, 'risky_trade' AS kind, 'weakness' AS polarity, 100.0 AS impact FROM bf WHERE died AND at_died >= 2 * {DEATH_RATE}),
mo AS (SELECT * FROM ms UNION ALL SELECT * FROM ch UNION ALL SELECT * FROM sc UNION ALL SELECT * FROM ri)"""


@query("review_summary", with_sql(REVIEW_SQL) + f""",
ex AS (SELECT rd.recording, round(sum(p_trade) * any_value(step) + {M.EDGE}, 1) AS expected FROM rd JOIN sp USING (recording) GROUP BY rd.recording)
SELECT recording, ex.expected, trades, round(expected_net + {M.EDGE}, 6) + 0.0 AS expected_net, round(actual_net + {M.EDGE}, 6) + 0.0 AS actual_net,
  CASE WHEN ex.expected >= 3 AND trades < 0.5 * ex.expected THEN 'passive' WHEN trades >= 3 AND trades > 2 * greatest(ex.expected, 0.5) THEN 'aggressive' END AS style FROM sm JOIN ex USING (recording)""")
def review_summary(s: Star) -> DataFrame:
    """Expected against started trades of each recording."""
    return M.summary(*bound(s)).withColumns({c: F.round(F.col(c) + M.EDGE, 6) + 0.0 for c in ("expected_net", "actual_net")})


@query("review_moments", with_sql(MOMENTS_SQL) + "SELECT recording, t, kind, polarity, round(impact, 5) AS impact FROM mo")
def review_moments(s: Star) -> DataFrame:
    """Missed, rare, well-chosen, dangerous and risky moments."""
    return M.review(*bound(s), RARE, COMMON, THREAT, DEATH_RATE).withColumn("impact", F.round("impact", 5))


@query("review_picked", with_sql(MOMENTS_SQL) + """,
so AS (SELECT recording, list([{'t': t, 'kind': kind, 'polarity': polarity, 'impact': impact}] ORDER BY polarity = 'strength', impact DESC, t, kind DESC) AS l FROM (SELECT recording, t, kind, polarity, round(impact, 5) AS impact FROM mo) GROUP BY recording),
pk AS (SELECT recording, unnest(list_reduce(list_prepend([], l), lambda acc, x: CASE WHEN len(list_filter(acc, lambda m: m.polarity = x[1].polarity)) < CASE x[1].polarity WHEN 'weakness' THEN 5 ELSE 2 END
  AND len(list_filter(acc, lambda m: abs(m.t - x[1].t) < 10)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS m FROM so)
SELECT recording, m.t AS t, m.kind AS kind, m.polarity AS polarity, m.impact AS impact FROM pk""")
def review_picked(s: Star) -> DataFrame:
    """The moments shown: the biggest of each recording, none within ten seconds of another."""
    return M.separated(M.review(*bound(s), RARE, COMMON, THREAT, DEATH_RATE).withColumn("impact", F.round("impact", 5)))
