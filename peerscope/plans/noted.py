"""Notes, grounding, answer quality, logs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as N
from ..operators import statistics as G
from ..operators import winprob as W
from ..operators.scale import dimension, written
from .chance import events as play_events
from .chance import shares
from .grouped import RATES_SQL, bench_table
from .registry import query
from .star import LINES_SQL, Star, with_sql


# The columns of the builds that notes and rates read.
NOTED = ("match_id", "team", "role", "tier", "win", "kills", "deaths", "assists", "cs", "damage", "vision", "duration_s", "team_kills", "cs_diff", "gold_diff")


def wide(s: Star) -> DataFrame:
    """Builds with everything the note rules read; leads come from the seat's own opponent."""
    # Worked out once: the totals, the counts of their groups and the percentiles all read the written rows.
    rates = written(G.rates(s.builds().select(*NOTED)), "rates")
    b = N.wide_rows(rates)
    t = bench_table(s, rates).where("metric IN ('cs_min', 'vision_min', 'dmg_min', 'deaths_10')")
    p = t.groupBy(F.col("tier").alias("_t"), F.col("role").alias("_r")).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(q))).alias(f"{m}_{q}") for m in ("cs_min", "vision_min", "dmg_min", "deaths_10") for q in ("p20", "p50", "p80")])
    p = dimension(p)
    w = b.join(p, (F.col("tier") == F.col("_t")) & (F.col("role") == F.col("_r")), "left").drop("_t", "_r")
    return w.select("*", (F.col("cs") - F.col("cs_diff")).alias("opp_cs"), (F.col("gold_diff") / 10).alias("lane_gold"), F.col("gold_diff").alias("team_lead"),
                    (F.col("role") == 1).alias("is_top"), (F.col("role") == 5).alias("is_support"), (F.col("role") == 2).alias("first_blood"),
                    (F.col("vision") % 5).alias("largest_multikill"))


NOTES_SQL = RATES_SQL + """,
pv AS (SELECT tier AS t, role AS r, """ + ", ".join(f"max({q}) FILTER (WHERE metric = '{m}') AS {m}_{q}" for m in ("cs_min", "vision_min", "dmg_min", "deaths_10") for q in ("p20", "p50", "p80")) + """ FROM bench GROUP BY ALL),
w AS (SELECT x.*, pv.*, max(damage) OVER (PARTITION BY match_id) AS match_damage, max(vision) OVER (PARTITION BY match_id) AS match_vision, sum(damage) OVER (PARTITION BY match_id, team) AS team_damage, gold_diff / 10 AS lane_gold,
  greatest(1.0, duration_s / 60) AS mins FROM rates x LEFT JOIN pv ON pv.t = x.tier AND pv.r = x.role),
nt AS (SELECT match_id, role, team, note FROM (SELECT match_id, role, team, unnest([
  CASE WHEN damage >= match_damage THEN 'most_damage' END, CASE WHEN damage < match_damage AND damage / greatest(team_damage, 1) >= 0.3 THEN 'damage_share' END,
  CASE WHEN team_kills >= 10 AND kp >= 0.68 THEN 'kp_high' END, CASE WHEN team_kills >= 10 AND kp < 0.35 AND role <> 1 THEN 'kp_low' END,
  CASE WHEN vision >= match_vision AND vision >= mins THEN 'vision_most' END, CASE WHEN deaths = 0 AND mins >= 15 THEN 'deathless' END, CASE WHEN role = 2 THEN 'first_blood' END, CASE WHEN vision % 5 >= 3 THEN 'multikill' END,
  CASE WHEN win AND gold_diff <= -2500 THEN 'comeback' END, CASE WHEN NOT win AND gold_diff >= 2500 THEN 'throw' END, CASE WHEN role <> 5 AND cs_diff >= 30 THEN 'cs_up' END, CASE WHEN role <> 5 AND cs_diff <= -30 THEN 'cs_down' END,
  CASE WHEN lane_gold >= 800 THEN 'gold_up' END, CASE WHEN lane_gold <= -800 THEN 'gold_down' END,
  CASE WHEN mins >= 15 AND role <> 5 AND cs_min_p80 > cs_min_p50 AND cs_min >= cs_min_p80 THEN 'farm_high' END, CASE WHEN mins >= 15 AND role <> 5 AND cs_min_p50 > cs_min_p20 AND cs_min <= cs_min_p20 THEN 'farm_low' END,
  CASE WHEN mins >= 15 AND vision_min_p80 > vision_min_p50 AND vision_min >= vision_min_p80 THEN 'vision_high' END, CASE WHEN mins >= 15 AND vision_min_p50 > vision_min_p20 AND vision_min <= vision_min_p20 THEN 'vision_low' END,
  CASE WHEN mins >= 15 AND role <> 5 AND dmg_min_p80 > dmg_min_p50 AND dmg_min >= dmg_min_p80 THEN 'damage_high' END, CASE WHEN mins >= 15 AND role <> 5 AND dmg_min_p50 > dmg_min_p20 AND dmg_min <= dmg_min_p20 THEN 'damage_low' END,
  CASE WHEN deaths >= 6 AND deaths_10 >= deaths_10_p80 AND deaths_10_p80 > deaths_10_p50 THEN 'deaths_high' END]) AS note FROM w) WHERE note IS NOT NULL)"""


@query("note_counts", with_sql(NOTES_SQL) + "SELECT note, count(*) AS n FROM nt GROUP BY note")
def note_counts(s: Star) -> DataFrame:
    notes = N.all_notes(wide(s), ["match_id", "role", "team"], N.note_rules())
    return notes.groupBy("note").agg(F.count(F.lit(1)).alias("n"))


@query("match_notes")
def match_notes(s: Star) -> DataFrame:
    n = N.match_notes(wide(s), ["match_id", "role", "team"], N.note_rules())
    return n.withColumn("weight", F.round("weight", 5))


CLAIMS_SQL = """
u AS (SELECT conv_id, turn, role, text || ' ' || CAST(length(text) % 40 AS VARCHAR) || '.' || CAST(turn % 3 AS VARCHAR) AS text FROM conversations),
x AS (SELECT *, unnest(regexp_extract_all(' ' || regexp_replace(text, '(?i)\\bE\\d+\\b|\\b\\d+v\\d+\\b', ' ', 'g'), '(?:^|[^\\w.])(\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)', 1)) AS raw FROM u),
n AS (SELECT *, CAST(replace(raw, ',', '') AS DOUBLE) AS value, CASE WHEN contains(raw, '.') THEN least(4, length(split_part(raw, '.', 2))) ELSE 0 END AS decimals FROM x),
said AS (SELECT * FROM n WHERE role = 'assistant'), known AS (SELECT * FROM n WHERE role <> 'assistant')"""


def spoken(s: Star) -> DataFrame:
    """Turns with a number added that their length and place give, so that some claims have support and some do not."""
    t = s.table("conversations")
    extra = F.concat(F.lit(" "), (F.length("text") % 40).cast("string"), F.lit("."), (F.col("turn") % 3).cast("string"))
    return t.select("conv_id", "turn", "role", F.concat("text", extra).alias("text"))


@query("grounding_violations", with_sql(CLAIMS_SQL) + """
SELECT conv_id, turn, raw FROM said s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.conv_id = s.conv_id AND round(k.value * 10 ** s.decimals, 0) = round(s.value * 10 ** s.decimals, 0))""")
def grounding_violations(s: Star) -> DataFrame:
    t = spoken(s)
    claims, evidence = t.where("role = 'assistant'"), t.where("role <> 'assistant'")
    return N.unsupported_numbers(claims, evidence, "turn", "conv_id", "text").select("conv_id", "turn", "raw")


@query("grounded_claims", with_sql(CLAIMS_SQL) + """
SELECT conv_id, turn FROM conversations c WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM said s WHERE s.conv_id = c.conv_id AND s.turn = c.turn AND
  NOT EXISTS (SELECT 1 FROM known k WHERE k.conv_id = s.conv_id AND round(k.value * 10 ** s.decimals, 0) = round(s.value * 10 ** s.decimals, 0)))""")
def grounded_claims(s: Star) -> DataFrame:
    t = spoken(s)
    claims = t.where("role = 'assistant'")
    bad = N.unsupported_numbers(claims, t.where("role <> 'assistant'"), "turn", "conv_id", "text")
    return N.grounded_claims(claims, bad, keys=["conv_id", "turn"]).select("conv_id", "turn")


def answers(s: Star) -> tuple[DataFrame, DataFrame]:
    """Lines as evidence; every third line of an order is also a point that cites the two lines next to it."""
    l = s.lines()
    e = l.groupBy("game_id", "slot").agg(F.min("champion").alias("c"), F.min("class").alias("area"), F.max("quantity").alias("severity"), F.min("flag").alias("f"))
    kind = F.when(F.col("slot") == 7, "context").otherwise("metric")
    polarity = F.when(F.col("f") == "R", "weakness").when(F.col("f") == "A", "strength").otherwise("neutral")
    evidence = e.select("game_id", F.concat(F.lit("E"), "slot").alias("evidence_id"), kind.alias("kind"), "area", polarity.alias("polarity"), "severity")
    points = e.where("slot % 2 = 1").select("game_id", F.col("slot").alias("point"), polarity.alias("kind"), F.col("area"),
                                            F.concat(F.lit("play more "), F.col("severity").cast("string")).alias("advice"),
                                            F.array(F.concat(F.lit("E"), "slot"), F.concat(F.lit("E"), (F.col("slot") + 1).cast("string")), F.concat(F.lit("E"), (F.col("slot") + 2).cast("string"))).alias("cites"))
    return points, evidence


QUALITY_SQL = LINES_SQL + """,
e0 AS (SELECT game_id, slot, min(class) AS area, max(quantity) AS severity, min(flag) AS f FROM lines GROUP BY ALL),
e AS (SELECT *, CASE WHEN slot = 7 THEN 'context' ELSE 'metric' END AS kind, CASE f WHEN 'R' THEN 'weakness' WHEN 'A' THEN 'strength' ELSE 'neutral' END AS polarity FROM e0),
pt AS (SELECT game_id, slot AS point, polarity AS pk, area AS pa FROM e WHERE slot % 2 = 1),
ct AS (SELECT p.*, e.slot AS eid, e.kind, e.area, e.polarity FROM pt p LEFT JOIN e ON e.game_id = p.game_id AND e.slot BETWEEN p.point AND p.point + 2 AND e.kind <> 'context'),
fi AS (SELECT game_id, eid, min(point) AS fp FROM ct WHERE eid IS NOT NULL GROUP BY ALL),
pp AS (SELECT ct.game_id, point, count(ct.eid) AS re, count(*) FILTER (WHERE polarity <> 'neutral') AS pol, count(*) FILTER (WHERE polarity <> 'neutral' AND polarity = pk) AS same, count(*) FILTER (WHERE area = pa) AS sa, count(*) FILTER (WHERE fp < point) AS used
  FROM ct LEFT JOIN fi ON fi.game_id = ct.game_id AND fi.eid = ct.eid GROUP BY ALL),
wk AS (SELECT game_id, slot FROM e WHERE polarity = 'weakness' QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY severity DESC, slot) <= 3),
ad AS (SELECT w.game_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM pt p WHERE p.game_id = w.game_id AND w.slot BETWEEN p.point AND p.point + 2)) / count(*) AS addr FROM wk w GROUP BY 1)
SELECT pp.game_id, count(*) AS points, count(*) FILTER (WHERE pol > 0 AND same = 0) AS kind_mismatches, count(*) FILTER (WHERE re > 0 AND sa = 0) AS area_mismatches, count(*) AS advice_with_numbers,
  count(*) FILTER (WHERE re = 0) AS context_only, count(*) FILTER (WHERE re > 0 AND used = re) AS shared_evidence, coalesce(any_value(addr), 1.0) AS top_weaknesses_addressed FROM pp LEFT JOIN ad USING (game_id) GROUP BY pp.game_id"""


@query("answer_quality", "WITH " + QUALITY_SQL.strip())
def answer_quality(s: Star) -> DataFrame:
    points, evidence = answers(s)
    return N.answer_quality(points, evidence, "game_id", "point")


@query("citation_problems", with_sql(LINES_SQL) + """,
e AS (SELECT DISTINCT game_id, slot FROM lines), c AS (SELECT game_id, slot AS point, unnest([slot, slot + 1, slot + 2]) AS c FROM e WHERE slot % 2 = 1)
SELECT game_id, point, 'cites unknown evidence E' || c AS problem FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.game_id = c.game_id AND e.slot = c.c)""")
def citation_problems(s: Star) -> DataFrame:
    points, evidence = answers(s)
    return N.citation_problems(points, evidence, "point", "game_id", "cites", "evidence_id")


@query("readable_log", with_sql(LINES_SQL) + """,
e AS (SELECT game_id, flag, team, item, supplier, CAST((slot - 1) * 60000 + price % 60000 AS BIGINT) AS t, row_number() OVER (PARTITION BY game_id ORDER BY (slot - 1) * 60000 + price % 60000, item, supplier, price, quantity) AS seq FROM lines)
SELECT game_id AS match_id, seq, CAST(t // 60000 AS VARCHAR) || ':' || lpad(CAST(t // 1000 % 60 AS VARCHAR), 2, '0') AS clock, CASE flag
  WHEN 'R' THEN 'P' || (item % 5 + 1 + CASE team WHEN 'F' THEN 0 ELSE 5 END) || ' killed ' || (supplier % 5 + 1 + CASE team WHEN 'F' THEN 5 ELSE 0 END)
  WHEN 'A' THEN CASE team WHEN 'F' THEN 'Blue' ELSE 'Red' END || ' destroyed a tower' ELSE CASE team WHEN 'F' THEN 'Blue' ELSE 'Red' END || ' took Dragon' END AS text FROM e""")
def readable_log(s: Star) -> DataFrame:
    return N.readable_log(play_events(s), F.concat(F.lit("P"), F.col("actor").cast("string")))


@query("credit_summary")
def credit_summary(s: Star) -> DataFrame:
    c = N.credit_summary(W.credit(shares(s)).select("match_id", "player", "total"))
    return c.select("match_id", "player", "rank", F.round("total", 6).alias("total"), F.round("opponent_total", 6).alias("opponent_total"))
