"""Steps that several parts of a query read are worked out once, and files and tasks don't grow with users or games."""

import gzip
import json

from conftest import SF
from pyspark.sql import functions as F

from peerscope.operators import quantiles as Q
from peerscope.operators import statistics as G
from peerscope.plans import documents, noted, ranked, scored
from peerscope.plans.star import Star
from peerscope.sources import recordings as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_many_recordings(spark, folder):
    """lines that name their recording are told apart inside one file; other lines belong to their file."""
    rows = [{"recording": r, "kind": k, "game_mode": "CLASSIC", "t": 1.0} for r, n in (("a", 2), ("b", 1)) for k in ["header"] + ["sample"] * n]
    for name, lines in (("many", rows), ("one", [{"kind": "header", "game_mode": "CLASSIC"}, {"kind": "sample"}, {"kind": "event"}])):
        with gzip.open(f"{folder}/{name}.json.gz", "wt") as f:
            f.write("\n".join(map(json.dumps, lines)))
    head, samples, events = R.split_recordings(R.read_recordings(spark, folder), 1)
    got = {r["recording"].split("/")[-1]: r["samples"] for r in head.collect()}
    assert got == {"a": 2, "b": 1, "one.json.gz": 1} and samples.count() == 4 and events.count() == 1


def test_counted_percentiles(spark):
    """values counted first give what their rows give, above the hot limit too."""
    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(50)] + [("b", 12345.678)] * 30 + [(None, 2.5)], "k string, v double")
    counts = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    show = lambda df: sorted(map(str, df.select("k", "n", *[F.round(x, 6).alias(x) for x in ("mean", "sd", *probs)]).collect()))
    want = show(Q.grouped_quantiles(rows, ["k"], "v", probs))
    assert show(Q.counted_quantiles(counts, ["k"], "v", "c", probs)) == want
    spark.conf.set("spark.peerscope.hotRows", "5")
    try:
        assert show(Q.counted_quantiles(counts, ["k"], "v", "c", probs)) == want
    finally:
        spark.conf.unset("spark.peerscope.hotRows")


def test_findings_are_dealt_by_the_game(spark):
    assert "hashpartitioning(game_id" in plan(scored.evidence_table(Star(spark, SF))) and "REPARTITION_BY_NUM" in plan(scored.evidence_table(Star(spark, SF)))


def test_metrics_are_not_dealt_by_their_name(spark):
    """F35, F40, F44, F45"""
    assert "hashpartitioning(metric#" not in plan(scored.scored(Star(spark, SF)))


def test_notes_and_steps_read_written_rows(spark):
    """F37, F43, F48"""
    for df in (noted.wide(Star(spark, SF)), ranked.next_steps(Star(spark, SF))):
        assert not [f for f in df.inputFiles() if f.startswith(f"file://{SF}/")]


def test_choices_are_counted_once(spark):
    """F47"""
    rows = spark.createDataFrame([("r", "runes", "x", True)] * 3 + [("r", "runes", None, False)], "role string, kind string, key string, win boolean")
    top = G.top_choices(rows, ["role"])
    assert top.inputFiles() and [(r["games"], r["wins"], r["pick_rate"]) for r in top.collect()] == [(3, 3, 75.0)]


def test_timelines_number_lines_inside_the_row(spark):
    """F41, F42, F46"""
    assert "Window" not in plan(documents.timeline_texts(Star(spark, SF)))
