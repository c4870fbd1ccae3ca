"""Rows of equal times and values on a border: a query and its SQL must agree on them too."""

import random

import duckdb
import pandas as pd
import pytest
from check_oracle import canon
from conftest import SF

from __spark_entry__ import oracle_sql, queries
from peerscope.operators import labels as L


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Three events of a user at every time."""
    path = tmp_path_factory.mktemp("tied")
    duckdb.execute(f"""COPY (SELECT event_id + r * 1000000 AS event_id, ts + to_microseconds(r * 1000) AS ts, user_id, event_type, round(value + r * 0.37, 2) AS value,
      '{{"k": ' || (CAST(json_extract_string(props, '$.k') AS BIGINT) + r * 29) % 100 || '}}' AS props FROM '{SF}/events.parquet', range(3) x(r) ORDER BY hash(event_id, r)) TO '{path}/events.parquet'""")
    return str(path)


def events_of(rows, folder):
    """An events table of (event_id, user_id, second, value)."""
    d = pd.DataFrame(rows, columns=["event_id", "user_id", "second", "value"])  # noqa: F841
    duckdb.execute(f"""COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(second) AS ts, user_id, 'click' AS event_type, value, '{{"k": 1}}' AS props FROM d) TO '{folder}/events.parquet'""")


def same(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = queries()[name](spark, folder).toPandas(), con.execute(oracle_sql()[name]).df()
    assert len(got) and canon(got, 6) == canon(want, 6)


@pytest.mark.parametrize("name", ["trade_segments", "trade_consequences", "trade_statistics", "laning_situations", "laning_labels"])
def test_trades_of_tied_readings(spark, tied, name):
    same(spark, tied, name, "events")


def test_change_since_the_first_of_tied_readings(spark, tied):
    same(spark, tied, "laning_features", "events")


def test_first_reading_does_not_hang_on_the_row_order(spark):
    rows = [("v", 0, i, i * 7 % 5) for i in range(8)] + [("v", 1, 8, 100)]
    change = lambda r: {x["id"]: x["me_change_5s"] for x in L.laning_features(spark.createDataFrame(r, "video string, t long, id long, me long").coalesce(1), "video", "t", ["me"], (5,), ["id"]).collect()}
    assert change(rows) == change(rows[::-1]) and change(rows)[8] == 100


def test_expected_trades_on_a_border(spark, tmp_path):
    """Readings a quarter of a second apart whose chances add up to a border of the rounding: 14.55 trades and the like."""
    rng, rows, want = random.Random(5), [], {}
    for u in range(80):
        cents = [rng.randrange(100) for _ in range(rng.randrange(60, 300))]
        while (sum(cents) - 25) % 50:
            cents.append(rng.randrange(100))
        want[u] = (sum(cents) + 25) // 50 / 10
        rows += [(3 * (1 + 3 * (i // 2) + i % 2), u, i, c / 100) for i, c in enumerate(cents)]
    events_of(rows, tmp_path)
    same(spark, str(tmp_path), "review_summary", "events")
    assert {r["recording"]: r["expected"] for r in queries()["review_summary"](spark, str(tmp_path)).collect()} == want


def test_review_of_many_trades(spark, tied):
    same(spark, tied, "review_summary", "events")


def test_value_on_the_border_is_ready(spark, tmp_path):
    """Slots of 24 values whose 90th percentile lies 0.7 of the way from their third largest to the next; one value is exactly 0.6 of it."""
    slots = [(a, a + 30, 6 * (10 * a + 210) // 100) for a in range(100, 4000) if 6 * (10 * a + 210) % 100 == 0]
    slots = [x for x in slots if all(v % 9 for v in x)]
    rows = [(2 * i, u, i, v / 100) for u, (a, b, edge) in enumerate(slots) for i, v in enumerate([edge, *[1] * 19, a, b, b, b])]
    events_of(rows, tmp_path)
    same(spark, str(tmp_path), "slot_readiness", "events")
    edges = [r[0] for r in queries()["slot_readiness"](spark, str(tmp_path)).where("event_id = 0").select("ready").collect()]
    assert len(edges) == len(slots) > 100 and set(edges) == {1}


def test_badge_on_the_border(spark, tmp_path):
    """Players with forty games whose vision is exactly 0.9 a minute."""
    con, rng, lasts, lines = duckdb.connect(), random.Random(4), lambda g: 900 + g * 37 % 1800, []
    for u in range(60):
        games = rng.sample(range(1800), 40)
        while sum(map(lasts, games)) % 200:
            games = rng.sample(range(1800), 40)
        vision = sum(map(lasts, games)) * 3 // 200
        lines += [(g, vision // 40 + (i < vision % 40), u, u) for i, g in enumerate(games)]
    con.execute("CREATE TABLE l (g BIGINT, item BIGINT, supplier BIGINT, slot INT)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?, ?)", lines)
    tables = {"part": "SELECT p AS p_partkey, 'B' AS p_brand, 'T' AS p_type FROM range(50) x(p)", "customer": "SELECT 1::BIGINT AS c_custkey, 'BUILDING' AS c_mktsegment",
              "orders": "SELECT g AS o_orderkey, 1::BIGINT AS o_custkey, TIMESTAMP '1995-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice FROM range(1800) x(g)",
              "lineitem": """SELECT g AS l_orderkey, item AS l_partkey, supplier AS l_suppkey, slot AS l_linenumber, 1.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 0.01::DOUBLE AS l_discount,
                0.01::DOUBLE AS l_tax, 'N' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1995-02-01' AS l_shipdate FROM l"""}
    for n, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{n}.parquet'")
    same(spark, str(tmp_path), "season_badges", *tables)
    assert queries()["season_badges"](spark, str(tmp_path)).where("badge = 'eyes'").count() == 60
