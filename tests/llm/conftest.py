import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and further columns whose names clash."""
    from pyspark.sql import functions as F

    words = " ".join(f"w{i} x{i % 7}" for i in range(300))
    line = "this line is long enough to be counted as a repeated one"
    rows = [(1, None), (2, ""), (3, "one"), (4, "one two three"), (5, words), (6, words), (6, words), (7, words + " tail"), (None, words), (None, None), (8, " \n\t \n"),
            (9, "a " * 500), (10, "x" * 5000), (11, "ab" * 2000 + " end"), (12, "é" * 60 + " ü"), (13, "日本 " * 40), (14, "Mixed CASE words Go here and There")]
    rows += [(20 + i, f"head {i}\n  {line.upper()}\t\n{line}\nend {i} {words[:200 + i]}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({n: F.lit(7) for n in ("id", "n", "doc", "kept", "score", "label", "n_words", "items", "slice", "shard", "u", "v")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def rows_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def plain():
    """(doc_id, text) of the rows with an id, for the plain versions."""
    return lambda df: [r for r in rows_of(df) if r[0] is not None]
