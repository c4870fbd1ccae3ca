"""Line deduplication against levelled sorted runs of line hashes.

A run is a table bucketed and sorted by a 128-bit line hash: how many documents of a batch hold the
line, and the largest of them. Batches come in descending order of document id. Each batch is
merge-anti-joined with the runs there are: a line found in none is new, and its largest holder is in
this batch; of the others only the count is new. Then the batch's own run is added, and a level that is
full is compacted into one run of the next level. Runs have equal buckets, so joining and compacting
them shuffles only the new batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ASCII_SPACE, arrow_schema, bucketed, partitions, slices, small_batches, texts_of, written

BATCHES = 4
FANOUT = 2
HOT_LINES = 20_000
HASH = ["h1", "h2"]


def line_key(line: str) -> str:
    return line.strip(ASCII_SPACE)


def line_hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode().lower())  # bytes.lower() touches A-Z alone


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """A row (doc, h1, h2) for each different long line of a text."""
    small_batches(docs.sparkSession)
    schema = "doc bigint, h1 bigint, h2 bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                owner, found = [], []
                for doc, text in zip(part.column(0).to_pylist(), texts_of(part), strict=True):
                    keys = {line_hash(k) for k in map(line_key, text.split("\n")) if len(k) >= min_chars}
                    found += keys
                    owner += [doc] * len(keys)
                pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], schema=arrow)

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class LineRuns:
    """The levels: ``levels[i]`` has up to ``fanout`` runs, each of about fanout**i batches."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.buckets = buckets or partitions(spark)
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _store(self, rows: DataFrame) -> DataFrame:
        return bucketed(rows.repartition(self.buckets, *HASH), HASH, self.buckets, "line_run")

    def new(self, lines: DataFrame) -> DataFrame:
        """Lines (h1, h2 and further columns) that no run has."""
        for run in self.runs():
            lines = lines.join(run.select(*HASH), HASH, "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc, h1, h2): a line in a document counts once."""
        own = written(lines.distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last")), "line-batch")
        new = self.new(own)
        if self.runs():
            marked = own.join(new.select(*HASH, F.lit(True).alias("is_new")), HASH, "left")
            own = marked.select(*HASH, "docs", F.when(F.col("is_new"), F.col("last")).alias("last"))
        self._put(self._store(own), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) > self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._store(self._merged(full)), level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One row for each line of any run: a merge join of the sorted runs, bucket by bucket."""
        rows = runs[0]
        for r in runs[1:]:
            other = r.select(*HASH, F.col("docs").alias("docs_r"), F.col("last").alias("last_r"))
            rows = rows.join(other, HASH, "full_outer").select(
                *HASH, (F.coalesce("docs", F.lit(0)) + F.coalesce("docs_r", F.lit(0))).alias("docs"), F.greatest("last", "last_r").alias("last"))
        return rows

    def totals(self) -> DataFrame:
        """All runs as one: docs and last of every line."""
        return self._merged(self.runs())


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES,
               id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Lines of at least ``min_chars`` in at least ``min_docs`` documents go, except in the largest id holding them.

    Returns id, n_lines (before), n_dropped and kept (the other lines, joined again), a row for each
    input row; the columns named in ``carry`` follow in a struct ``rest``. A null or empty text is one empty line. Rows with one id are one document: they count
    once, and what is decided for the id holds in each. Null ids are one document that is smaller than
    all others. Text that is a single very long line is one line. Lines are compared by 128-bit hashes
    of their stripped, A-Z lower-cased text. An empty table gives an empty result.

    A line in very many documents meets its decision by a broadcast: lines in more than
    1 / ``HOT_LINES`` of all (document, line) rows, of which there can't be more than ``HOT_LINES``.
    All others are joined by hash.
    """
    spark = docs.sparkSession
    low = docs.agg(F.min(id_col), F.max(id_col)).first()
    edges = [] if low[0] is None else sorted(set(map(int, docs.select(F.col(id_col).cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.01))))
    batch = F.lit(0)
    for e in edges:  # null compares as null: batch 0, the last one
        batch = batch + F.coalesce((F.col("doc") >= e).cast("int"), F.lit(0))
    lines = written(line_hashes(docs, min_chars, id_col, text_col).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(spark)
    for b in range(len(edges), -1, -1):
        runs.add(lines.where(F.col("batch") == b).drop("batch"))
    total = runs.totals()
    repeated = written(total.where(F.col("docs") >= min_docs), "repeated-lines")
    rows = repeated.agg(F.sum("docs")).first()[0] or 0
    hot = F.col("docs") > rows // HOT_LINES
    keys = lines.select("doc", *HASH)
    gone = ~F.col("doc").eqNullSafe(F.col("last"))
    common = repeated.where(hot).select(*HASH, "last")
    rest = repeated.where(~hot).select(*HASH, "last")
    drops = (keys.join(F.broadcast(common), HASH).where(gone).unionByName(keys.join(rest, HASH).where(gone))
             .groupBy("doc").agg(F.collect_set(F.struct(*HASH)).alias("drops")))  # no more than a document's lines

    kind = docs.schema[id_col].dataType.simpleString()
    rest = F.struct(*carry).alias("rest") if carry else F.lit(0).alias("rest")
    schema = T._parse_datatype_string(f"`{id_col}` {kind}, n_lines bigint, n_dropped bigint, kept string").add(docs.select(rest).schema["rest"])
    arrow = to_arrow_schema(schema)

    def run(parts):
        for batch in parts:
            for part in slices(batch):
                out = []
                for text, drops in zip(texts_of(part), part.column(2).to_pylist(), strict=True):
                    all_lines = text.split("\n")
                    if not drops:
                        out.append((len(all_lines), 0, text))
                        continue
                    bad = {np.array([d["h1"], d["h2"]], "<i8").tobytes() for d in drops}
                    kept = [x for x in all_lines if len(k := line_key(x)) < min_chars or line_hash(k) not in bad]
                    out.append((len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, arrow.field(3).type), part.column(3)], schema=arrow)

    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest)
    out = (left.join(drops, F.col("id").cast("bigint").eqNullSafe(F.col("doc")), "left")
           .select("id", "text", "drops", "rest").mapInArrow(run, schema))
    return out if carry else out.drop("rest")
