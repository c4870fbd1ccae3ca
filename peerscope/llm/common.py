"""Shared helpers: bounded Arrow slices of texts, written intermediates and byte spans.

Every operator reads only the columns it names, so further columns (whatever they are called) never
clash. Texts travel to Python in Arrow batches; ``slices`` cuts a batch into pieces of a few MB so that
a task's memory depends on its longest text and not on the batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20
RECORDS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
RECORDS = 1000
_TEMPORARY: dict[str, str] = {}

ASCII_SPACE = " \t\n\v\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in a session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _TEMPORARY.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: str | None = None, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: later stages don't redo the work if an executor is lost."""
    path = new_path(df.sparkSession, label)
    writer = df.write.options(compression="zstd", **options)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows for each Arrow batch, as a row can be a whole text."""
    now = int(spark.conf.get(RECORDS_SETTING, None) or 10_000)
    if now <= 0 or now > RECORDS:
        spark.conf.set(RECORDS_SETTING, str(RECORDS))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``limit`` bytes of text each (a longer text stands alone)."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, an empty one for null."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def each_text(docs: DataFrame, fields: list[tuple[str, str]], work: Callable[[list[str]], list],
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, then the fields that ``work(texts)`` returns as lists."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} {t}" for n, t in fields)])
    types = [f.type for f in _arrow_schema(schema)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = work(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(types[0]), *(pa.array(x, t) for x, t in zip(out, types[1:], strict=True))],
                    names=[id_col, *(n for n, _ in fields)])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def arrow_schema(ddl: str) -> pa.Schema:
    return _arrow_schema(ddl)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs covered by half-open spans; touching spans become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, starts[1:] > reach[:-1]]
    last = np.r_[first[1:], True]
    return starts[first], reach[last]


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (as bytes), remembered up to a bound."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by integer ``keys``: tables of whole runs of equal keys, and the runs' edges.

    A run may lie across batches; at most one run is held back for the next batch.
    """
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows, bool)
        change[0] = True
        for k in keys:
            x = rows[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and all(held[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in keys):
            continue  # still the same run
        rows = pa.Table.from_batches(held)
        starts = cut(rows)
        last = int(starts[-1])
        if last:
            yield rows.slice(0, last), starts
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, np.r_[cut(rows), rows.num_rows]


def bucketed(rows: DataFrame, keys: list[str], buckets: int, label: str, sort: bool = True) -> DataFrame:
    """``rows`` as a table in the shared folder, bucketed (and sorted) by ``keys``; joins on them don't shuffle it.

    The files are in the shared folder; the catalog's entry is only needed while the table is resolved.
    """
    spark = rows.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    writer = rows.write.option("path", new_path(spark, label)).option("compression", "zstd").bucketBy(buckets, *keys)
    (writer.sortBy(*keys) if sort else writer).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolves the table  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", None) or 200)
