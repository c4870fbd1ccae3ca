"""Measure first, then choose the plan: hot keys, checked broadcasts and written intermediates.

Ordered windows, exact percentiles and "total of the group beside each row" all put one key's rows
into one task. That is the right plan until one key holds a large share of the table. ``hot_keys``
counts rows per key (map-side combined, only the key and order columns are read) and the callers
switch to a plan that splits those keys. With no hot key the plain Spark operator is used unchanged.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS_SETTING = "spark.peerscope.hotRows"
HOT_ROWS = 8_000_000
BROADCAST_ROWS_SETTING = "spark.peerscope.broadcastRows"
BROADCAST_ROWS = 500_000
MAX_CHUNKS = 20_000
SAFE_BYTES_PER_ROW = 4
MOST_ROWS = "peerscope.mostRows"  # metadata of a key column: no key has more rows in the table it comes from
ROWS_PER_BUCKET = 256


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


def hot_rows(df: DataFrame) -> int:
    return setting(df.sparkSession, HOT_ROWS_SETTING, HOT_ROWS)


_TEMPORARY: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one that ``spark.checkpoint.dir`` names.

    A session on one machine that names none gets a temporary folder; on a cluster that is an error,
    because executors don't share the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _TEMPORARY.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/{app}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; call it when its results are saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so a lost executor does not redo the work, fixes values that are read twice, and
    gives the optimizer the true size of the result for its join choices.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/peerscope/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dimension(df: DataFrame) -> DataFrame:
    """A derived table that is joined to facts: written once, broadcast only if it is counted small.

    Beyond the bound the plain join is left to the optimizer, which splits skewed partitions.
    """
    stored = written(df, "dimension")
    limit = setting(df.sparkSession, BROADCAST_ROWS_SETTING, BROADCAST_ROWS)
    if stored.count() <= limit:
        return F.broadcast(stored)
    return stored


def grown(df: DataFrame) -> DataFrame:
    """One side of a join on a match: shuffled and merged, never broadcast.

    Its rows grow with the matches, and the sizes that Spark chooses by are those of compressed files: a written
    state of a hundred columns, most of them zero, looks small and would be built and held in the driver.
    """
    return df.hint("merge")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables a plan reads: known file sizes, and "huge" for anything unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than the allowed rows: ``table`` holds the key, lowest order value and chunk width."""

    table: DataFrame
    keys: tuple[str, ...]
    count: int


def order_number(df: DataFrame, name: str) -> Column:
    """An order column as a number, keeping its order."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.encode(F.col(name), "UTF-8")), 12, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def most_rows(df: DataFrame, key: str) -> int | None:
    """At least the rows of the largest key of a table: rows are counted by hashes of the key, some hundred rows a hash.

    None for tables too small for anything derived from them to be counted.
    """
    if input_bytes(df) < hot_rows(df) // 8:
        return None
    buckets = max(1024, df.count() // ROWS_PER_BUCKET)
    counts = df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def bounded(key: Column, name: str, most: int | None) -> Column:
    """``key`` as ``name``, carrying the count of ``most_rows`` through all that is made of it."""
    return key.alias(name) if most is None else key.alias(name, metadata={MOST_ROWS: most})


def _known_small(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """Whether a key's rows were counted where it comes from, and even all their pairs stay below the limit."""
    counted = [f.metadata[MOST_ROWS] for f in df.schema.fields if f.name in keys and MOST_ROWS in f.metadata]
    return bool(counted) and min(counted) ** 2 <= limit


def hot_keys(df: DataFrame, keys: Sequence[str], order: str | None = None,
             limit: int | None = None) -> HotKeys | None:
    """The keys holding more than ``limit`` rows, or None when there are none.

    There are at most rows / limit of them, so the list is bounded whatever the table's size. Plans that
    read fewer bytes than one task may hold are not counted: they have nothing to split. Nor are those with a
    key whose rows were counted in the table it comes from (``bounded``): counting a plan works all of it out.
    """
    limit = limit or hot_rows(df)
    keys = list(keys)
    if _known_small(df, keys, limit) or input_bytes(df) < limit * SAFE_BYTES_PER_ROW:
        return None
    value = order_number(df, order) if order else F.lit(0.0)
    counted = (
        df.select(*keys, value.alias("_o")).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))
        .where(F.col("_n") > limit)
    )
    rows = counted.collect()
    if not rows:
        return None
    spark = df.sparkSession
    chunks = F.least(F.lit(float(MAX_CHUNKS)), F.ceil(F.col("_n") / F.lit(limit)).cast("double"))
    table = (
        spark.createDataFrame(rows, counted.schema)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys],
                F.coalesce("_lo", F.lit(0.0)).alias("_hot_from"),
                F.greatest((F.coalesce("_hi", F.lit(0.0)) - F.coalesce("_lo", F.lit(0.0))) / chunks,
                           F.lit(1e-9)).alias("_hot_width"))
    )
    return HotKeys(table, tuple(keys), len(rows))


def mark_hot(df: DataFrame, hot: HotKeys, order: str | None, name: str = "_chunk") -> DataFrame:
    """Add the chunk of each row: 0 for ordinary keys, a range of the order column for hot ones.

    The chunk only ever grows along the order, so chunks of a key can be put together again from one
    summary row each.
    """
    on = None
    for k in hot.keys:
        part = df[k].eqNullSafe(hot.table[f"_hot_{k}"])
        on = part if on is None else on & part
    value = order_number(df, order) if order else F.lit(0.0)
    joined = df.join(F.broadcast(hot.table), on, "left")
    start, width = F.col("_hot_from"), F.col("_hot_width")
    chunk = F.coalesce(F.floor((F.coalesce(value, start) - start) / width).cast("long"), F.lit(0).cast("long"))
    return joined.withColumn(name, chunk).withColumn("_is_hot", width.isNotNull()).drop(
        "_hot_from", "_hot_width", *[f"_hot_{k}" for k in hot.keys])


def beside(df: DataFrame, keys: Sequence[str], totals: dict[str, Column],
           hot_limit: int | None = None) -> DataFrame:
    """Each row with totals of its group: a window, or aggregate-and-join when a group is hot.

    ``totals`` maps new names to aggregate columns such as ``F.sum("gold")``. The aggregate side
    combines before it shuffles and the join back is one the optimizer can split.
    """
    from pyspark.sql import Window

    keys = list(keys)
    if hot_keys(df, keys, None, hot_limit) is None:
        w = Window.partitionBy(*keys)
        return df.select("*", *[c.over(w).alias(n) for n, c in totals.items()])
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    renamed = dimension(agg.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *totals))
    on = None
    for k in keys:
        part = df[k].eqNullSafe(renamed[f"_g_{k}"])
        on = part if on is None else on & part
    return df.join(renamed, on, "inner").drop(*[f"_g_{k}" for k in keys])
