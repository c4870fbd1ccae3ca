"""Writing derived tables so that repeated and failed runs are harmless."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def load(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Insert rows whose key is not there yet: first writer wins. Duplicates inside ``df`` keep one row."""
    known = load(df.sparkSession, path, df.schema).select(*keys)
    fresh = df.dropDuplicates(list(keys)).join(known, list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def newest(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), F.xxhash64(*rest))).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def upsert_latest(df: DataFrame, path: str, new_path: str, keys: Sequence[str], at: str) -> DataFrame:
    """Old and new rows reduced to the newest per key, written beside the old table."""
    both = load(df.sparkSession, path, df.schema).unionByName(df)
    newest(both, keys, at).write.mode("overwrite").parquet(new_path)
    return df.sparkSession.read.schema(df.schema).parquet(new_path)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def replace_keys(df: DataFrame, path: str, key: str, buckets: int = 64) -> DataFrame:
    """Replace all rows of the given keys: only their hash buckets are rewritten, as dynamic partitions."""
    spark = df.sparkSession
    new = df.withColumn("bucket", bucket_of(key, buckets))
    touched = new.select("bucket").distinct()
    old = load(spark, path, new.schema)
    kept = old.join(touched, "bucket", "left_semi").join(df.select(key).distinct(), key, "left_anti")
    kept.unionByName(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def work_list(source: DataFrame, done: DataFrame, keys: Sequence[str], version: str, current: int) -> DataFrame:
    """Keys with source data but no result of the current version."""
    return source.select(*keys).distinct().join(done.where(F.col(version) == current).select(*keys), list(keys), "left_anti")


def write_by_role(examples: DataFrame, path: str, role: str = "role") -> None:
    """Training tables, one folder per role; rows are spread by match so no role is one task."""
    examples.write.mode("overwrite").partitionBy(role).parquet(path)
