"""A corpus pipeline over the documents table: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.llm.bpe_codec import encode
from peerscope.llm.common import written
from peerscope.llm.decontamination import contamination
from peerscope.llm.line_dedup import drop_lines
from peerscope.llm.minhash_dedup import near_duplicates
from peerscope.llm.quality_classifier import keep_good, train

OTHER = ["lang", "source"]
COLUMNS = ["doc_id", "text", *OTHER, "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; the document stays, and n_chars is that of the text left. A null text stays null."""
    rows = drop_lines(docs, carry=["text", *OTHER, "n_chars"])
    changed = F.col("n_dropped") > 0
    return rows.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("rest.text")).alias("text"), *(f"rest.{c}" for c in OTHER),
                       F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("rest.n_chars")).alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    rows = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["text", *OTHER, "n_chars"])
    return rows.where(~F.col("contaminated")).select("doc_id", "rest.text", *(f"rest.{c}" for c in OTHER), "rest.n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each document and the text they decode to."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("benchmark decontamination", benchmark), ("BPE encoding", tokens)]

#: A trained classifier decides the first stage; the tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
