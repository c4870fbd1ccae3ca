"""Per-second recordings, frame-reading archives and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dimensions import title_columns

RECORDING_SCHEMA = """recording string, kind string, recorded_at double, player_id string, champion string, position string, team string, game_mode string, t double, hp double,
hp_max double, res double, res_max double, gold double, level int, abilities map<string, int>, players array<struct<player_id: string, dead: boolean,
respawn: double, level: int, kills: int, deaths: int, assists: int, creepScore: int, ward_score: double, items: array<int>>>, event string, event_time double"""
READING_SCHEMA = """t double, w int, h int, clock int, panel struct<hp: double, mana: double, xp: double, slots: map<string, double>>,
sides array<array<double>>, camera array<double>"""


def read_recordings(spark, path: str, stream: bool = False) -> DataFrame:
    """Lines of gzip JSON files with their recording: header, samples and events mixed.

    A recording is its file, unless its lines name it: files that hold many recordings need no file for each.
    """
    r = (spark.readStream if stream else spark.read).schema(RECORDING_SCHEMA.replace("\n", " "))
    return r.json(path).withColumn("recording", F.coalesce("recording", F.col("_metadata.file_path")))


def split_recordings(lines: DataFrame, min_samples: int = 60, modes: tuple[str, ...] = ("CLASSIC",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, samples, events) of the recordings worth keeping: the right mode and enough samples."""
    header = lines.where("kind = 'header'").where(F.col("game_mode").isin(*modes))
    enough = lines.where("kind = 'sample'").groupBy("recording").agg(F.count(F.lit(1)).alias("samples")).where(F.col("samples") >= min_samples)
    keep = header.join(enough, "recording")
    ids = keep.select("recording")
    of = lambda k: lines.where(F.col("kind") == k).join(ids, "recording", "left_semi")
    return keep.select("recording", "recorded_at", "player_id", "champion", "position", "team", "samples"), of("sample"), of("event")


def read_readings(spark, path: str) -> DataFrame:
    return spark.read.schema(READING_SCHEMA.replace("\n", " ")).json(path).withColumn("video", F.col("_metadata.file_path"))


def side_slots(readings: DataFrame) -> DataFrame:
    """One row per frame and side slot: health and ultimate readings of the ten portraits."""
    return readings.select("video", "t", F.posexplode("sides").alias("slot", "_v")).select(
        "video", "t", "slot", F.get("_v", F.lit(0)).alias("hp"), F.get("_v", F.lit(1)).alias("ready"))


def list_files(spark, path: str, pattern: str = "*") -> DataFrame:
    """Files with size and content hash, without keeping their content."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select("path", "modificationTime", "length", F.sha2("content", 256).alias("fingerprint"))


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per content: a moved or renamed file is the same file; the first path is kept."""
    return files.groupBy("fingerprint").agg(F.min(F.struct("path", "length")).alias("_f"), F.count(F.lit(1)).alias("copies")).select(
        "fingerprint", "_f.path", "_f.length", "copies")


def with_title(files: DataFrame, path: str = "path") -> DataFrame:
    return files.select("*", *[c.alias(n) for n, c in title_columns(F.col(path)).items()])
