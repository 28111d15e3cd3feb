"""Readers and writers: tables, transcripts with time headers, recognised speech, and chunks replaced by video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seconds

HEADER = r"=====\s*(.*?)\s*\|\s*([0-9:]{8})\s*-->\s*([0-9:]{8})\s*====="


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """path, block, name, start_ts, end_ts, text of text files whose blocks begin with a header of a name and two times."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    heads = [F.regexp_extract_all("value", F.lit(HEADER), i) for i in (1, 2, 3)]
    bodies = F.slice(F.split("value", HEADER), 2, 1 << 30)
    rows = files.select("path", F.posexplode(F.arrays_zip(heads[0].alias("name"), heads[1].alias("a"), heads[2].alias("b"), bodies.alias("text"))).alias("block", "x"))
    return rows.select("path", "block", "x.name", seconds(F.col("x.a")).alias("start_ts"), seconds(F.col("x.b")).alias("end_ts"), F.trim(F.regexp_replace("x.text", r"\s+", " ")).alias("text"))


def speech(raw: DataFrame) -> DataFrame:
    """video_id, start, end, text and bad from JSON lists of blocks (column json): an end is past its start; what can't be
    read stays as one bad row."""
    parsed = raw.withColumn("_b", F.from_json("json", "array<struct<start:double,end:double,text:string>>"))
    rows = parsed.select("video_id", F.explode_outer("_b").alias("b"))
    ok = F.col("b.start").isNotNull() & F.col("b.text").isNotNull()
    return rows.select("video_id", F.floor("b.start").alias("start"), F.greatest(F.floor("b.end"), F.floor("b.start") + 1).alias("end"), "b.text", (~ok).alias("bad"))


def replace_chunks(chunks: DataFrame, path: str) -> None:
    """Writes chunks in place of those stored of their videos; other videos stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)


def save_report(rows: DataFrame, path: str) -> None:
    """As JSON, and as CSV with nested columns in JSON."""
    rows.write.mode("overwrite").json(f"{path}/json")
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
