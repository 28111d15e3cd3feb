"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where documents are ordered: after all others.
LAST = (1 << 63) - 1


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master (as in tests) gets a temporary folder; a cluster is refused,
    as its executors would each write a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _root(spark: SparkSession) -> str:
    return f"{folder(spark).rstrip('/')}/lectern/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written in the shared folder: cuts the lineage and outlives lost executors.
    The tables of an application lie in one folder, which `release` removes."""
    path = f"{_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes every table that `saved` wrote in this application; call it when the results have been used."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: few rows at a time, unless the session already says otherwise."""
    for key, usual, small in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(4 << 20))):
        if spark.conf.get(key, usual) in (usual, "67108864b", "64MB"):
            spark.conf.set(key, small)


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (bigint), ord (doc_id, null last), text (null: empty) and row_key, which equal rows share."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("ord"), text.alias("text"), row_key(doc_id, text).alias("row_key"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
