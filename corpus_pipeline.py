"""A corpus pipeline over `documents`: toxicity, exact dedup, near dedup, benchmark decontamination, SentencePiece coding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame that is
written as Parquet in the shared folder and read again as the docs of the next one. All but the last return the columns
of documents. The case of nulls, empty texts, ties and repeated rows is that of the operator a stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.decontaminate import decontaminate
from lectern.llm.exact_dedup import keep_first
from lectern.llm.pieces import encode
from lectern.llm.shared import saved
from lectern.llm.simhash import keep_one
from lectern.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels of those with one, scores below the threshold."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the least doc_id."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least doc_id."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, and whether they decode to its text."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("benchmark decontamination", benchmark), ("SentencePiece coding", coding)]
#: SQL has no such network, index or automaton; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
