"""Structured Streaming: ingest without repeats, sessions kept up to date, triggers, quotas and a rate limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.access import completed_all, insert_absent
from .limits import limited


def deduplicated(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """events (created_at, student_id, client_event_id) without repeats of a client's id; events without one all stay."""
    marked = events.withColumn("_id", F.coalesce("client_event_id", F.concat(F.lit("\0"), F.expr("uuid()"))))
    return marked.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["student_id", "_id"]).drop("_id")


def session_state(events: DataFrame) -> DataFrame:
    """First, last and end of each study session, for output mode update."""
    closing = F.when(F.col("event_type").isin("complete", "tab_hidden"), F.col("created_at"))
    return events.groupBy("student_id", "session_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("last_event_at"), F.max(closing).alias("ended_at"))


def module_reports(completed: Callable[[], DataFrame], lectures: DataFrame, stored: Callable[[], DataFrame], store: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a report is stored once for each (student, course) touched by a batch whose lectures are all done."""

    def on_batch(batch: DataFrame, _: int) -> None:
        touched = batch.filter("event_type = 'complete'").join(lectures, "resource_id").select("student_id", "course_id").distinct()
        done = completed().join(touched, ["student_id", "course_id"], "left_semi")
        store(insert_absent(completed_all(done, lectures, ["student_id"], ["course_id"], "resource_id"), stored(), ["student_id", "course_id"]))

    return on_batch


def rate_limited(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """hits (key, at, id) that a sliding log lets through: `limits.limited` without the rejected ones."""
    return limited(hits, limit, window).filter("accepted").select("key", "at", "id")
