"""States of queued jobs: each function gives the rows as they stand after a step.

jobs has id, status, attempt_count, max_attempts, remote_id, updated_at and last_error. A null id in a step's list matches
nothing; other columns are kept as they are. A job out of attempts is final; `access.claimable` takes the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States in which a job is under way.
IN_FLIGHT = ["submitted", "processing"]


def _changed(jobs: DataFrame, on: Column, values: dict[str, Column], now: Column) -> DataFrame:
    on = F.coalesce(on, F.lit(False))
    return jobs.withColumns({k: F.when(on, v).otherwise(F.col(k)) for k, v in {**values, "updated_at": now}.items()})


def _step(jobs: DataFrame, steps: DataFrame, on: Column, values: dict[str, Column], now: Column) -> DataFrame:
    named = steps.dropna(subset=["id"]).groupBy("id").agg(F.max_by(F.struct(*[c for c in steps.columns if c != "id"], F.lit(True).alias("found")), F.struct(*[c for c in steps.columns if c != "id"])).alias("_step"))
    return _changed(jobs.join(named, "id", "left"), F.col("_step.found") & on, values, now).select(*jobs.columns)


def stale(now: Column, minutes: int) -> Column:
    """A job under way that no remote worker holds and nobody touched for `minutes`."""
    return F.col("status").isin(IN_FLIGHT) & F.col("remote_id").isNull() & (F.col("updated_at") < now - F.make_interval(mins=F.lit(minutes)))


def recovered(jobs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Stale jobs failed, with the attempt they took; a claim decides whether one is left."""
    return _changed(jobs, stale(now, minutes), {"status": F.lit("failed"), "last_error": F.lit(f"abandoned for {minutes} minutes")}, now)


def deferred(jobs: DataFrame, steps: DataFrame, now: Column) -> DataFrame:
    """Jobs named in steps (id, reason) back in the queue, with their attempt given back."""
    return _step(jobs, steps, F.lit(True), {"status": F.lit("pending"), "attempt_count": F.greatest(F.col("attempt_count") - 1, F.lit(0)), "remote_id": F.lit(None), "last_error": F.col("_step.reason").substr(1, 2000)}, now)


def failed(jobs: DataFrame, steps: DataFrame, now: Column) -> DataFrame:
    """Jobs named in steps (id, reason, permanent) failed; a permanent failure spends all attempts."""
    spent = F.when(F.col("_step.permanent"), F.col("max_attempts")).otherwise(F.col("attempt_count"))
    return _step(jobs, steps, F.lit(True), {"status": F.lit("failed"), "attempt_count": spent, "last_error": F.col("_step.reason").substr(1, 2000)}, now)


def cancelled(jobs: DataFrame, steps: DataFrame, now: Column) -> DataFrame:
    """Jobs named in steps (id, reason) stopped for good, unless they are completed."""
    return _step(jobs, steps, F.col("status") != "completed", {"status": F.lit("failed"), "attempt_count": F.col("max_attempts"), "last_error": F.coalesce(F.col("_step.reason").substr(1, 2000), F.lit("cancelled by operator"))}, now)
