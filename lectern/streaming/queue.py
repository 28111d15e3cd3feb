"""A queue of jobs with one writer: a stream of reports and of new jobs, settled in order, a version of the table a batch.

Every batch takes the last version before it and gives the next: first what the remote workers report is settled, then
jobs that nobody holds are recovered, then new jobs come in and the oldest are claimed; so a job that has finished is
never taken for abandoned. The version is named by the batch and is there only once it is whole, so a batch that runs again
after a failure begins from the same version, and one that runs again after it was done changes nothing. A claim names its
job and attempt, by which the remote side knows a claim that is sent twice.

Messages have kind, id (of the job), and what the kind needs:
 enqueue   guid, max_attempts         a job unless its guid has one
 accepted  remote_id                  the remote worker has taken a claimed job
 refused   reason, permanent          or has not
 status    state, reason, chunks      what a poll of the remote job said
 defer     reason                     back to the queue, the attempt given back
 cancel    reason                     stopped for good
Of several statuses of a job in a batch the last (by at, unknown instants first) counts. Unknown kinds and ids change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as states
from ..operators.access import claimable

# States of remote jobs, and what a media refusal says.
PENDING, RUNNING, DONE, FAILED = ["IN_QUEUE", "IN_PROGRESS"], "IN_PROGRESS", "COMPLETED", ["FAILED", "CANCELLED", "TIMED_OUT"]
UNAVAILABLE = "UNAVAILABLE"
JOBS = "id bigint, guid string, status string, attempt_count int, max_attempts int, remote_id string, created_at timestamp, started_at timestamp, submitted_at timestamp, completed_at timestamp, updated_at timestamp, chunk_count bigint, last_error string"
MESSAGE = "kind string, id bigint, guid string, max_attempts int, remote_id string, state string, reason string, permanent boolean, chunks bigint, at timestamp"


def settled(jobs: DataFrame, statuses: DataFrame, now: Column, give_up_s: float) -> DataFrame:
    """jobs after statuses (id, state, reason, permanent, chunks): a poll that could not be made leaves a job as it is; a running
    or waiting one is touched, or failed if it was submitted over give_up_s ago; a completed one without chunks, a failed one
    and one of an unknown state have failed, a permanent failure for good."""
    named = statuses.dropna(subset=["id"]).groupBy("id").agg(F.max_by(F.struct("state", "reason", "permanent", "chunks"), F.struct("at", "state")).alias("_s"))
    x = jobs.join(named, "id", "left")
    state, live = F.col("_s.state"), F.col("status").isin(states.IN_FLIGHT) & F.col("remote_id").isNotNull() & F.col("_s").isNotNull()
    waits = state.isin(PENDING)
    late = waits & (F.unix_micros(now.cast("timestamp")) - F.unix_micros("submitted_at") > F.lit(int(give_up_s * 1e6)))
    done = (state == DONE) & (F.coalesce(F.col("_s.chunks"), F.lit(0)) > 0)
    fails = late | (~waits & ~done)
    reason = F.when(late, F.concat(F.lit("gave up, still "), state)).when(state == DONE, "no transcript blocks").when(state.isin(FAILED), F.concat_ws(": ", state, "_s.reason")).otherwise(F.concat(F.lit("unknown status "), F.coalesce(state, F.lit("null"))))
    on = F.coalesce(live & (F.coalesce(state, F.lit("")) != UNAVAILABLE), F.lit(False))
    put = {
        "status": F.when(done, "completed").when(fails, "failed").when(state == RUNNING, "processing").otherwise(F.col("status")),
        "attempt_count": F.when(fails & F.coalesce("_s.permanent", F.lit(False)), F.col("max_attempts")).otherwise(F.col("attempt_count")),
        "chunk_count": F.when(done, F.col("_s.chunks")).otherwise(F.col("chunk_count")), "completed_at": F.when(done, now).otherwise(F.col("completed_at")),
        "last_error": F.when(done, F.lit(None)).when(fails, reason.substr(1, 2000)).otherwise(F.col("last_error")), "updated_at": now,
    }
    return x.withColumns({k: F.when(on, v).otherwise(F.col(k)) for k, v in put.items()}).select(*jobs.columns)


def accepted(jobs: DataFrame, told: DataFrame, now: Column) -> DataFrame:
    """jobs of which told (id, remote_id) says that the remote side has taken them."""
    named = told.dropna(subset=["id", "remote_id"]).groupBy("id").agg(F.max_by("remote_id", F.struct("at", "remote_id")).alias("_r"))
    x = jobs.join(named, "id", "left")
    on = F.col("_r").isNotNull() & (F.col("status") == "submitted") & F.col("remote_id").isNull()
    put = {"remote_id": F.col("_r"), "submitted_at": now, "last_error": F.lit(None).cast("string"), "updated_at": now}
    return x.withColumns({k: F.when(on, v).otherwise(F.col(k)) for k, v in put.items()}).select(*jobs.columns)


def enqueued(jobs: DataFrame, new: DataFrame, now: Column, max_attempts: int) -> DataFrame:
    """jobs and a pending one for each guid of new that has none yet, numbered after the last id in the order of guids."""
    fresh = new.dropna(subset=["guid"]).groupBy("guid").agg(F.min_by("max_attempts", F.struct("at", "max_attempts")).alias("max_attempts")).join(jobs.select("guid"), "guid", "left_anti")
    if fresh.isEmpty():
        return jobs
    from pyspark.sql import Window

    last = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    # the guids that a batch brings are few, and numbers must follow one another
    rows = fresh.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.row_number().over(Window.orderBy("guid")))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in jobs.schema if f.name not in ("id", "guid")}
    put = blank | {"status": F.lit("pending"), "attempt_count": F.lit(0), "max_attempts": F.coalesce("max_attempts", F.lit(max_attempts)), "created_at": now, "updated_at": now}
    return jobs.unionByName(rows.withColumns(put).select(*jobs.columns))


def stepped(jobs: DataFrame, messages: DataFrame, now: Column, claims: int, stale_minutes: int = 15, give_up_s: float = 7200.0, max_attempts: int = 3) -> DataFrame:
    """jobs after a batch, with claimed: whether this batch claimed the job."""
    of = lambda kind: messages.filter(F.col("kind") == kind)
    # a job is claimed once a batch: what failed in this one waits for the next
    x = accepted(jobs, of("accepted"), now)
    x = settled(x, of("status"), now, give_up_s)
    x = states.failed(x, of("refused").select("id", "reason", "permanent"), now)
    x = states.cancelled(states.deferred(x, of("defer").select("id", "reason"), now), of("cancel").select("id", "reason"), now)
    x = states.recovered(x, now, stale_minutes)
    x = enqueued(x, of("enqueue"), now, max_attempts)
    touched = messages.filter("kind IN ('status', 'refused', 'defer')").select("id").dropna().distinct().withColumn("_touched", F.lit(True))
    free = x.join(touched, "id", "left").filter("_touched IS NULL").select(*x.columns)
    taken = claimable(free, claims).select("id", F.lit(True).alias("claimed"))
    x = x.join(F.broadcast(taken), "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    put = {"status": F.lit("submitted"), "attempt_count": F.col("attempt_count") + 1, "remote_id": F.lit(None).cast("string"), "started_at": F.coalesce("started_at", now), "updated_at": now}
    return x.withColumns({k: F.when(F.col("claimed"), v).otherwise(F.col(k)) for k, v in put.items()})


class Queue:
    """The versions of a table of jobs in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The numbers of the versions that are whole."""
        files, path = self._files()
        if not files.exists(path):
            return []
        names = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")]
        marked = [p for p in names if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in marked)

    def jobs(self, before: int | None = None) -> DataFrame:
        """The last version, or the last one before a batch; an empty table where there is none."""
        known = [v for v in self.versions() if before is None or v < before]
        read = self.spark.read.schema(f"{JOBS}, claimed boolean")
        return read.parquet(f"{self.path}/batch={known[-1]}") if known else self.spark.createDataFrame([], f"{JOBS}, claimed boolean")

    def writer(self, clock: Callable[[], Column], claims: int, send: Callable[[DataFrame], None] | None = None, **limits) -> Callable[[DataFrame, int], None]:
        """For foreachBatch. clock: the instant of a batch; send: gets the claims of a batch (id, guid, attempt_count) once the version
        stands, and again if the batch is run again."""

        def on_batch(batch: DataFrame, number: int) -> None:
            if number not in self.versions():
                jobs = self.jobs(number).drop("claimed")
                done = stepped(jobs, batch.select(*[c.split()[0] for c in MESSAGE.split(", ")]), clock(), claims, **limits)
                done.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
                self._forget()
            if send:
                send(self.spark.read.schema(f"{JOBS}, claimed boolean").parquet(f"{self.path}/batch={number}").filter("claimed").select("id", "guid", "attempt_count"))

        return on_batch

    def _forget(self) -> None:
        files, path = self._files()
        for v in self.versions()[: -self.keep]:
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"batch={v}"), True)
