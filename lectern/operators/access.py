"""Entitlements, integrity checks, triggers and writes that depend on what is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task joins or groups (`apart`).
ROWS = 400_000


def live(as_of: Column, status: str = "status", expires: str = "expires_at") -> Column:
    """An enrolment that is active and not expired at as_of."""
    return (F.col(status) == "active") & (F.col(expires).isNull() | (F.col(expires) > as_of))


def apart(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """rows dealt by key to one task for each ROWS of n, so that a task's joins and groups stay the same size as tables grow."""
    return rows.repartition(max(1, -(-n // ROWS)), *key)


def accessible(grants: list[DataFrame], key: list[str]) -> DataFrame:
    """What any of the grants gives."""
    return reduce(DataFrame.unionByName, [g.select(*key) for g in grants]).distinct()


def completed_all(done: DataFrame, required: DataFrame, by: list[str], group: list[str], item: str) -> DataFrame:
    """Relational division: by and group for which every required item of the group is done; empty groups never count."""
    need = required.select(*group, item).distinct()
    totals = need.groupBy(*group).agg(F.count(F.lit(1)).alias("_total"))
    have = done.select(*by, *group, item).distinct().join(need, [*group, item], "left_semi").groupBy(*by, *group).agg(F.count(F.lit(1)).alias("_have"))
    return have.join(totals, group).filter("_have = _total").drop("_have", "_total")


def orphans(child: DataFrame, parent: DataFrame, key: dict[str, str]) -> DataFrame:
    """Rows of child without a parent; key maps the child's columns to the parent's. A null key is no orphan."""
    named = parent.select(*[F.col(p).alias(c) for c, p in key.items()])
    return child.dropna(subset=list(key)).join(named, list(key), "left_anti")


def insert_absent(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """The rows to append: the first of each key that isn't stored."""
    return new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def upserted(stored: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """stored with new rows in place of old ones of their key; the latest version wins, new rows on ties."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    latest = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_r"))
    return latest.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """check and offending (rows, 0 too) of each named set of offending rows; counted in parallel, never collected."""
    counted = [rows.agg(F.count(F.lit(1)).alias("offending")).select(F.lit(name).alias("check"), "offending") for name, rows in checks.items()]
    return reduce(DataFrame.unionByName, counted)


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand in several rows; null keys are equal."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def allocated(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new messages (session_id, id, at, request_key) with the next message_order of their session, in order of (at, id).
    Of a session's request key only the first message counts, and none if it is stored; a null key is never a repeat."""
    key = ["session_id", "request_key"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("at", "id"))
    once = new.withColumn("_n", nth).filter(F.col("request_key").isNull() | (F.col("_n") == 1)).drop("_n")
    fresh = once.join(stored.select(*key).dropna().distinct(), key, "left_anti")
    last = stored.groupBy("session_id").agg(F.max("message_order").alias("_last"))
    order = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("session_id").orderBy("at", "id"))
    return fresh.join(last, "session_id", "left").withColumn("message_order", order.cast("bigint")).drop("_last")


def fan_out(reports: DataFrame, sent: DataFrame) -> DataFrame:
    """A notification for the student and one for the doctor of each report, but those that were sent."""
    each = reports.select("report_id", F.explode(F.array("student_id", "doctor_id")).alias("user_id")).dropna().distinct()
    return each.join(sent.select("report_id", "user_id"), ["report_id", "user_id"], "left_anti")


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"), F.count(F.lit(1)).alias("total"))


def within_quota(requests: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Requests of one unit each that a quota of `limit` per key lets through, in order of (at, id)."""
    return requests.withColumn("used", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "id"))).filter(F.col("used") <= limit)


def claimable(jobs: DataFrame, n: int = 1, now: str | None = None) -> DataFrame:
    """The oldest jobs that are pending, or failed with attempts left (attempt_count below their own max_attempts), as they
    stand after the claim: submitted, one attempt more, without the remote id, started now unless started before. Ties of
    created_at go by id; jobs of a null max_attempts that failed are left alone."""
    free = (F.col("status") == "pending") | (F.col("status") == "failed") & (F.col("attempt_count") < F.col("max_attempts"))
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    claimed = {"status": F.lit("submitted"), "attempt_count": F.col("attempt_count") + 1, "remote_id": F.lit(None).cast("string"), "started_at": F.coalesce(F.col("started_at"), at)}
    return jobs.filter(free).orderBy("created_at", "id").limit(n).withColumns(claimed)


def rubric_scores(results: DataFrame, criteria: DataFrame, max_points: float = 10.0) -> DataFrame:
    """Points of each answer: yes 1, partial one half, no and contradicted 0, times the criterion's marks if all criteria of
    the question have some, else times equal parts of max_points; at most max_points, half up to two places. An answer with
    an unknown criterion, one that lacks, or one given twice has no points and says so (problem, the first of these)."""
    value = F.when(F.col("status") == "yes", F.expr("1.0BD")).when(F.col("status") == "partial", F.expr("0.5BD")).otherwise(F.expr("0.0BD"))
    known = criteria.select("question_id", "criterion_id", F.col("marks").cast("decimal(10,2)").alias("marks")).withColumn("_known", F.lit(True))
    rules = known.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"), F.count("marks").alias("_m"))
    each = results.join(known, ["question_id", "criterion_id"], "left").groupBy("question_id", "answer_id").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(F.when(F.col("_known"), F.col("criterion_id"))).alias("_have"), F.count_if(F.col("_known").isNull()).alias("_strange"), F.sum(value * F.col("marks")).alias("_weighed"), F.sum(value).alias("_plain"))
    out = each.join(rules, "question_id", "left")
    problem = F.when(F.col("_n").isNull() | (F.col("_strange") > 0), "unknown").when(F.col("_have") < F.col("_n"), "missing").when(F.col("_rows") != F.col("_n"), "repeated")
    top = F.lit(max_points).cast("decimal(10,2)")
    points = F.when(F.col("_m") == F.col("_n"), F.col("_weighed")).otherwise((F.col("_plain") * top / F.col("_n")).cast("decimal(20,6)"))
    return out.withColumn("problem", problem).select("question_id", "answer_id", F.col("problem").isNull().alias("complete"), F.when(F.col("problem").isNull(), F.round(F.least(points, top).cast("decimal(20,6)"), 2).cast("double")).alias("points"), "problem")


def agreement(graded: DataFrame) -> DataFrame:
    """Of expected and given points: mean absolute error, exact match, and shares within a half and one point."""
    off = F.abs(F.col("expected") - F.col("given"))
    return graded.agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("mae"), F.avg((off == 0).cast("int")).alias("exact"), F.avg((off <= 0.5).cast("int")).alias("within_half"), F.avg((off <= 1.0).cast("int")).alias("within_one"))
