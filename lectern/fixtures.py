"""The driver's tables read as learning data; the same mappings as SQL, for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import epoch
from .sources import table

KINDS = {"view": "play", "click": "heartbeat", "error": "tab_hidden", "signup": "tab_visible", "purchase": "seek"}
RESOURCES, QUESTIONS, EXAMS, GAP = 7, 20, 5, 3600.0


def events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    resource = F.get_json_object("props", "$.k").cast("bigint") % RESOURCES
    day = F.col("ts").cast("date")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("student_id"), resource.alias("resource_id"), F.concat_ws(":", "user_id", day.cast("string")).alias("session_id"), kind.alias("event_type"), F.col("value").alias("video_ts"), epoch(F.col("ts")).alias("at"), day.alias("day"), F.lit(1.0).alias("rate"))


def responses(spark: SparkSession, d: str, apart=None) -> DataFrame:
    """apart: deals lines and orders (rows, number of lines, key) to tasks before they are joined."""
    line, order = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("student_id"))
    line = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate", "l_linestatus")
    if apart:
        n = line.count()
        line, order = apart(line, n, "l_orderkey"), apart(order, n, "l_orderkey")
    out = line.join(order, "l_orderkey")
    return out.select("student_id", F.col("l_orderkey").alias("sitting_id"), (F.col("l_orderkey") % EXAMS).alias("exam_id"), (F.col("l_partkey") % QUESTIONS).alias("question_id"), F.col("l_linenumber").cast("bigint").alias("attempt_number"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("response_id"), (F.col("l_returnflag") != "R").alias("is_correct"), F.col("l_quantity").alias("response_s"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_partkey") % 6).alias("topic"), F.col("l_linestatus").alias("difficulty"), (F.col("l_suppkey") % 4).alias("option_id"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("video_id"), "embedding")


EV = f"""ev AS (SELECT event_id AS id, user_id AS student_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % {RESOURCES} AS resource_id,
 user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, CASE event_type WHEN 'view' THEN 'play' WHEN 'click' THEN 'heartbeat' WHEN 'error' THEN 'tab_hidden' WHEN 'signup' THEN 'tab_visible' WHEN 'purchase' THEN 'seek' END AS event_type,
 value AS video_ts, epoch_us(ts) / 1e6 AS tm, CAST(ts AS DATE) AS day, 1.0::DOUBLE AS rate FROM events)"""

RS = f"""rs AS (SELECT o_custkey AS student_id, l_orderkey AS sitting_id, l_orderkey % {EXAMS} AS exam_id, l_partkey % {QUESTIONS} AS question_id, CAST(l_linenumber AS BIGINT) AS attempt_number,
 l_partkey * 1000 + l_suppkey AS response_id, l_returnflag <> 'R' AS is_correct, l_quantity AS response_s, CAST(l_shipdate AS DATE) AS day, l_partkey % 6 AS topic, l_linestatus AS difficulty, l_suppkey % 4 AS option_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

RP = EV + f""",
 r1 AS (SELECT *, row_number() OVER o AS n, lag(tm) OVER o AS pat, lag(video_ts) OVER o AS pvt,
  last_value(CASE WHEN event_type <> 'seek' THEN event_type END IGNORE NULLS) OVER b AS was,
  last_value(CASE WHEN event_type IN ('play','heartbeat') THEN rate END IGNORE NULLS) OVER b AS prate FROM ev
  WINDOW o AS (PARTITION BY student_id, resource_id, session_id ORDER BY tm, id), b AS (PARTITION BY student_id, resource_id, session_id ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 r2 AS (SELECT *, last_value(CASE WHEN event_type = 'tab_hidden' THEN n END IGNORE NULLS) OVER b AS hn, last_value(CASE WHEN event_type = 'tab_hidden' THEN tm END IGNORE NULLS) OVER b AS hat,
  last_value(CASE WHEN event_type = 'tab_hidden' THEN CASE WHEN was IN ('play','heartbeat') THEN 1 WHEN was = 'tab_visible' THEN -1 ELSE 0 END END IGNORE NULLS) OVER b AS hs,
  last_value(CASE WHEN event_type = 'tab_visible' THEN n END IGNORE NULLS) OVER b AS pv FROM r1
  WINDOW b AS (PARTITION BY student_id, resource_id, session_id ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 r3 AS (SELECT *, hn IS NULL OR hn < coalesce(pv, 0) AS unmatched, last_value(CASE WHEN event_type = 'tab_visible' THEN CASE WHEN hn IS NULL OR hn < coalesce(pv, 0) THEN 0 WHEN hs >= 0 THEN hs END END IGNORE NULLS) OVER u AS base FROM r2
  WINDOW u AS (PARTITION BY student_id, resource_id, session_id ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 r4 AS (SELECT *, CASE WHEN event_type = 'tab_visible' AND NOT unmatched THEN greatest(tm - hat, 0) ELSE 0 END AS away, coalesce(last_value(CASE WHEN event_type IN ('play','heartbeat') THEN 1 WHEN event_type IN ('pause','complete','tab_hidden') THEN 0 WHEN event_type = 'tab_visible' THEN coalesce(base, 0) END IGNORE NULLS) OVER b, 0) AS playing FROM r3
  WINDOW b AS (PARTITION BY student_id, resource_id, session_id ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 r5 AS (SELECT *, CASE WHEN playing = 1 THEN least(greatest(tm - pat, 0), {GAP}) ELSE 0 END AS elapsed, greatest(coalesce(pvt, 0), 0) AS "start" FROM r4),
 r6 AS (SELECT *, "start" + elapsed * greatest(coalesce(nullif(prate, 0), 1), 0.25) AS "end" FROM r5),
 rp AS (SELECT *, CASE WHEN event_type = 'seek' THEN CASE WHEN video_ts < "end" - 2 THEN 'back' WHEN video_ts > "end" + 2 THEN 'forward' ELSE 'none' END END AS seek FROM r6)"""

SPANS = RP + """, sp AS (SELECT student_id, resource_id, "start", "end" FROM rp WHERE "end" > "start")"""
MERGED = SPANS + """,
 m1 AS (SELECT *, max("end") OVER (PARTITION BY student_id, resource_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
 m2 AS (SELECT *, sum(CASE WHEN "start" <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY student_id, resource_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m1),
 mg AS (SELECT student_id, resource_id, min("start") AS "start", max("end") AS "end", count(*) AS n FROM m2 GROUP BY student_id, resource_id, island)"""
FF = RS + """, ff AS (SELECT student_id, exam_id, question_id, arg_min(is_correct, k) AS first_correct, arg_max(is_correct, k) AS final_correct, arg_max(response_s, k) AS final_response, count(*) AS tries
 FROM (SELECT *, {'a': sitting_id, 'b': attempt_number, 'c': response_id} AS k FROM rs) GROUP BY 1, 2, 3)"""
