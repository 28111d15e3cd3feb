"""Queries of the verification listings on the driver's tables, with SQL for comparison; `queries` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as X
from .operators import verification as V
from .registry import query
from .sources import table


def _events(s, d):
    return X.events(s, d).withColumnRenamed("resource_id", "lecture_id")


_ST = f"{X.EV}, st AS (SELECT *, lag(event_type) OVER w AS was, tm - lag(tm) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY student_id, resource_id, session_id ORDER BY tm, id))"


@query(f"WITH {_ST}, g AS (SELECT student_id, resource_id AS lecture_id, coalesce(sum(least(gap, 90)) FILTER (WHERE was IN ('play', 'heartbeat', 'seek', 'tab_visible')), 0) AS w, coalesce(sum(gap) FILTER (WHERE was = 'tab_hidden'), 0) AS a FROM st GROUP BY 1, 2) SELECT student_id, lecture_id, round(CAST(printf('%.1f', w / 60) AS DOUBLE), 0) AS watch_min, round(CAST(printf('%.1f', a / 60) AS DOUBLE), 0) AS away_min FROM g WHERE a > 0")
def verify_watch_and_away(s, d):
    return V.watch_and_away(_events(s, d)).select("student_id", "lecture_id", F.round("watch_min", 0).alias("watch_min"), F.round("away_min", 0).alias("away_min"))


@query(f"WITH {X.EV}, b AS (SELECT student_id, resource_id, video_ts AS landed, lag(video_ts) OVER (PARTITION BY student_id, resource_id, session_id ORDER BY tm, id) AS came FROM ev WHERE event_type IN ('seek', 'play', 'heartbeat', 'pause')) SELECT resource_id AS lecture_id, CAST(floor(landed / 60) * 60 AS BIGINT) AS bucket, count(DISTINCT student_id) AS students, count(*) AS rewinds FROM b WHERE landed < came - 5 GROUP BY 1, 2")
def verify_rewinds(s, d):
    return V.rewinds(_events(s, d))


@query("WITH q AS (SELECT DISTINCT l_partkey AS question_id, l_partkey % 300 AS lecture_id FROM lineitem), z AS (SELECT lecture_id, count(*) AS questions FROM q GROUP BY 1), t AS (SELECT DISTINCT o_custkey % 50 AS student_id, l_partkey AS question_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT student_id, lecture_id, count(*) AS n FROM t JOIN q USING (question_id) GROUP BY 1, 2) SELECT student_id, lecture_id, questions FROM n JOIN z USING (lecture_id) WHERE n = questions")
def verify_answered_lectures(s, d):
    line = table(s, d, "lineitem")
    questions = line.select(F.col("l_partkey").alias("question_id"), (F.col("l_partkey") % 300).alias("lecture_id"))
    attempts = line.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 50).alias("student_id"), F.col("l_partkey").alias("question_id"))
    return V.answered_lectures(questions, attempts)


@query("WITH l AS (SELECT s_suppkey AS lecture_id, s_nationkey AS course_id FROM supplier), z AS (SELECT course_id, count(*) AS lectures FROM l GROUP BY 1), e AS (SELECT DISTINCT o_custkey % 90 AS student_id, o_orderkey % 25 AS course_id FROM orders), d AS (SELECT DISTINCT o_custkey % 90 AS student_id, l_suppkey AS lecture_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'), n AS (SELECT e.student_id, e.course_id, count(*) AS n FROM e JOIN l USING (course_id) JOIN d ON d.student_id = e.student_id AND d.lecture_id = l.lecture_id GROUP BY 1, 2) SELECT student_id, course_id, lectures FROM n JOIN z USING (course_id) WHERE n = lectures")
def verify_completed_courses(s, d):
    lectures = table(s, d, "supplier").select(F.col("s_suppkey").alias("lecture_id"), F.col("s_nationkey").alias("course_id"))
    orders = table(s, d, "orders").select((F.col("o_custkey") % 90).alias("student_id"), "o_orderkey")
    enrolments = orders.select("student_id", (F.col("o_orderkey") % 25).alias("course_id"))
    events = table(s, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("student_id", F.col("l_suppkey").alias("lecture_id"), F.when(F.col("l_returnflag") == "R", "complete").otherwise("play").alias("event_type"))
    return V.completed_courses(enrolments, lectures, events)


@query("SELECT DISTINCT p_brand AS subject_id, p_size AS doctor_id, count(*) OVER (PARTITION BY p_brand, p_size) AS courses FROM part")
def verify_doctors_of_subject(s, d):
    return V.doctors_of_subject(table(s, d, "part").select(F.col("p_brand").alias("subject_id"), F.col("p_size").alias("doctor_id")), ["subject_id", "doctor_id"])


@query("SELECT s_suppkey AS module_id, s_nationkey AS course_id, CAST(s_suppkey % 7 AS INT) AS position, (SELECT count(*) FROM part WHERE p_partkey % 130 = s_suppkey) AS lectures FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name LIKE 'NATION_1%'")
def verify_modules(s, d):
    modules = table(s, d, "supplier").select(F.col("s_suppkey").alias("module_id"), F.col("s_nationkey").alias("course_id"), (F.col("s_suppkey") % 7).cast("int").alias("position"))
    courses = table(s, d, "nation").select(F.col("n_nationkey").alias("course_id"), F.col("n_name").alias("title"))
    return V.modules_of(modules, courses, table(s, d, "part").select((F.col("p_partkey") % 130).alias("module_id")), "NATION_1")


@query("SELECT l_orderkey AS student_id, l_partkey AS question_id, l_linenumber AS attempt_number, l_quantity AS response_s FROM lineitem l WHERE l_linenumber = (SELECT max(m.l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey)")
def verify_last_attempts(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("student_id"), F.col("l_partkey").alias("question_id"), F.col("l_linenumber").alias("attempt_number"), F.col("l_quantity").alias("response_s"))
    return V.last_attempts(rows, ["student_id"])


@query("WITH h AS (SELECT DISTINCT o_custkey AS student_id, o_orderkey % 100 AS doctor_id FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT p_size AS doctor_id, count(DISTINCT l_suppkey) AS lectures FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l ON l_partkey = p_partkey GROUP BY 1) SELECT student_id, h.doctor_id, coalesce(lectures, 0) AS lectures FROM h LEFT JOIN n USING (doctor_id)")
def verify_unlocked(s, d):
    courses = table(s, d, "part").select(F.col("p_partkey").alias("course_id"), F.col("p_size").cast("bigint").alias("doctor_id"))
    lectures = table(s, d, "lineitem").select(F.col("l_partkey").alias("course_id"), F.col("l_suppkey").alias("lecture_id")).distinct()
    held = table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % 100).alias("doctor_id"))
    return V.unlocked(lectures, courses, held)


def _mail(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id"), F.col("ts").alias("created_at"), F.when(F.col("value") > 30, F.col("ts")).alias("read_at"))


@query("WITH n AS (SELECT event_id AS id, user_id, ts, value > 30 AS was_read, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, count(*) FILTER (WHERE value <= 30) OVER (PARTITION BY user_id) AS unread FROM events) SELECT user_id, id, CAST(place AS INT) AS place, unread FROM n WHERE place <= 20")
def mail_inbox(s, d):
    return V.inbox(_mail(s, d), 20).select("user_id", "id", "place", "unread")


@query("SELECT user_id, count(*) FILTER (WHERE NOT (value > 30 OR user_id % 10 = 0 OR event_id % 3 = 0)) AS unread FROM events GROUP BY 1")
def mail_marked_read(s, d):
    mail = _mail(s, d)
    marks = mail.filter("id % 3 = 0").select("user_id", "id").union(mail.filter("user_id % 10 = 0").select("user_id", F.lit(None).cast("bigint")))
    # another user's id marks nothing
    strangers = mail.select((F.col("user_id") + 1).alias("user_id"), "id").filter("id % 5 = 1")
    return V.marked_read(mail, marks.union(strangers), F.expr("TIMESTAMP'2024-03-01'")).groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


@query("WITH s AS (SELECT user_id, event_type, min(event_id) AS o FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), n AS (SELECT user_id, event_type, min(event_id) AS f FROM events WHERE event_id % 3 > 0 GROUP BY 1, 2) SELECT user_id, event_type, coalesce(o, f) AS event_id, o IS NULL AS inserted FROM n LEFT JOIN s USING (user_id, event_type)")
def inserted_or_existing(s, d):
    x = table(s, d, "events").select("event_id", "user_id", "event_type")
    return V.inserted_or_existing(x.filter("event_id % 3 > 0"), x.filter("event_id % 3 = 0"), ["user_id", "event_type"], ["event_id"])


@query("SELECT count(*) AS cases, count(*) FILTER (WHERE l_linenumber < 7) AS graded, count(*) FILTER (WHERE l_linenumber = 7) AS failed, count(*) FILTER (WHERE l_returnflag = 'R') AS to_review, round(avg(abs(l_quantity - l_discount * 100)) FILTER (WHERE l_linenumber < 7), 4) AS mean_error, round(avg(CASE WHEN abs(l_quantity - round(l_discount * 100, 0)) <= 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE l_linenumber < 7), 5) AS within_one, round(avg(l_partkey), 4) AS latency_ms FROM lineitem")
def essay_evaluation(s, d):
    given = F.when(F.col("l_linenumber") < 7, F.round(F.col("l_discount") * 100, 0))
    cases = table(s, d, "lineitem").select(F.col("l_quantity").alias("expected"), given.alias("given"), (F.col("l_returnflag") == "R").alias("needs_review"), F.col("l_partkey").alias("latency_ms"))
    x = V.evaluation(cases)
    return x.select("cases", "graded", "failed", "to_review", F.round(F.col("mean_error").cast("double"), 4).alias("mean_error"), F.round(F.col("within_one").cast("double"), 5).alias("within_one"), F.round("latency_ms", 4).alias("latency_ms"))


@query("WITH u AS (SELECT event_id::VARCHAR AS question_id, user_id, value > 50 AS ok FROM events WHERE event_type = 'view' UNION ALL SELECT 'exam:' || l_partkey, l_suppkey, l_returnflag <> 'R' FROM lineitem) SELECT question_id LIKE 'exam:%' AS of_exam, count(*) AS n, count(DISTINCT question_id) AS questions, count(*) FILTER (WHERE ok) AS correct FROM u GROUP BY 1")
def quiz_and_exam_evidence(s, d):
    from .operators.reads import with_exams

    quiz = table(s, d, "events").filter("event_type = 'view'").select(F.col("event_id").alias("question_id"), F.col("user_id").alias("student_id"), (F.col("value") > 50).alias("is_correct"))
    exams = table(s, d, "lineitem").select(F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("student_id"), (F.col("l_returnflag") != "R").alias("is_correct"))
    both = with_exams(quiz, exams).withColumn("of_exam", F.col("question_id").startswith("exam:"))
    return both.groupBy("of_exam").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("question_id").alias("questions"), F.count_if("is_correct").alias("correct"))
