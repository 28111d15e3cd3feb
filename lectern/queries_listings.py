"""Queries of listings and integrity checks on the driver's tables, with SQL for comparison; `queries` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import access, integrity, listings
from .registry import query
from .sources import table

# The driver's tables read as learning tables: table, columns.
TABLES = {
    "users": ("customer", {"id": "c_custkey", "name": "c_name", "role": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'doctor' WHEN c_mktsegment = 'MACHINERY' THEN 'guest' ELSE 'student' END"}),
    "courses": ("nation", {"id": "n_nationkey", "title": "n_name", "doctor_id": "n_nationkey + n_regionkey"}),
    "lectures": ("part", {"id": "p_partkey", "course_id": "CASE WHEN p_partkey % 10 > 0 THEN CAST(p_partkey % 25 AS INT) END"}),
    "enrolments": ("orders", {"id": "o_orderkey", "student_id": "o_custkey + 10", "course_id": "CAST(o_orderkey % 27 AS INT)"}),
    "events": ("events", {"id": "event_id", "student_id": "user_id * 2", "lecture_id": "user_id % 70 * 40", "event_type": "CASE event_type WHEN 'view' THEN 'play' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'seek' ELSE event_type END", "video_ts": "value - 5", "session_id": "CASE WHEN event_id % 9 > 0 THEN user_id END"}),
    "chunks": ("lineitem", {"lecture_id": "l_partkey * 2", "start_ts": "l_linenumber * 5", "end_ts": "l_quantity"}),
    "questions": ("part", {"id": "p_partkey", "lecture_id": "p_partkey + 5", "options": "CASE WHEN p_size % 11 = 0 THEN '{\"a\": 1}' WHEN p_size % 5 = 0 THEN '[\"A x\", \"b y\", \"C z\"]' ELSE '[\"A x\", \"b y\", \"C z\", \"D\"]' END", "correct_option": "CASE p_size % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'B' WHEN 2 THEN 'c' WHEN 3 THEN 'd' WHEN 4 THEN 'E' END"}),
    "attempts": ("lineitem", {"id": "l_orderkey * 10 + l_linenumber", "student_id": "l_orderkey % 40", "question_id": "l_partkey + 3"}),
    "reports": ("orders", {"id": "o_orderkey + 40", "student_id": "o_custkey + 2", "course_id": "CAST(o_orderkey % 26 AS INT)", "kind": "CASE o_orderpriority WHEN '1-URGENT' THEN 'exam' WHEN '5-LOW' THEN 'other' ELSE 'module' END", "lecture_id": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 13 END"}),
    "notifications": ("orders", {"id": "o_orderkey", "user_id": "o_custkey + 3", "report_id": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END"}),
}


def _t(s, d, name):
    source, columns = TABLES[name]
    return table(s, d, source).select(*[F.expr(c).alias(n) for n, c in columns.items()])


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"x_{n} AS (SELECT " + ", ".join(f"{c} AS {k}" for k, c in TABLES[n][1].items()) + f" FROM {TABLES[n][0]})" for n in names)


_SUITE = {
    "enrolments without their student or course": "x_enrolments WHERE student_id NOT IN (SELECT id FROM x_users) OR course_id NOT IN (SELECT id FROM x_courses)",
    "repeated enrolments": "(SELECT student_id FROM x_enrolments GROUP BY student_id, course_id HAVING count(*) > 1)",
    "events without their student or lecture": "x_events WHERE student_id NOT IN (SELECT id FROM x_users) OR lecture_id NOT IN (SELECT id FROM x_lectures)",
    "events of an unknown type": "x_events WHERE event_type NOT IN ('play', 'pause', 'seek', 'skip', 'complete', 'rewatch_segment', 'heartbeat', 'tab_hidden', 'tab_visible')",
    "events at no place or a negative one": "x_events WHERE coalesce(video_ts, -1) < 0",
    "events without a session": "x_events WHERE session_id IS NULL",
    "events past the lecture's end": "x_events e WHERE video_ts > 1 + (SELECT max(end_ts) FROM x_chunks c WHERE c.lecture_id = e.lecture_id)",
    "attempts without their student or question": "x_attempts WHERE student_id NOT IN (SELECT id FROM x_users) OR question_id NOT IN (SELECT id FROM x_questions)",
    "attempts by students outside the course": "x_attempts a JOIN x_questions q ON q.id = question_id JOIN x_lectures l ON l.id = q.lecture_id WHERE l.course_id IS NOT NULL AND a.student_id IN (SELECT id FROM x_users) AND (a.student_id, l.course_id) NOT IN (SELECT (student_id, course_id) FROM x_enrolments)",
    "questions whose answer is no option": "x_questions WHERE NOT coalesce(list_contains(list_transform(json_extract_string(options, '$[*]'), lambda o: upper(left(o, 1))), upper(correct_option)), false)",
    "questions without four options": "x_questions WHERE json_type(options) <> 'ARRAY' OR json_array_length(options) <> 4",
    "questions on a lecture of no course": "x_questions WHERE lecture_id IN (SELECT id FROM x_lectures WHERE course_id IS NULL)",
    "lectures without a length": "x_lectures WHERE id NOT IN (SELECT lecture_id FROM x_chunks)",
    "notifications of a missing report": "x_notifications WHERE report_id IS NOT NULL AND report_id NOT IN (SELECT id FROM x_reports)",
    "notifications to a missing user": "x_notifications WHERE user_id NOT IN (SELECT id FROM x_users)",
    "reports without their student or course": "x_reports WHERE student_id NOT IN (SELECT id FROM x_users) OR course_id NOT IN (SELECT id FROM x_courses)",
    "reports of an unknown kind": "x_reports WHERE kind NOT IN ('module', 'exam')",
    "repeated reports of one completion": "(SELECT kind FROM x_reports GROUP BY student_id, course_id, kind, coalesce(lecture_id, 0) HAVING count(*) > 1)",
    "users of an unknown role": "x_users WHERE role NOT IN ('student', 'doctor')",
    "chunks that end before they begin": "x_chunks WHERE end_ts <= start_ts",
}


@query(_with(*TABLES) + " " + " UNION ALL ".join(f"SELECT '{n.replace(chr(39), chr(39) * 2)}' AS \"check\", count(*) AS offending FROM {q}" for n, q in _SUITE.items()))
def integrity_suite(s, d):
    return access.violations(integrity.suite({n: _t(s, d, n) for n in TABLES}))


@query(_with("users", "courses", "lectures") + ", a AS (SELECT user_id AS student_id, course_id, max(ts) AS last_activity FROM events JOIN x_lectures l ON l.id = user_id % 70 GROUP BY 1, 2) SELECT o_custkey AS student_id, u.name AS student_name, c.id AS course_id, c.title AS course_title, doctor_id, v.name AS doctor_name, last_activity FROM orders JOIN x_users u ON u.id = o_custkey JOIN x_courses c ON c.id = o_orderkey % 25 JOIN x_users v ON v.id = doctor_id LEFT JOIN a ON a.student_id = o_custkey AND a.course_id = c.id WHERE o_orderstatus = 'F' AND (o_orderkey % 4 = 0 OR o_orderdate + INTERVAL 2 YEARS > TIMESTAMP '1996-06-01')")
def report_subjects(s, d):
    enrolments = table(s, d, "orders").selectExpr("o_custkey AS student_id", "CAST(o_orderkey % 25 AS INT) AS course_id", "CASE WHEN o_orderstatus = 'F' THEN 'active' ELSE 'ended' END AS status", "CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + INTERVAL 2 YEARS END AS expires_at")
    seen = table(s, d, "events").selectExpr("user_id AS student_id", "user_id % 70 AS lecture_id", "ts AS at")
    courses, lectures = _t(s, d, "courses").withColumnRenamed("id", "course_id"), _t(s, d, "lectures").withColumnRenamed("id", "lecture_id")
    return listings.report_subjects(enrolments, _t(s, d, "users"), courses, lectures, seen, F.expr("TIMESTAMP'1996-06-01 00:00:00'"))


@query(_with("courses") + ", e AS (SELECT p_partkey AS exam_id, CAST(p_partkey % 25 AS INT) AS course_id FROM part), l AS (SELECT exam_id, course_id, c.title AS course_title, doctor_id, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = exam_id) AS questions, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3000 = exam_id) AS students, (SELECT count(*) FROM orders WHERE o_orderkey % 3000 = exam_id) AS sittings, (SELECT max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) FROM orders WHERE o_orderkey % 3000 = exam_id) AS last_answered FROM e JOIN x_courses c ON c.id = course_id) SELECT *, CAST(row_number() OVER (PARTITION BY doctor_id ORDER BY last_answered DESC NULLS LAST, exam_id) AS INT) AS position FROM l")
def exams_of_doctors(s, d):
    of = table(s, d, "part").selectExpr("p_partkey AS exam_id", "CAST(p_partkey % 25 AS INT) AS course_id")
    asked = table(s, d, "lineitem").selectExpr("l_partkey AS exam_id", "l_suppkey AS question_id")
    sittings = table(s, d, "orders").selectExpr("o_orderkey % 3000 AS exam_id", "o_custkey AS student_id", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS submitted_at")
    return listings.exams(of, _t(s, d, "courses").withColumnRenamed("id", "course_id"), asked, sittings)


_SUBSCRIPTIONS = "sb AS (SELECT o_custkey AS student_id, o_orderkey % 30 AS doctor_id, max(o_orderdate) AS subscribed_at FROM orders GROUP BY 1, 2)"


def _subscriptions(s, d):
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("student_id"), F.expr("o_orderkey % 30").alias("doctor_id")).agg(F.max("o_orderdate").alias("subscribed_at"))


@query(_with("users", "courses") + f", {_SUBSCRIPTIONS} SELECT student_id, doctor_id, subscribed_at, u.name AS doctor_name, (SELECT count(*) FROM x_courses c WHERE c.doctor_id = sb.doctor_id) AS courses, (SELECT count(*) FROM part WHERE p_partkey % 40 = sb.doctor_id) AS lectures, CAST(row_number() OVER (PARTITION BY student_id ORDER BY subscribed_at DESC NULLS LAST, doctor_id) AS INT) AS position FROM sb JOIN x_users u ON u.id = doctor_id")
def teachers_of_students(s, d):
    lectures = table(s, d, "part").selectExpr("p_partkey % 40 AS doctor_id")
    return listings.teachers_of(_subscriptions(s, d), _t(s, d, "users"), _t(s, d, "courses"), lectures)


@query(_with("users") + f", {_SUBSCRIPTIONS} SELECT student_id, doctor_id, subscribed_at, u.name AS student_name, CAST(row_number() OVER (PARTITION BY doctor_id ORDER BY subscribed_at DESC NULLS LAST, student_id) AS INT) AS position FROM sb JOIN x_users u ON u.id = student_id")
def students_of_doctors(s, d):
    return listings.students_of(_subscriptions(s, d), _t(s, d, "users"))


@query("WITH st AS (SELECT conv_id AS session_id, count(*) FILTER (WHERE turn < 2) AS until FROM conversations GROUP BY 1), m AS (SELECT conv_id AS session_id, turn AS expected, text AS summary, turn + 2 AS until FROM conversations WHERE role = 'user'), f AS (SELECT m.session_id, m.summary, m.until, row_number() OVER (PARTITION BY m.session_id ORDER BY m.until, m.summary) AS n FROM st JOIN m ON m.session_id = st.session_id AND m.expected = st.until) SELECT st.session_id, CASE WHEN f.until IS NOT NULL THEN f.summary END AS summary, CAST(coalesce(f.until, st.until) AS BIGINT) AS until FROM st LEFT JOIN f ON f.session_id = st.session_id AND n = 1")
def summary_updates(s, d):
    x = table(s, d, "conversations")
    sessions = x.groupBy(F.col("conv_id").alias("session_id")).agg(F.count_if(F.col("turn") < 2).alias("until")).withColumn("summary", F.lit(None).cast("string"))
    made = x.filter("role = 'user'").selectExpr("conv_id AS session_id", "turn AS expected", "text AS summary", "turn + 2 AS until")
    return listings.summaries_set(sessions, made)
