"""Queries of reads, joins and reports on the driver's tables, with SQL for comparison; `queries` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as X
from .functions import EGYPTIAN, height_at_or_below, local_midnight, real_time_factor, renditions, rounded, seconds_to_midnight, token_estimate, uses_arabic, uses_egyptian
from .operators import reads, reports, retrieval
from .registry import query
from .sources import table
from .stored import stored


def _cols(df, **names):
    return df.select(*[(c if not isinstance(c, str) else F.expr(c)).alias(n) for n, c in names.items()])


def _chunks(s, d):
    return _cols(table(s, d, "lineitem"), lecture_id="CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END", video_id="CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey END", end_ts="l_quantity")


def _lectures(s, d):
    return _cols(table(s, d, "part"), lecture_id="p_partkey", course_id="p_partkey % 25", title="p_name")


def _videos(s, d):
    return _cols(table(s, d, "supplier"), video_id="s_suppkey", course_id="s_nationkey", title="s_name", duration_seconds="CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END")


def _courses(s, d):
    return _cols(table(s, d, "nation"), course_id="n_nationkey", title="n_name", doctor_id="n_regionkey")


def _enrolments(s, d):
    return _cols(table(s, d, "orders"), student_id="o_custkey", course_id="CAST(o_orderkey % 25 AS INT)", status="CASE WHEN o_orderstatus = 'F' THEN 'active' ELSE 'ended' END", expires_at="CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + INTERVAL 2 YEARS END", enrolled_at="o_orderdate")


def _as_of():
    return F.expr("TIMESTAMP'1996-06-01 00:00:00'")


EN = "en AS (SELECT o_custkey AS student_id, CAST(o_orderkey % 25 AS INT) AS course_id, o_orderdate AS enrolled_at FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 4 = 0 OR o_orderdate + INTERVAL 2 YEARS > TIMESTAMP '1996-06-01'))"
ST = "st AS (SELECT 'lecture' AS source_type, l_partkey AS resource_id, max(l_quantity) AS end_ts FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 2 UNION ALL SELECT 'video', l_suppkey, max(l_quantity) FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 2)"


@query(f"WITH {X.EV} SELECT id, student_id, resource_id, event_type FROM ev WHERE tm >= 1704844800 AND tm < 1705449600 AND resource_id IN (SELECT n_regionkey FROM nation)")
def events_window(s, d):
    wanted = _cols(table(s, d, "nation"), resource_id="CAST(n_regionkey AS BIGINT)")
    return reads.events_of(X.events(s, d), since=1704844800.0, until=1705449600.0, resources=wanted).select("id", "student_id", "resource_id", "event_type")


@query("SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'lecture' ELSE 'video' END AS source_type, user_id % 50 AS resource_id FROM events WHERE user_id % 50 IN (SELECT CASE WHEN n_regionkey < 2 THEN n_nationkey END FROM nation) AND user_id % 3 = 0 OR user_id % 3 > 0 AND user_id % 50 IN (SELECT CASE WHEN n_regionkey >= 2 THEN n_nationkey END FROM nation WHERE n_regionkey >= 2)")
def resource_events(s, d):
    facts = reads.keyed(_cols(table(s, d, "events"), id="event_id", lecture_id="CASE WHEN user_id % 3 = 0 THEN user_id % 50 END", video_id="CASE WHEN user_id % 3 > 0 THEN user_id % 50 END"))
    wanted = reads.keyed(_cols(table(s, d, "nation"), lecture_id="CASE WHEN n_regionkey < 2 THEN CAST(n_nationkey AS BIGINT) END", video_id="CASE WHEN n_regionkey >= 2 THEN CAST(n_nationkey AS BIGINT) END")).select(*reads.RESOURCE)
    return reads.events_of(facts, resources=wanted).select("id", *reads.RESOURCE)


@query(f"WITH {ST} SELECT 'lecture' AS source_type, p_partkey AS resource_id, p_partkey % 25 AS course_id, p_name AS title, coalesce(end_ts, 0)::DOUBLE AS duration FROM part LEFT JOIN st ON source_type = 'lecture' AND resource_id = p_partkey UNION ALL SELECT 'video', s_suppkey, s_nationkey, s_name, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END, end_ts, 0)::DOUBLE FROM supplier LEFT JOIN st ON source_type = 'video' AND resource_id = s_suppkey")
def course_resources(s, d):
    return reads.resources(_lectures(s, d), _videos(s, d), _chunks(s, d))


@query(f"WITH {ST}, a AS (SELECT o_orderkey AS assignment_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS lecture_id, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 100 END AS video_id FROM orders) SELECT assignment_id, CASE WHEN lecture_id IS NOT NULL THEN 'lecture' ELSE 'video' END AS source_type, coalesce(lecture_id, video_id) AS resource_id, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END, end_ts, 0)::DOUBLE AS duration FROM a LEFT JOIN supplier ON s_suppkey = video_id LEFT JOIN st ON lecture_id IS NOT NULL AND source_type = 'lecture' AND resource_id = lecture_id OR video_id IS NOT NULL AND source_type = 'video' AND resource_id = video_id")
def assignment_durations(s, d):
    given = _cols(table(s, d, "orders"), assignment_id="o_orderkey", lecture_id="CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END", video_id="CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 100 END")
    return reads.assigned(given, _videos(s, d), _chunks(s, d)).select("assignment_id", *reads.RESOURCE, "duration")


@query("SELECT conv_id AS session_id, turn, CASE WHEN conv_id % 2 = 0 THEN conv_id % 25 ELSE s_nationkey END AS course_id, coalesce(n_name, 'غير مصنّف') AS topic FROM conversations LEFT JOIN nation ON n_nationkey = turn * 7 LEFT JOIN supplier ON conv_id % 2 = 1 AND s_suppkey = conv_id WHERE role = 'user'")
def chat_topics(s, d):
    turns = table(s, d, "conversations")
    messages = _cols(turns, session_id="conv_id", turn="turn", role="role", status="'completed'", topic_id="turn * 7")
    sessions = _cols(turns, session_id="conv_id", student_id="conv_id % 10", lecture_id="CASE WHEN conv_id % 2 = 0 THEN conv_id END", video_id="CASE WHEN conv_id % 2 = 1 THEN conv_id END").distinct()
    lectures = _cols(turns, lecture_id="conv_id", course_id="CAST(conv_id % 25 AS INT)").distinct()
    topics = _cols(table(s, d, "nation"), topic_id="CAST(n_nationkey AS BIGINT)", name="n_name")
    return reads.questions_asked(messages, sessions, lectures, _videos(s, d), topics).select("session_id", "turn", F.col("course_id").cast("bigint").alias("course_id"), "topic")


@query("WITH o AS (SELECT DISTINCT l_partkey AS q, l_suppkey AS o FROM lineitem) SELECT p_partkey AS question_id, coalesce(n_name, 'غير مصنّف') AS topic, (SELECT coalesce(string_agg(CAST(o AS VARCHAR), ',' ORDER BY o % 10, o), '') FROM o WHERE q = p_partkey) AS options FROM part LEFT JOIN nation ON n_nationkey = p_size")
def exam_question_options(s, d):
    options = _cols(table(s, d, "lineitem"), question_id="l_partkey", option_id="l_suppkey", position="l_suppkey % 10", is_key="l_suppkey % 4 = 0").distinct()
    topics = _cols(table(s, d, "nation"), topic_id="n_nationkey", name="n_name")
    out = reads.exam_questions(_cols(table(s, d, "part"), question_id="p_partkey", topic_id="p_size"), topics, options)
    return out.select("question_id", "topic", F.array_join(F.transform("options", lambda o: o.option_id.cast("string")), ",").alias("options"))


@query(f"WITH {EN} SELECT student_id, course_id, n_name AS title, r_name AS doctor FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY enrolled_at DESC, course_id) AS n FROM en) JOIN nation ON n_nationkey = course_id JOIN region ON r_regionkey = n_regionkey WHERE n = 1")
def latest_course(s, d):
    doctors = _cols(table(s, d, "region"), doctor_id="r_regionkey", name="r_name")
    return reads.latest_course(_enrolments(s, d), _courses(s, d), doctors, _as_of()).select("student_id", "course_id", "title", "doctor")


@query(f"WITH {EN} SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE EXISTS (SELECT 1 FROM en WHERE en.student_id = o_custkey AND en.course_id = s_nationkey)")
def watchable_videos(s, d):
    asked = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("video_id")).join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("student_id")), "l_orderkey")
    return reads.watchable(asked, _videos(s, d), _enrolments(s, d), _as_of()).select("l_orderkey", "l_linenumber")


@query(f"WITH {EN} SELECT DISTINCT c_custkey AS student_id, r_regionkey AS doctor_id FROM customer, region WHERE EXISTS (SELECT 1 FROM en JOIN nation ON n_nationkey = course_id WHERE student_id = c_custkey AND n_regionkey = r_regionkey) AND r_regionkey = c_custkey % 5")
def taught_students(s, d):
    asked = _cols(table(s, d, "customer"), student_id="c_custkey", doctor_id="CAST(c_custkey % 5 AS INT)")
    return reads.taught(asked, _enrolments(s, d), _courses(s, d), _as_of()).select("student_id", "doctor_id")


@query("WITH l AS (SELECT n_nationkey AS level_id, CASE WHEN n_nationkey % 2 = 0 THEN 'college' ELSE 'pre_college' END AS type FROM nation), c AS (SELECT s_suppkey AS category_id, s_nationkey AS college_stage_id, s_nationkey + 1 AS pre_college_stage_id FROM supplier WHERE s_acctbal > 0) SELECT level_id, type, (SELECT count(*) FROM c WHERE type = 'pre_college' AND pre_college_stage_id = level_id OR type = 'college' AND college_stage_id = level_id) AS categories, (SELECT count(*) FROM c JOIN part ON p_partkey % 100 = category_id AND p_size > 10 WHERE type = 'pre_college' AND pre_college_stage_id = level_id OR type = 'college' AND college_stage_id = level_id) AS courses FROM l")
def level_members(s, d):
    levels = _cols(table(s, d, "nation"), level_id="n_nationkey", type="CASE WHEN n_nationkey % 2 = 0 THEN 'college' ELSE 'pre_college' END")
    categories = _cols(table(s, d, "supplier"), category_id="s_suppkey", is_active="s_acctbal > 0", college_stage_id="s_nationkey", pre_college_stage_id="s_nationkey + 1")
    return reads.level_members(levels, categories, {"courses": _cols(table(s, d, "part"), category_id="p_partkey % 100", status="CASE WHEN p_size > 10 THEN 'published' ELSE 'draft' END")})


@query("WITH l AS (SELECT p_size || '/' || p_brand AS guid, min(p_partkey) AS lecture_id FROM part GROUP BY 1 HAVING count(*) = 1), v AS (SELECT s_suppkey % 60 || '/' || 'Brand#1' || s_suppkey % 5 AS guid, min(s_suppkey) AS video_id FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT lecture_id, video_id FROM l JOIN v USING (guid)")
def guid_bridge(s, d):
    return reads.bridged(_cols(table(s, d, "part"), lecture_id="p_partkey", guid="concat(p_size, '/', p_brand)"), _cols(table(s, d, "supplier"), video_id="s_suppkey", guid="concat(s_suppkey % 60, '/', 'Brand#1', s_suppkey % 5)"))


@query("SELECT p_partkey AS lecture_id, n_regionkey AS doctor_id, CASE WHEN p_size % 6 < 5 THEN p_size % 6 END IS DISTINCT FROM n_regionkey AS changed FROM part JOIN nation ON n_nationkey = p_partkey % 25")
def course_doctor(s, d):
    lectures = _lectures(s, d).join(_cols(table(s, d, "part"), lecture_id="p_partkey", doctor_id="CASE WHEN p_size % 6 < 5 THEN p_size % 6 END"), "lecture_id")
    return reads.with_doctor_of_course(lectures, _courses(s, d)).select("lecture_id", "doctor_id", "changed")


@query(f"WITH {X.RS}, n AS (SELECT student_id, question_id AS item, count(*) AS n, min({{'a': day, 'b': response_id}}) AS f FROM rs WHERE NOT is_correct GROUP BY 1, 2 HAVING count(*) > 1), p AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY n DESC, f, item) AS place FROM n) SELECT student_id, item, n, CAST(place AS INT) AS place FROM p WHERE place <= 5")
def repeated_errors(s, d):
    wrong = X.responses(s, d).filter("NOT is_correct").withColumn("item", F.col("question_id"))
    return reads.top_repeated(wrong, ["student_id"], "item", ["day", "response_id"])


@query("WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'skipped' ELSE 'answered' END AS outcome, l_returnflag AS ans, l_linestatus AS sel, l_partkey AS sh, l_partkey + l_suppkey * 50 AS an, CAST(l_quantity * 100 AS BIGINT) AS rt FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN outcome = 'answered' THEN CASE WHEN l_linenumber % 2 = 0 THEN true ELSE lower(sel) = lower(ans) END END AS is_correct, CASE WHEN an < sh THEN 'answered_before_shown' WHEN outcome = 'answered' AND abs(an - sh - rt) > 1500 THEN 'response_time_mismatch' WHEN outcome = 'answered' AND rt > l_linenumber * 1000 + 1500 THEN 'over_allowed_time' END AS problem FROM a")
def graded_answers(s, d):
    x = _cols(table(s, d, "lineitem"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", outcome="CASE WHEN l_returnflag = 'R' THEN 'skipped' ELSE 'answered' END", answer="l_returnflag", selected="CASE WHEN l_linenumber % 2 = 0 THEN concat(' ', lower(l_returnflag), '\\n') ELSE l_linestatus END", shown_ms="l_partkey", answered_ms="l_partkey + l_suppkey * 50", response_ms="CAST(l_quantity * 100 AS BIGINT)", allowed_s="l_linenumber")
    return reads.graded(x).select("l_orderkey", "l_linenumber", "is_correct", "problem")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score, count(*) OVER () AS total FROM customer ORDER BY score DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 50")
def listing_page(s, d):
    rows = _cols(table(s, d, "customer"), c_custkey="c_custkey", score="CASE WHEN c_acctbal > 0 THEN c_acctbal END")
    return reads.page(rows, [F.desc_nulls_last("score"), F.asc("c_custkey")], 25, 50)


@query("SELECT c_custkey AS student_id, CASE WHEN o.k IS NULL THEN 'missing' WHEN o.n = c_nationkey THEN 'fresh' ELSE 'stale' END AS state FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON k = c_custkey")
def report_cache(s, d):
    wanted = _cols(table(s, d, "customer"), student_id="c_custkey", fingerprint="CAST(c_nationkey AS BIGINT)")
    stored = table(s, d, "orders").groupBy(F.col("o_custkey").alias("student_id")).agg(F.count(F.lit(1)).alias("fingerprint"), F.sum("o_totalprice").alias("payload"))
    return reads.cache_state(wanted, stored, ["student_id"]).select("student_id", "state")


def _exam(s, d):
    """Cohort, sittings, responses and questions of the five exams; orders are sittings, and every seventh student is no member."""
    responses = X.responses(s, d).withColumns({"answered": F.col("response_s") > 2, "skipped": F.col("response_s") <= 1, "timed_out": F.col("response_s") >= 49})
    sittings = _cols(table(s, d, "orders"), exam_id="o_orderkey % 5", student_id="o_custkey", sitting_id="o_orderkey", attempt_number="o_orderkey", status="CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'O' THEN 'expired' ELSE 'started' END", started_at="CAST(0 AS DOUBLE)", submitted_at="o_totalprice", score="CAST(NULL AS DOUBLE)", max_score="CAST(600000 AS DOUBLE)", awarded_points="o_totalprice")
    cohort = sittings.filter("student_id % 7 > 0").select("exam_id", "student_id").distinct()
    # a row for each question; every section reads them, and they are looked for in all responses
    questions = stored(responses.select("exam_id", "question_id").distinct().withColumn("topic", F.col("question_id") % 6), "asked")
    return cohort, sittings, responses, questions


XM = X.RS + """, ra AS (SELECT *, CASE WHEN response_s > 2 THEN is_correct END AS ok, response_s <= 1 OR response_s >= 49 AS missed, {'a': sitting_id, 'b': attempt_number, 'c': response_id} AS k FROM rs),
 si AS (SELECT o_orderkey % 5 AS exam_id, o_custkey AS student_id, o_orderkey AS sitting_id, o_orderstatus AS st, o_totalprice AS p FROM orders),
 co AS (SELECT DISTINCT exam_id, student_id FROM si WHERE student_id % 7 > 0), qs AS (SELECT DISTINCT exam_id, question_id, question_id % 6 AS topic FROM rs),
 rk AS (SELECT *, row_number() OVER (PARTITION BY exam_id, student_id, question_id ORDER BY k) AS up, row_number() OVER (PARTITION BY exam_id, student_id, question_id ORDER BY k DESC) AS down FROM ra SEMI JOIN co USING (exam_id, student_id)),
 fa AS (SELECT exam_id, student_id, question_id, bool_or(ok) FILTER (WHERE up = 1) AS first_ok, bool_or(ok) FILTER (WHERE down = 1) AS final_ok, bool_or(missed) FILTER (WHERE down = 1) AS skipped, count(*) AS tries FROM rk GROUP BY 1, 2, 3)"""


def _pc(part, whole):
    return f"CASE WHEN {whole} > 0 THEN round_even(100.0::DOUBLE * ({part}) / ({whole}), 1) END"


_RATE = f"{_pc('count(*) FILTER (WHERE final_ok)', 'count(final_ok)')} AS accuracy, {_pc('count(*) FILTER (WHERE first_ok)', 'count(first_ok)')} AS first_accuracy"


@query(f"WITH {XM}, g AS (SELECT exam_id, student_id, count(*) AS shown, count(final_ok) AS answered, count(*) FILTER (WHERE final_ok) AS correct, {_RATE}, {_pc('count(*) FILTER (WHERE tries > 1)', 'count(*)')} AS retry_rate FROM fa GROUP BY 1, 2), z AS (SELECT exam_id, count(*) AS n FROM qs GROUP BY 1), s AS (SELECT exam_id, student_id, count(*) AS sittings, bool_or(st = 'F') AS completed, arg_max(p, {{'a': st IN ('F', 'O'), 'b': sitting_id}}) AS p FROM si GROUP BY 1, 2) SELECT exam_id, student_id, sittings, completed, coalesce(answered, 0) AS answered, coalesce(correct, 0) AS correct, CASE WHEN shown > 0 THEN {_pc('correct', 'n')} ELSE {_pc('p', '600000')} END AS score, accuracy, first_accuracy, retry_rate FROM co JOIN s USING (exam_id, student_id) JOIN z USING (exam_id) LEFT JOIN g USING (exam_id, student_id)")
def exam_report_students(s, d):
    return reports.exam_students(*_exam(s, d)).select("exam_id", "student_id", "sittings", "completed", "answered", "correct", "score", "accuracy", "first_accuracy", "retry_rate")


@query(f"WITH {XM}, t AS (SELECT *, question_id % 6 AS topic FROM fa), p AS (SELECT exam_id, topic, student_id, count(*) FILTER (WHERE tries > 1) AS again, {_pc('count(*) FILTER (WHERE final_ok)', 'count(final_ok)')} AS a FROM t GROUP BY 1, 2, 3), pp AS (SELECT exam_id, topic, count(*) AS participants, {_pc('count(*) FILTER (WHERE again > 0)', 'count(*)')} AS retry_rate, {_pc('count(*) FILTER (WHERE a < 60)', 'count(a)')} AS below_mastery FROM p GROUP BY 1, 2), r AS (SELECT exam_id, topic, CAST(sum(tries) AS BIGINT) AS attempts, {_RATE} FROM t GROUP BY 1, 2), q AS (SELECT exam_id, topic, count(*) AS questions FROM qs GROUP BY 1, 2) SELECT exam_id, CAST(topic AS VARCHAR) AS topic, questions, participants, attempts, accuracy, first_accuracy, round_even(accuracy - first_accuracy, 1) AS gain, retry_rate, below_mastery, questions >= 2 AND attempts >= 10 AS conclusive FROM q JOIN pp USING (exam_id, topic) JOIN r USING (exam_id, topic)")
def exam_report_topics(s, d):
    cohort, _, responses, questions = _exam(s, d)
    key = ["exam_id", "student_id"]
    finals = reports.final_answers(responses.join(cohort, key, "left_semi"), key)
    return reports.exam_topics(finals, questions).drop("confidence")


@query(f"WITH {XM}, g AS (SELECT *, (sum(coalesce(CAST(final_ok AS INT), 0)) OVER (PARTITION BY exam_id, student_id) - coalesce(CAST(final_ok AS INT), 0)) AS rest FROM fa) SELECT exam_id, question_id, count(*) AS shown, {_RATE}, {_pc('count(*) FILTER (WHERE skipped)', 'count(*)')} AS skip_rate, CASE WHEN count(final_ok) >= 10 THEN round(corr(CAST(final_ok AS INT), rest) FILTER (WHERE final_ok IS NOT NULL), 3) END AS discrimination FROM g GROUP BY 1, 2")
def exam_report_items(s, d):
    cohort, _, responses, questions = _exam(s, d)
    key = ["exam_id", "student_id"]
    finals = reports.final_answers(responses.join(cohort, key, "left_semi"), key)
    return reports.exam_items(finals, questions).select("exam_id", "question_id", "shown", "accuracy", "first_accuracy", "skip_rate", "discrimination")


@query(f"WITH {XM}, z AS (SELECT exam_id, count(*) AS n FROM qs GROUP BY 1), g AS (SELECT exam_id, student_id, count(*) FILTER (WHERE final_ok) AS correct FROM fa GROUP BY 1, 2), s AS (SELECT exam_id, student_id, bool_or(st = 'F') AS completed, arg_max(p, {{'a': st IN ('F', 'O'), 'b': sitting_id}}) AS p FROM si SEMI JOIN co USING (exam_id, student_id) GROUP BY 1, 2), w AS (SELECT s.exam_id, completed, CASE WHEN correct IS NOT NULL THEN {_pc('correct', 'n')} ELSE {_pc('p', '600000')} END AS score FROM s JOIN z USING (exam_id) LEFT JOIN g USING (exam_id, student_id)), v AS (SELECT exam_id, count(*) AS cohort, count(*) FILTER (WHERE completed) AS completed, {_pc('count(*) FILTER (WHERE completed)', 'count(*)')} AS completion, round_even(median(score), 1) AS median_score, {_pc('count(*) FILTER (WHERE score >= 60)', 'count(score)')} AS pass_rate FROM w GROUP BY 1), r AS (SELECT exam_id, {_RATE}, CAST(sum(tries) AS BIGINT) AS attempts, {_pc('count(DISTINCT student_id) FILTER (WHERE tries > 1)', '(SELECT count(*) FROM co WHERE co.exam_id = fa.exam_id)')} AS needing_retry FROM fa GROUP BY 1), o AS (SELECT exam_id, count(*) AS from_outsiders FROM rs WHERE student_id % 7 = 0 GROUP BY 1) SELECT exam_id, n AS questions, cohort, completed, completion, median_score, pass_rate, accuracy, first_accuracy, attempts, needing_retry, coalesce(from_outsiders, 0) AS from_outsiders FROM z JOIN v USING (exam_id) JOIN r USING (exam_id) LEFT JOIN o USING (exam_id)")
def exam_report_summary(s, d):
    return reports.exam_summary(*_exam(s, d)).select("exam_id", "questions", "cohort", "completed", "completion", "median_score", "pass_rate", "accuracy", "first_accuracy", "attempts", "needing_retry", "from_outsiders")


def _durations(s, d):
    return s.range(X.RESOURCES).select(F.col("id").alias("resource_id"), (F.col("id") * 900.0).alias("duration"))


LINES = f"""{X.MERGED}, pr AS (SELECT student_id, resource_id, session_id, round_even(sum(elapsed), 1) AS watch, round_even(sum(away), 1) AS away, round_even(max(tm) - min(tm), 1) AS session, count(*) FILTER (WHERE event_type = 'pause') AS pauses, count(seek) AS seeks, bool_or(event_type = 'complete') AS completed, min(tm) AS first FROM rp GROUP BY 1, 2, 3),
 cv AS (SELECT student_id, resource_id, sum("end" - "start") AS covered FROM mg GROUP BY 1, 2),
 ln AS (SELECT student_id, resource_id, count(*) AS sessions, sum(watch) AS watch, sum(away) AS away, sum(session) AS session, CAST(sum(seeks) AS BIGINT) AS seeks, CASE WHEN resource_id > 0 THEN least(coalesce(any_value(covered), 0), resource_id * 900) ELSE 0 END AS covered FROM pr LEFT JOIN cv USING (student_id, resource_id) GROUP BY 1, 2)"""


@query(f"WITH {LINES} SELECT student_id, resource_id, sessions, round(watch, 1) AS watch, round(session, 1) AS session, seeks, round(covered, 3) AS covered, round(100 * watch / nullif(resource_id * 900, 0), 0) AS watch_rate, round(100 * away / nullif(session, 0), 0) AS away_rate FROM ln")
def lecture_lines(s, d):
    x = reports.lecture_lines(X.events(s, d), _durations(s, d), max_gap=X.GAP)
    return x.select("student_id", "resource_id", "sessions", F.round("watch", 1).alias("watch"), F.round("session", 1).alias("session"), "seeks", F.round("covered", 3).alias("covered"), F.round(100 * F.col("watch") / F.nullif("duration", F.lit(0.0)), 0).alias("watch_rate"), F.round(100 * F.col("away") / F.nullif("session", F.lit(0.0)), 0).alias("away_rate"))


@query(f"WITH {LINES}, rg AS (SELECT DISTINCT user_id AS student_id, r AS resource_id, r * 900.0::DOUBLE AS duration FROM events, (SELECT unnest(range({X.RESOURCES})) AS r)) SELECT student_id, count(*) AS registered, count(sessions) AS opened, count(*) - count(sessions) AS untouched, count(*) FILTER (WHERE duration = 0) AS without_length, sum(duration) AS material, round(coalesce(sum(watch), 0), 0) AS watch, CAST(coalesce(sum(seeks), 0) AS BIGINT) AS seeks, round(100 * coalesce(sum(covered), 0) / sum(duration), 0) AS coverage FROM rg LEFT JOIN ln USING (student_id, resource_id) GROUP BY 1")
def week_totals(s, d):
    facts = X.events(s, d)
    registered = facts.select("student_id").distinct().crossJoin(F.broadcast(_durations(s, d)))  # seven rows
    x = reports.week_sums(registered, reports.lecture_lines(facts, _durations(s, d), max_gap=X.GAP))
    # times of sittings have one place, so their sum has too; covered seconds have any
    return x.select("student_id", "registered", "opened", (F.col("registered") - F.col("opened")).alias("untouched"), "without_length", "material", F.round(rounded(F.col("watch")), 0).alias("watch"), "seeks", F.round(100 * F.col("covered") / F.col("material"), 0).alias("coverage"))


@query(f"WITH {LINES} SELECT student_id, CAST(timezone('Africa/Cairo', timezone('UTC', make_timestamp(CAST(first * 1000000 AS BIGINT)))) AS DATE) AS day, round(sum(watch), 1) AS watch FROM pr GROUP BY 1, 2")
def watch_by_local_day(s, d):
    return reports.watch_by_day(X.events(s, d), X.GAP, "Africa/Cairo").withColumn("watch", F.round("watch", 1))


def _evidence(s, d):
    rows = X.responses(s, d).withColumn("topic", F.col("topic").cast("string"))
    return rows.filter("attempt_number < 4"), rows.filter("attempt_number >= 4").withColumn("answered", F.col("response_s") > 2)


@query(f"WITH {X.RS}, q AS (SELECT student_id, topic, count(*) AS questions, count(*) FILTER (WHERE ok) AS k FROM (SELECT student_id, topic, question_id, bool_or(is_correct) AS ok FROM rs WHERE attempt_number < 4 GROUP BY 1, 2, 3) GROUP BY 1, 2), c AS (SELECT student_id, topic, count(*) FILTER (WHERE response_s > 2) AS checkpoints, count(*) FILTER (WHERE response_s > 2 AND is_correct) AS k FROM rs WHERE attempt_number >= 4 GROUP BY 1, 2), j AS (SELECT student_id, topic, coalesce(questions, 0) AS questions, coalesce(checkpoints, 0) AS checkpoints, {_pc('q.k', 'questions')} AS a, {_pc('c.k', 'checkpoints')} AS b FROM q FULL JOIN c USING (student_id, topic)), m AS (SELECT *, CASE WHEN topic < 3 THEN topic * 10.0 END AS v FROM j) SELECT student_id, CAST(topic AS VARCHAR) AS topic, questions, checkpoints, a AS quiz_accuracy, b AS checkpoint_accuracy, round((coalesce(a * 0.6, 0) + coalesce(b * 0.35, 0) + coalesce(v * 0.05, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.35 END + CASE WHEN v IS NULL THEN 0 ELSE 0.05 END), 0) AS score FROM m WHERE a IS NOT NULL OR b IS NOT NULL")
def topic_mastery(s, d):
    quiz, checkpoints = _evidence(s, d)
    keys = ["student_id", "topic"]
    coverage = X.responses(s, d).filter("topic < 3").select("student_id", F.col("topic").cast("string").alias("topic"), (F.col("topic") * 10.0).alias("coverage")).distinct()
    x = reports.mastery_by(keys, quiz, checkpoints, coverage).filter("score IS NOT NULL")
    weighed = reports.mastery(F.col("quiz_accuracy"), F.col("checkpoint_accuracy"), F.col("coverage"))
    return x.select(*keys, "questions", "checkpoints", "quiz_accuracy", "checkpoint_accuracy", F.round(weighed, 0).alias("score"))


WEEKS = X.RP + """, sw AS (SELECT student_id, resource_id, date_trunc('week', day)::DATE AS week, "start", "end" FROM rp WHERE "end" > "start"),
 w1 AS (SELECT *, max("end") OVER (PARTITION BY student_id, resource_id, week ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sw),
 w2 AS (SELECT *, sum(CASE WHEN "start" <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY student_id, resource_id, week ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM w1),
 w3 AS (SELECT student_id, resource_id, week, max("end") - min("start") AS len FROM w2 GROUP BY student_id, resource_id, week, island),
 wc AS (SELECT student_id, week, sum(seen) AS seen FROM (SELECT student_id, week, least(sum(len), resource_id * 900) AS seen FROM w3 WHERE resource_id > 0 GROUP BY student_id, week, resource_id) GROUP BY 1, 2),
 we AS (SELECT *, date_trunc('week', day)::DATE AS week FROM ev)"""


@query(f"WITH {WEEKS}, b AS (SELECT student_id, week, count(DISTINCT day) AS active_days, count(DISTINCT {{'a': resource_id, 'b': session_id}}) AS sessions FROM we GROUP BY 1, 2), q AS (SELECT student_id, week, {_pc('count(*) FILTER (WHERE ok)', 'count(*)')} AS quiz FROM (SELECT student_id, week, id % 5 AS question_id, bool_or(video_ts > 50) AS ok FROM we WHERE event_type = 'play' GROUP BY 1, 2, 3) GROUP BY 1, 2), c AS (SELECT student_id, week, {_pc('count(*) FILTER (WHERE video_ts > 50)', 'count(*) FILTER (WHERE video_ts > 20)')} AS cp FROM we WHERE event_type = 'seek' GROUP BY 1, 2), j AS (SELECT b.*, quiz, cp, {_pc('coalesce(seen, 0)', '18900')} AS cov FROM b LEFT JOIN wc USING (student_id, week) LEFT JOIN q USING (student_id, week) LEFT JOIN c USING (student_id, week)) SELECT student_id, week, active_days, sessions, quiz AS quiz_accuracy, cp AS checkpoint_accuracy, round(cov, 0) AS coverage, CASE WHEN quiz IS NOT NULL OR cp IS NOT NULL THEN round_even((coalesce(quiz * 0.6, 0) + coalesce(cp * 0.35, 0) + cov * 0.05) / (CASE WHEN quiz IS NULL THEN 0 ELSE 0.6 END + CASE WHEN cp IS NULL THEN 0 ELSE 0.35 END + 0.05), 1) END AS mastery FROM j")
def period_metrics(s, d):
    facts = X.events(s, d).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    registered = facts.select("student_id").distinct().crossJoin(F.broadcast(_durations(s, d)))  # seven rows
    quiz = facts.filter("event_type = 'play'").select("student_id", "week", (F.col("id") % 5).alias("question_id"), (F.col("video_ts") > 50).alias("is_correct"))
    checkpoints = facts.filter("event_type = 'seek'").select("student_id", "week", (F.col("video_ts") > 20).alias("answered"), (F.col("video_ts") > 50).alias("is_correct"))
    return reports.period_metrics(facts, quiz, checkpoints, registered, max_gap=X.GAP).withColumn("coverage", F.round("coverage", 0))


@query("SELECT conv_id, CAST(8 + sum(8 + greatest(1, (octet_length(encode(role)) + 1) // 2) + greatest(1, (octet_length(encode(coalesce(text, ''))) + 1) // 2)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def message_list_tokens(s, d):
    # what messages_estimate adds up, as a sum over the conversation's rows
    each = 8 + token_estimate(F.col("role")) + token_estimate(F.col("text"))
    return table(s, d, "conversations").groupBy("conv_id").agg((F.sum(each) + 8).alias("tokens"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[\\x{600}-\\x{6ff}\\x{750}-\\x{77f}\\x{8a0}-\\x{8ff}]') AS arabic, regexp_matches(coalesce(text, ''), '(?:^|\\s)(?:" + "|".join(EGYPTIAN) + ")(?:\\s|$|[؟?!،,.])') AS egyptian FROM documents")
def script_of_texts(s, d):
    return table(s, d, "documents").select("doc_id", uses_arabic(F.col("text")).alias("arabic"), uses_egyptian(F.col("text")).alias("egyptian"))


@query("WITH h AS (SELECT p_partkey, list_sort([p_size * 20, 240 + p_size, 720]) AS h, p_size * 15 AS w FROM part) SELECT p_partkey, coalesce(list_max([x FOR x IN h IF x <= w]), list_min(h)) AS height FROM h")
def rendition_pick(s, d):
    listed = F.expr("concat(p_size * 20, 'p, ', 240 + p_size, 'P,720,none')")
    return table(s, d, "part").select("p_partkey", height_at_or_below(renditions(listed), F.col("p_size") * 15).alias("height"))


@query("SELECT event_id, CAST(ceil(epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) / 1e6 - epoch_us(ts) / 1e6) AS BIGINT) AS retry_after, CAST(timezone('UTC', timezone('Africa/Cairo', CAST(CAST(ts AS DATE) AS TIMESTAMP))) AS VARCHAR) AS midnight FROM events")
def quota_reset(s, d):
    midnight = local_midnight(F.col("ts").cast("date"), "Africa/Cairo")
    return table(s, d, "events").select("event_id", seconds_to_midnight(F.col("ts")).alias("retry_after"), midnight.cast("string").alias("midnight"))


@query("SELECT l_shipmode AS kind, n, rtfx FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, round_even(sum(l_quantity) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END), 0), 1) AS rtfx FROM lineitem GROUP BY 1)")
def transcription_speed(s, d):
    work = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_linenumber"))
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"), real_time_factor(F.sum("l_quantity"), F.sum(work)).alias("rtfx"))


@query("WITH k AS (SELECT label, vec_id % 11 AS t, arg_min(vec_id, vec_id) AS v FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT vec_id, label, vec_id % 11 AS t FROM embeddings WHERE vec_id % 2 = 1 AND label < 5) SELECT label AS video_id, vec_id AS position, 'kept' AS made FROM embeddings WHERE vec_id % 2 = 0 AND label NOT IN (SELECT label FROM n) UNION ALL SELECT label, vec_id, CASE WHEN v IS NULL THEN 'new' ELSE 'reused' END FROM n LEFT JOIN k USING (label, t)")
def chunk_ingest(s, d):
    rows = table(s, d, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("position"), (F.col("vec_id") % 11).cast("string").alias("text"), "embedding")
    stored, new = rows.filter("position % 2 = 0"), rows.filter("position % 2 = 1 AND video_id < 5").drop("embedding")
    made = new.select("video_id", "text", F.array(F.lit(-1.0).cast("float")).alias("embedding"))
    out = retrieval.ingested(new, stored, made)
    kind = F.when(F.col("position") % 2 == 0, "kept").when(F.size("embedding") == 1, "new").otherwise("reused")
    return out.select("video_id", "position", kind.alias("made"))
