import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.functions import height_at_or_below, messages_estimate, renditions, seconds_to_midnight, uses_arabic, uses_egyptian
from lectern.operators import reads, reports, retrieval

RESPONSE = "exam_id int, student_id int, question_id int, sitting_id int, attempt_number int, response_id int, is_correct boolean, answered boolean, response_s double, skipped boolean, timed_out boolean"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_ranges_are_half_open_and_null_keys_match_nothing(spark):
    x = spark.createDataFrame([(1, 1, 0.0), (2, 1, 5.0), (3, None, 5.0), (4, 1, 10.0)], "id int, resource_id int, at double")
    wanted = spark.createDataFrame([(1,), (1,), (None,)], "resource_id int")
    assert rows(reads.events_of(x, 0.0, 10.0, resources=wanted), "id") == [(1,), (2,)]
    assert rows(reads.events_of(x, since=5.0), "id") == [(2,), (3,), (4,)]
    assert reads.events_of(x.limit(0), 0.0, resources=wanted).count() == 0


def test_resources_have_one_key_and_a_duration(spark):
    lectures = spark.createDataFrame([(1, 9, "a"), (2, 9, "b")], "lecture_id int, course_id int, title string")
    videos = spark.createDataFrame([(1, 9, "v", 50.0), (2, 9, "w", None)], "video_id int, course_id int, title string, duration_seconds double")
    chunks = spark.createDataFrame([(1, None, 30.0), (1, None, 40.0), (None, 2, 7.0), (None, None, 99.0)], "lecture_id int, video_id int, end_ts double")
    assert rows(reads.resources(lectures, videos, chunks), "source_type", "resource_id", "duration") == [("lecture", 1, 40.0), ("lecture", 2, 0.0), ("video", 1, 50.0), ("video", 2, 7.0)]
    given = spark.createDataFrame([(1, 1, None), (2, None, 2), (3, None, None)], "id int, lecture_id int, video_id int")
    assert rows(reads.assigned(given, videos, chunks), "id", "source_type", "resource_id", "duration") == [(1, "lecture", 1, 40.0), (2, "video", 2, 7.0), (3, None, None, 0.0)]
    assert rows(given.filter(reads.one_parent()), "id") == [(1,), (2,)]


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_watchable_rows_meet_the_courses_of_their_video(spark):
    asked = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (3, 2, 10), (4, 1, 11), (4, 1, 11), (5, None, 10), (6, 3, 12)], "id int, student_id int, video_id int")
    videos = spark.createDataFrame([(10, 5), (11, 5), (11, 6), (12, None), (13, 5)], "video_id int, course_id int")
    enrolments = spark.createDataFrame([(1, 5, "active", None), (1, 6, "active", None), (2, 5, "ended", None), (3, None, "active", None)], "student_id int, course_id int, status string, expires_at timestamp")
    got = reads.watchable(asked, videos, enrolments, F.current_timestamp())
    assert sorted(got.collect()) == [(1, 1, 10), (2, 1, 10), (4, 1, 11), (4, 1, 11)]
    # enrolments alone stand against the rows asked for: joined to the videos first, they are students times videos
    semi = next(p for p in nodes(got._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Join" and p.joinType().toString() == "LeftSemi")
    assert not [p for p in nodes(semi.children().apply(1)) if p.nodeName() == "Join"]


def test_guids_of_several_lectures_make_no_bridge(spark):
    lectures = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, None)], "lecture_id int, guid string")
    videos = spark.createDataFrame([(7, "x"), (8, "y"), (9, None)], "video_id int, guid string")
    assert rows(reads.bridged(lectures, videos), "lecture_id", "video_id") == [(1, 7)]


def test_doctors_follow_their_course(spark):
    lectures = spark.createDataFrame([(1, 1, 5), (2, 1, None), (3, 9, 5)], "id int, course_id int, doctor_id int")
    courses = spark.createDataFrame([(1, 5)], "course_id int, doctor_id int")
    assert rows(reads.with_doctor_of_course(lectures, courses), "id", "doctor_id", "changed") == [(1, 5, False), (2, 5, True), (3, 5, False)]


def test_repeated_items_break_ties_by_first_occurrence(spark):
    x = spark.createDataFrame([(i, c) for i, c in enumerate("bbaaccddeeffg")] + [(20, None), (21, None)], "at int, item string")
    out = reads.top_repeated(x.withColumn("k", F.lit(1)), ["k"], "item", ["at"])
    assert [r.item for r in out.orderBy("place").collect()] == list("bacde")


def test_answers_are_graded_and_latency_checked(spark):
    shape = "id int, outcome string, selected string, answer string, shown_ms bigint, answered_ms bigint, response_ms bigint, allowed_s double"
    x = spark.createDataFrame([(1, "answered", " Ab\n", "aB", 0, 1000, 2500, 5.0), (2, "answered", "x", "y", 0, 1000, 2501, 5.0), (3, "answered", "x", "x", 0, 6501, 6501, 5.0), (4, "skipped", None, "x", 9, 3, None, 5.0), (5, "answered", None, "x", None, None, None, None)], shape)
    assert rows(reads.graded(x), "id", "is_correct", "problem") == [(1, True, None), (2, False, "response_time_mismatch"), (3, True, "over_allowed_time"), (4, None, "answered_before_shown"), (5, None, None)]


def test_pages_carry_the_total(spark):
    x = spark.createDataFrame([(i, None if i == 3 else i) for i in range(6)], "id int, v int")
    assert [(r.id, r.total) for r in reads.page(x, [F.desc_nulls_last("v")], 3, 3).collect()] == [(1, 6), (0, 6), (3, 6)]


def exam_data(spark):
    """Twelve students; the first two of four questions are topic a, the others b; student 12 sits without an answer."""
    out, n = [], 0
    for s in range(1, 10):
        for q in range(1, 5):
            tries = [s % 2 == 0, True] if q == 1 and s < 4 else [s >= 2 * q]
            for k, ok in enumerate(tries):
                n += 1
                out.append((1, s, q, s, k + 1, n, ok, True, 10.0 * q, False, False))
    out.append((1, 10, 1, 10, 1, 900, None, False, None, True, False))
    out.append((1, 99, 1, 99, 1, 901, True, True, 1.0, False, False))
    responses = spark.createDataFrame(out, RESPONSE)
    cohort = spark.createDataFrame([(1, s) for s in range(1, 13)] + [(1, 1)], "exam_id int, student_id int")
    sittings = spark.createDataFrame([(1, s, s, 1, "submitted" if s < 10 else "started", 0.0, 60.0 if s < 10 else None, None, 8.0, 6.0 if s == 11 else None) for s in range(1, 12)], "exam_id int, student_id int, sitting_id int, attempt_number int, status string, started_at double, submitted_at double, score double, max_score double, awarded_points double")
    questions = spark.createDataFrame([(1, q, "a" if q < 3 else None) for q in range(1, 5)], "exam_id int, question_id int, topic string")
    return cohort, sittings, responses, questions


def test_exam_report(spark):
    cohort, sittings, responses, questions = exam_data(spark)
    people = {r.student_id: r for r in reports.exam_students(cohort, sittings, responses, questions).collect()}
    assert len(people) == 12
    # of student s, questions q with s >= 2q; question 1 is solved by a second try below 4
    assert [people[s].score for s in (1, 2, 5, 9)] == [25.0, 25.0, 50.0, 100.0]
    assert (people[1].retries, people[1].retry_rate, people[1].first_accuracy, people[1].accuracy) == (1, 25.0, 0.0, 25.0)
    assert (people[10].score, people[10].accuracy, people[10].completed) == (0.0, None, False)
    assert people[11].score == 75.0 and people[12].score is None and people[12].sittings == 0
    assert (people[9].support, people[1].support, people[12].support) == ("STRONG_PERFORMANCE", "NEEDS_SUPPORT", "INCOMPLETE_OR_INSUFFICIENT")
    one = reports.exam_summary(cohort, sittings, responses, questions).collect()[0]
    assert (one.questions, one.cohort, one.started, one.completed, one.from_outsiders, one.attempts) == (4, 12, 11, 9, 1, 40)
    assert (one.participation, one.completion, one.abandonment, one.needing_retry) == (91.7, 81.8, 18.2, 27.3)
    scores = sorted(p.score for p in people.values() if p.score is not None)
    assert one.pass_rate == round(100 * sum(s >= 60 for s in scores) / len(scores), 1)
    assert one.median_score == scores[len(scores) // 2] and one.gain == round(one.accuracy - one.first_accuracy, 1)
    finals = reports.final_answers(responses.filter("student_id < 99"), ["exam_id", "student_id"])
    topics = {r.topic: r for r in reports.exam_topics(finals, questions).collect()}
    assert topics["a"].questions == 2 and topics["a"].participants == 10 and topics["a"].retry_rate == 30.0 and topics["a"].conclusive
    assert topics["a"].below_mastery == round(100 * 3 / 9, 1)
    assert all(r.discrimination is None for r in reports.exam_items(finals, questions).collect())


def test_item_rest_over_many_exams_is_the_correlation(spark):
    import numpy as np

    draw = np.random.default_rng(3).random((2, 30, 5)) < 0.6
    out = [(e, s, q, s, 1, s * 10 + q, bool(draw[e, s, q]), True, 1.0, False, False) for e in range(2) for s in range(30) for q in range(5)]
    finals = reports.final_answers(spark.createDataFrame(out, RESPONSE), ["exam_id", "student_id"])
    questions = spark.createDataFrame([(e, q, None) for e in range(2) for q in range(5)], "exam_id int, question_id int, topic string")
    for r in reports.exam_items(finals, questions).collect():
        x = draw[r.exam_id].astype(float)
        own = x[:, r.question_id]
        assert r.discrimination == pytest.approx(np.corrcoef(own, x.sum(axis=1) - own)[0, 1], abs=6e-4)


def test_empty_exam_tables(spark):
    cohort, sittings, responses, questions = (x.limit(0) for x in exam_data(spark))
    assert reports.exam_students(cohort, sittings, responses, questions).count() == 0
    assert reports.exam_summary(cohort, sittings, responses, questions).count() == 0


def test_week_of_a_student(spark):
    shape = "student_id int, resource_id int, session_id string, id int, event_type string, video_ts double, at double, rate double"
    events = spark.createDataFrame([(1, 1, "a", 1, "play", 0.0, 0.0, 1.0), (1, 1, "a", 2, "pause", 60.0, 60.0, 1.0), (1, 1, "a", 3, "play", 60.0, 100.0, 1.0), (1, 1, "a", 4, "complete", 100.0, 140.0, 1.0), (1, 2, "b", 5, "play", 0.0, 79200.0, 1.0), (1, 2, "b", 6, "pause", 30.0, 79230.0, 1.0)], shape)
    registered = spark.createDataFrame([(1, 1, 200.0), (1, 2, None), (1, 3, 100.0)], "student_id int, resource_id int, duration double")
    lines = reports.lecture_lines(events, registered.select("resource_id", "duration"))
    first = lines.filter("resource_id = 1").collect()[0]
    assert (first.watch, first.session, first.pauses, first.covered, first.coverage, first.completed) == (100.0, 140.0, 1, 100.0, 50.0, True)
    assert lines.filter("resource_id = 2").collect()[0].coverage is None
    week = reports.week_totals(registered, lines).collect()[0]
    assert (week.registered, week.opened, week.untouched, week.without_length, week.material, week.watch, week.coverage) == (3, 2, 1, 1, 300.0, 130.0, 33.3)
    # 22:00 UTC is the next day in Cairo
    assert [str(d) for d, _ in rows(reports.watch_by_day(events, zone="Africa/Cairo"), "day", "watch")] == ["1970-01-01", "1970-01-02"]
    weekly = events.withColumns({"week": F.lit(1), "day": F.lit("1970-01-01").cast("date")})
    quiz = spark.createDataFrame([(1, 1, 1, True), (1, 1, 2, None)], "student_id int, week int, question_id int, is_correct boolean")
    checks = spark.createDataFrame([(1, 1, True, True), (1, 1, False, None)], "student_id int, week int, answered boolean, is_correct boolean")
    period = reports.period_metrics(weekly, quiz, checks, registered).collect()[0]
    assert (period.active_days, period.sessions, period.coverage, period.quiz_accuracy, period.checkpoint_accuracy) == (1, 2, 33.3, 50.0, 100.0)
    assert period.mastery == round((50 * 0.6 + 100 * 0.35 + 33.3 * 0.05) / 1.0, 1)


def test_coverage_alone_is_no_mastery(spark):
    none = spark.createDataFrame([], "topic string, question_id int, is_correct boolean")
    checks = spark.createDataFrame([], "topic string, answered boolean, is_correct boolean")
    seen = spark.createDataFrame([("a", 90.0)], "topic string, coverage double")
    out = reports.mastery_by(["topic"], none, checks, seen).collect()[0]
    assert (out.score, out.confidence, out.coverage) == (None, "LOW", 90.0)


def test_known_weights_add_up_as_decimals(spark):
    # (50 * 0.35 + 4.8 * 0.05) / 0.4 is under 44.35, over the sum of the doubles 0.35 and 0.05 it is not
    none = spark.createDataFrame([], "k int, question_id int, is_correct boolean")
    checks = spark.createDataFrame([(1, True, True), (1, True, False)], "k int, answered boolean, is_correct boolean")
    seen = spark.createDataFrame([(1, 4.8)], "k int, coverage double")
    assert reports.mastery_by(["k"], none, checks, seen).collect()[0].score == 44.3


def test_rates_rest_on_sums_that_are_not_rounded(spark):
    lines = spark.createDataFrame([(1, 1, 1, 5.0, 4.96, 10.0, 4.96, 0, 0, False)], "student_id int, resource_id int, sessions int, watch double, covered double, session double, away double, pauses int, seeks int, completed boolean").withColumn("duration", F.lit(10.0))
    registered = spark.createDataFrame([(1, 1, 10.0)], "student_id int, resource_id int, duration double")
    week = reports.week_totals(registered, lines).collect()[0]
    assert (week.covered, week.coverage, week.away_rate) == (5.0, 49.6, 49.6)


def test_small_functions(spark):
    one = spark.range(1)
    pick = lambda *c: tuple(one.select(*c).collect()[0])
    heights = renditions(F.lit("720p, 240P,none,360"))
    assert pick(heights, height_at_or_below(heights, F.lit(500)), height_at_or_below(heights, F.lit(100)), height_at_or_below(renditions(F.lit(None).cast("string")), F.lit(1))) == ([240, 360, 720], 360, 240, None)
    assert pick(uses_arabic(F.lit("مرحبا")), uses_arabic(F.lit(None).cast("string")), uses_egyptian(F.lit("ده إيه؟")), uses_egyptian(F.lit("مشروع"))) == (True, False, True, False)
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit("abcd").alias("content")))
    assert pick(messages_estimate(messages), messages_estimate(messages, F.lit("ab"))) == (20, 21)
    assert pick(seconds_to_midnight(F.expr("TIMESTAMP_NTZ'2024-01-01 23:59:59.5'")), seconds_to_midnight(F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))) == (1, 86400)


def test_ingest_replaces_a_video_and_reuses_equal_texts(spark):
    shape = "video_id int, position int, text string"
    stored = spark.createDataFrame([(1, 0, "a", [1.0]), (1, 1, "b", [2.0]), (2, 0, "a", [3.0])], f"{shape}, embedding array<double>")
    new = spark.createDataFrame([(1, 0, "b"), (1, 1, "c"), (1, 2, "c"), (1, 3, None)], shape)
    made = spark.createDataFrame([(1, "c", [9.0])], "video_id int, text string, embedding array<double>")
    assert rows(retrieval.ingested(new, stored, made), "video_id", "position", "embedding") == [(1, 0, [2.0]), (1, 1, [9.0]), (1, 2, [9.0]), (1, 3, None), (2, 0, [3.0])]


def test_entries_import_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1]).returncode == 0
