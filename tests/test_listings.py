from datetime import datetime

from pyspark.sql import functions as F

from lectern.operators import integrity, listings


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def day(n):
    return datetime(2026, 1, n)


def tables(spark, **other):
    kinds = {
        "users": "id int, role string",
        "courses": "id int",
        "lectures": "id int, course_id int",
        "enrolments": "id int, student_id int, course_id int",
        "events": "id int, student_id int, lecture_id int, event_type string, video_ts double, session_id string",
        "chunks": "id int, lecture_id int, start_ts double, end_ts double",
        "questions": "id int, lecture_id int, options string, correct_option string",
        "attempts": "id int, student_id int, question_id int",
        "reports": "id int, student_id int, course_id int, kind string, lecture_id int",
        "notifications": "id int, user_id int, report_id int",
    }
    return {n: spark.createDataFrame(other.get(n, []), k) for n, k in kinds.items()}


def test_each_check_finds_its_offenders_alone(spark):
    four = '["A one", "b two", "C", "D"]'
    t = tables(
        spark,
        users=[(1, "student"), (2, "doctor"), (3, "guest"), (4, None)],
        courses=[(1,), (2,)],
        lectures=[(1, 1), (2, None), (3, 2)],
        enrolments=[(1, 1, 1), (2, 1, 1), (3, 9, 1), (4, 1, None), (5, 2, 2)],
        events=[(1, 1, 1, "play", 0.0, "s"), (2, 1, 1, "blink", 100.9, "s"), (3, 9, 1, None, -1.0, None), (4, 1, None, "seek", None, "s"), (5, 1, 1, "pause", 101.5, "s")],
        chunks=[(1, 1, 0.0, 100.0), (2, 1, 50.0, 50.0), (3, 2, 0.0, 1.0)],
        questions=[(1, 1, four, "B"), (2, 2, four, "e"), (3, 1, '{"a": 1}', "A"), (4, 1, '["A"]', "a"), (5, 1, None, None)],
        attempts=[(1, 1, 1), (2, 2, 1), (3, 9, 1), (4, 1, 99), (5, 1, 2), (6, None, 1)],
        reports=[(1, 1, 1, "module", None), (2, 1, 1, "module", 0), (3, 1, 7, "week", 1), (4, None, 1, None, 2)],
        notifications=[(1, 1, 1), (2, 9, 50), (3, None, None)],
    )
    found = integrity.suite(t)
    ids = {n: [r.id for r in df.orderBy("id").collect()] for n, df in found.items() if "id" in df.columns}
    assert ids == {
        "enrolments without their student or course": [3, 4],
        "events without their student or lecture": [3, 4],
        "events of an unknown type": [2],
        "events at no place or a negative one": [3, 4],
        "events without a session": [3],
        "events past the lecture's end": [5],
        "attempts without their student or question": [3, 4, 6],
        "attempts by students outside the course": [2],
        "questions whose answer is no option": [2, 3, 5],
        "questions without four options": [3, 4],
        "questions on a lecture of no course": [2],
        "lectures without a length": [3],
        "notifications of a missing report": [2],
        "notifications to a missing user": [2, 3],
        "reports without their student or course": [3, 4],
        "reports of an unknown kind": [3],
        "users of an unknown role": [3],
        "chunks that end before they begin": [2],
    }
    assert rows(found["repeated enrolments"], "student_id", "course_id", "n") == [(1, 1, 2)]
    assert rows(found["repeated reports of one completion"], "student_id", "course_id", "kind", "n") == [(1, 1, "module", 2)]
    assert len(found) == 20
    assert all(df.count() == 0 for df in integrity.suite(tables(spark)).values())


def test_subjects_are_live_enrolments_with_the_last_event(spark):
    users = spark.createDataFrame([(1, "ann"), (2, "dr")], "id int, name string")
    courses = spark.createDataFrame([(1, "c", 2), (2, "d", None)], "course_id int, title string, doctor_id int")
    lectures = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "lecture_id int, course_id int")
    events = spark.createDataFrame([(1, 1, day(3)), (1, 2, day(5)), (1, 3, day(9)), (9, 1, day(9))], "student_id int, lecture_id int, at timestamp")
    enrolments = spark.createDataFrame([(1, 1, "active", None), (1, 1, "active", day(1)), (1, 1, "ended", None), (1, 2, "active", None), (7, 1, "active", None)], "student_id int, course_id int, status string, expires_at timestamp")
    got = lambda e: rows(listings.report_subjects(enrolments, users, courses, lectures, e, F.lit(day(2))), "student_id", "course_id", "doctor_name", "last_activity")
    assert got(events) == [(1, 1, "dr", day(5))]
    assert got(events.limit(0)) == [(1, 1, "dr", None)]


def test_exams_are_listed_latest_first_and_never_handed_in_last(spark):
    of = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 9)], "exam_id int, course_id int")
    courses = spark.createDataFrame([(1, "c", 5)], "course_id int, title string, doctor_id int")
    questions = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, None)], "exam_id int, question_id int")
    sittings = spark.createDataFrame([(2, 7, day(1)), (2, 7, day(4)), (2, 8, None), (3, 7, None)], "exam_id int, student_id int, submitted_at timestamp")
    names = ("exam_id", "questions", "students", "sittings", "last_answered", "position")
    assert rows(listings.exams(of, courses, questions, sittings), *names) == [(1, 2, 0, 0, None, 2), (2, 0, 2, 3, day(4), 1), (3, 0, 1, 1, None, 3)]


def test_subscriptions_from_both_sides(spark):
    users = spark.createDataFrame([(1, "ann"), (2, "bo"), (5, "dr"), (6, "er")], "id int, name string")
    subs = spark.createDataFrame([(1, 5, day(1)), (1, 6, day(2)), (2, 5, None), (1, 99, day(3)), (99, 5, day(3))], "student_id int, doctor_id int, subscribed_at timestamp")
    of = spark.createDataFrame([(5,), (5,), (None,)], "doctor_id int")
    assert rows(listings.teachers_of(subs, users, of, of.limit(0)), "student_id", "doctor_id", "doctor_name", "courses", "lectures", "position") == [(1, 5, "dr", 2, 0, 2), (1, 6, "er", 0, 0, 1), (2, 5, "dr", 2, 0, 1), (99, 5, "dr", 2, 0, 1)]  # a student's own row isn't looked at
    assert rows(listings.students_of(subs, users), "doctor_id", "student_id", "position") == [(5, 1, 1), (5, 2, 2), (6, 1, 1), (99, 1, 1)]  # nor a doctor's


def test_a_summary_is_taken_only_at_the_expected_mark(spark):
    sessions = spark.createDataFrame([(1, "old", 4), (2, "old", 4), (3, None, None), (4, "old", 0)], "session_id int, summary string, until int")
    made = spark.createDataFrame([(1, 4, "b", 8), (1, 4, "a", 8), (1, 4, "z", 9), (2, 3, "late", 9), (3, None, "x", 1), (8, 0, "x", 1)], "session_id int, expected int, summary string, until int")
    assert rows(listings.summaries_set(sessions, made), "session_id", "summary", "until") == [(1, "a", 8), (2, "old", 4), (3, None, None), (4, "old", 0)]
    assert rows(listings.summaries_set(sessions, made.limit(0)), "session_id", "until") == [(1, 4), (2, 4), (3, None), (4, 0)]
