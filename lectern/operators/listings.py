"""Listings for all students and doctors at once: report subjects, exams, subscriptions, inboxes, and the summaries' update.

A caller filters by student or doctor; the filter reaches the tables below the joins. Ids are unique in their own table; rows
whose other side is missing (or whose key is null) aren't listed, and empty tables list nothing. Of a subscription only the
other side is looked up: the caller's own id need not be among the users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import live


def report_subjects(enrolments: DataFrame, users: DataFrame, courses: DataFrame, lectures: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """student and course of each live enrolment, the course's doctor, and the student's last event in a lecture of it."""
    last = events.join(lectures.select("lecture_id", "course_id"), "lecture_id").groupBy("student_id", "course_id").agg(F.max("at").alias("last_activity"))
    students = users.select(F.col("id").alias("student_id"), F.col("name").alias("student_name"))
    doctors = users.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"))
    taught = courses.select("course_id", F.col("title").alias("course_title"), "doctor_id").join(doctors, "doctor_id")
    rows = enrolments.filter(live(as_of)).select("student_id", "course_id").join(students, "student_id").join(taught, "course_id")
    return rows.join(last, ["student_id", "course_id"], "left").select("student_id", "student_name", "course_id", "course_title", "doctor_id", "doctor_name", "last_activity")


def exams(of: DataFrame, courses: DataFrame, questions: DataFrame, sittings: DataFrame) -> DataFrame:
    """Each exam of a course with its questions, students, sittings and last hand-in; position is its place in the doctor's
    list, the latest first and those never handed in at the end. Questions and sittings are counted apart, not as a product."""
    asked = questions.groupBy("exam_id").agg(F.count_distinct("question_id").alias("questions"))
    sat = sittings.groupBy("exam_id").agg(F.count_distinct("student_id").alias("students"), F.count(F.lit(1)).alias("sittings"), F.max("submitted_at").alias("last_answered"))
    rows = of.join(courses.select("course_id", F.col("title").alias("course_title"), "doctor_id"), "course_id").join(asked, "exam_id", "left").join(sat, "exam_id", "left")
    order = Window.partitionBy("doctor_id").orderBy(F.col("last_answered").desc_nulls_last(), "exam_id")
    return rows.fillna(0, ["questions", "students", "sittings"]).withColumn("position", F.row_number().over(order))


def teachers_of(subscriptions: DataFrame, users: DataFrame, courses: DataFrame, lectures: DataFrame) -> DataFrame:
    """The doctors each student subscribes to, with the number of their courses and lectures; position: latest first."""
    count = lambda rows, name: rows.groupBy("doctor_id").agg(F.count(F.lit(1)).alias(name))
    doctors = users.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"))
    rows = subscriptions.join(doctors, "doctor_id").join(count(courses, "courses"), "doctor_id", "left").join(count(lectures, "lectures"), "doctor_id", "left")
    order = Window.partitionBy("student_id").orderBy(F.col("subscribed_at").desc_nulls_last(), "doctor_id")
    return rows.fillna(0, ["courses", "lectures"]).withColumn("position", F.row_number().over(order))


def students_of(subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """The students who subscribe to each doctor; position: latest first."""
    students = users.select(F.col("id").alias("student_id"), F.col("name").alias("student_name"))
    order = Window.partitionBy("doctor_id").orderBy(F.col("subscribed_at").desc_nulls_last(), "student_id")
    return subscriptions.join(students, "student_id").withColumn("position", F.row_number().over(order))


def summaries_set(sessions: DataFrame, made: DataFrame) -> DataFrame:
    """sessions (session_id, summary, until) after the summaries of `made` (session_id, expected, summary, until): one is taken
    only where the session still stands at the `expected` mark, so of two made from one state the first in order of (until,
    summary) wins; a session without a summary, or at a null mark, stays as it is."""
    first = Window.partitionBy("session_id").orderBy("_until", "_summary")
    new = made.select("session_id", F.col("expected").alias("_expected"), F.col("summary").alias("_summary"), F.col("until").alias("_until"))
    fits = sessions.select("session_id", "until").join(new, "session_id").filter("until = _expected").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    out = sessions.join(fits.select("session_id", "_summary", "_until"), "session_id", "left")
    taken = F.col("_until").isNotNull()
    return out.withColumn("summary", F.when(taken, F.col("_summary")).otherwise(F.col("summary"))).withColumn("until", F.when(taken, F.col("_until")).otherwise(F.col("until"))).drop("_summary", "_until")
