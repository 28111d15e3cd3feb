"""The twenty integrity checks of the learning tables. Each gives the offending rows, so that a failure shows what it found.

Foreign keys that are null count as missing, but for a notification's report and a lecture's course where a check says so;
a null kind, role, type or set of options offends no list of allowed ones; repeated rows are reported each (or once a key, where repeats are
the offence); tables without rows offend nothing. Other columns of the tables are kept and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .access import repeated

# The names that the stored tables allow.
EVENT_TYPES = ("play", "pause", "seek", "skip", "complete", "rewatch_segment", "heartbeat", "tab_hidden", "tab_visible")
REPORT_KINDS = ("module", "exam")
ROLES = ("student", "doctor")
OPTIONS, SLACK = 4, 1.0


def lacking(child: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """Rows of child for which any parent is missing; parents maps a column of child to the table whose id it names."""
    out = child
    for n, (key, parent) in enumerate(parents.items()):
        out = out.join(parent.select(F.col("id").alias(f"_k{n}")).distinct(), F.col(key) == F.col(f"_k{n}"), "left")
    any_missing = " OR ".join(f"_k{n} IS NULL" for n in range(len(parents)))
    return out.filter(any_missing).select(*[out[c] for c in child.columns])


def outside(column: str, allowed: tuple[str, ...]) -> Column:
    return ~F.col(column).isin(*allowed)


def offers(options: Column, answer: Column) -> Column:
    """Whether the first letter of one of the options (a JSON array) is the answer, whatever its case."""
    each = F.when(F.json_array_length(options).isNotNull(), F.from_json(options, "array<string>"))
    return F.coalesce(F.exists(each, lambda o: F.upper(F.substring(o, 1, 1)) == F.upper(answer)), F.lit(False))


def suite(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The offending rows of each check; t holds users, courses, lectures, enrolments, events, chunks, questions, attempts,
    reports and notifications."""
    ends = t["chunks"].groupBy(F.col("lecture_id").alias("_lecture")).agg(F.max("end_ts").alias("_end"))
    of_lecture = t["lectures"].select(F.col("id").alias("lecture_id"), F.col("course_id").alias("_course"))
    lecture_of = t["questions"].select(F.col("id").alias("question_id"), "lecture_id").join(of_lecture, "lecture_id").drop("lecture_id").filter("_course IS NOT NULL")
    enrolled = t["enrolments"].select("student_id", F.col("course_id").alias("_course")).distinct()
    known = t["users"].select(F.col("id").alias("student_id")).distinct()
    by_students = t["attempts"].join(known, "student_id", "left_semi").join(lecture_of, "question_id")
    return {
        "enrolments without their student or course": lacking(t["enrolments"], {"student_id": t["users"], "course_id": t["courses"]}),
        "repeated enrolments": repeated(t["enrolments"], ["student_id", "course_id"]),
        "events without their student or lecture": lacking(t["events"], {"student_id": t["users"], "lecture_id": t["lectures"]}),
        "events of an unknown type": t["events"].filter(outside("event_type", EVENT_TYPES)),
        "events at no place or a negative one": t["events"].filter("video_ts IS NULL OR video_ts < 0"),
        "events without a session": t["events"].filter("session_id IS NULL"),
        "events past the lecture's end": t["events"].join(ends, F.col("lecture_id") == F.col("_lecture")).filter(F.col("video_ts") > F.col("_end") + SLACK),
        "attempts without their student or question": lacking(t["attempts"], {"student_id": t["users"], "question_id": t["questions"]}),
        "attempts by students outside the course": by_students.join(enrolled, ["student_id", "_course"], "left_anti"),
        "questions whose answer is no option": t["questions"].filter(~offers(F.col("options"), F.col("correct_option"))),
        "questions without four options": t["questions"].filter(F.col("options").isNotNull() & (F.coalesce(F.json_array_length("options"), F.lit(-1)) != OPTIONS)),
        "questions on a lecture of no course": t["questions"].join(of_lecture.filter("_course IS NULL"), "lecture_id", "left_semi"),
        "lectures without a length": t["lectures"].join(ends, F.col("id") == F.col("_lecture"), "left_anti"),
        "notifications of a missing report": lacking(t["notifications"].filter("report_id IS NOT NULL"), {"report_id": t["reports"]}),
        "notifications to a missing user": lacking(t["notifications"], {"user_id": t["users"]}),
        "reports without their student or course": lacking(t["reports"], {"student_id": t["users"], "course_id": t["courses"]}),
        "reports of an unknown kind": t["reports"].filter(outside("kind", REPORT_KINDS)),
        "repeated reports of one completion": repeated(t["reports"].withColumn("_lecture", F.coalesce("lecture_id", F.lit(0))), ["student_id", "course_id", "kind", "_lecture"]),
        "users of an unknown role": t["users"].filter(outside("role", ROLES)),
        "chunks that end before they begin": t["chunks"].filter("end_ts <= start_ts"),
    }
