"""Reads of stored learning data and the joins that reports start from.

A resource is a lecture or a video; rows that name it in two columns get one key (source_type, resource_id), so that an OR
over two columns becomes one equality. Null keys match nothing, an empty table gives no rows (or NULLs on the outer side of
a left join), and repeated rows stay repeated unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import UNSORTED, answer_key
from .access import live

RESOURCE = ["source_type", "resource_id"]
#: Fixed value: how far a reported response time may be from the stamps, and beyond the time allowed (ms).
TOLERANCE = 1500


def between(at: str, since=None, until=None) -> Column:
    """at in [since, until); an end that is None is open. Column against literal, so the scan takes it."""
    on = F.lit(True) if since is None else F.col(at) >= F.lit(since)
    return on if until is None else on & (F.col(at) < F.lit(until))


def events_of(events: DataFrame, since=None, until=None, student_id=None, session_id=None, resources: DataFrame | None = None, at: str = "at") -> DataFrame:
    """events in [since, until) of a student, of a session and of the resources named (columns they share with events)."""
    out = events.filter(between(at, since, until))
    for name, value in (("student_id", student_id), ("session_id", session_id)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out if resources is None else out.join(resources.distinct(), resources.columns, "left_semi")


def one_parent(a: str = "lecture_id", b: str = "video_id") -> Column:
    """Exactly one of the two is known."""
    return F.col(a).isNull() != F.col(b).isNull()


def keyed(rows: DataFrame, lecture: str = "lecture_id", video: str = "video_id") -> DataFrame:
    """rows with the key of their resource: the lecture where it is known, else the video; NULLs where neither is."""
    kind = F.when(F.col(lecture).isNotNull(), "lecture").when(F.col(video).isNotNull(), "video")
    return rows.withColumns({"source_type": kind, "resource_id": F.coalesce(lecture, video)})


def last_stamps(chunks: DataFrame) -> DataFrame:
    """The key of each resource and end_ts, the last of its chunks'; a chunk of a lecture and a video counts for both."""
    each = F.explode(F.array(F.struct(F.lit("lecture").alias("source_type"), F.col("lecture_id").alias("resource_id")), F.struct(F.lit("video").alias("source_type"), F.col("video_id").alias("resource_id"))))
    both = chunks.groupBy("lecture_id", "video_id").agg(F.max("end_ts").alias("end_ts")).select(each.alias("_k"), "end_ts")
    return both.select("_k.*", "end_ts").dropna(subset=["resource_id"]).groupBy(*RESOURCE).agg(F.max("end_ts").alias("end_ts"))


def resources(lectures: DataFrame, videos: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_type, resource_id, course_id, title and duration of lectures (lecture_id, course_id, title) and videos
    (video_id, course_id, title, duration_seconds): a video's own, else the last stamp of the chunks, else 0."""
    own = lectures.select(F.lit("lecture").alias("source_type"), F.col("lecture_id").alias("resource_id"), "course_id", "title", F.lit(None).cast("double").alias("_own"))
    both = own.unionByName(videos.select(F.lit("video").alias("source_type"), F.col("video_id").alias("resource_id"), "course_id", "title", F.col("duration_seconds").cast("double").alias("_own")))
    out = both.join(last_stamps(chunks), RESOURCE, "left")
    return out.select(*RESOURCE, "course_id", "title", F.coalesce("_own", F.col("end_ts").cast("double"), F.lit(0.0)).alias("duration"))


def assigned(assignments: DataFrame, videos: DataFrame, chunks: DataFrame) -> DataFrame:
    """assignments (lecture_id, video_id, ...) with their key and duration, found as in `resources`. A row that names a
    lecture and a video takes the longer of the two stamps."""
    stamps = last_stamps(chunks)
    by = lambda kind, name: stamps.filter(F.col("source_type") == kind).select(F.col("resource_id").alias(name), F.col("end_ts").alias(f"_{kind}"))
    own = videos.select("video_id", F.col("duration_seconds").cast("double").alias("_own"))
    out = assignments.join(own, "video_id", "left").join(by("lecture", "lecture_id"), "lecture_id", "left").join(by("video", "video_id"), "video_id", "left")
    duration = F.coalesce("_own", F.greatest("_lecture", "_video").cast("double"), F.lit(0.0))
    return keyed(out.withColumn("duration", duration)).select(*assignments.columns, *RESOURCE, "duration")


def questions_asked(messages: DataFrame, sessions: DataFrame, lectures: DataFrame, videos: DataFrame, topics: DataFrame) -> DataFrame:
    """The completed messages of users (session_id, role, status, topic_id, ...) with the student, the course of the
    session's lecture or video, and the topic's name (missing: unsorted). A message without a session is left out."""
    asked = messages.filter("role = 'user' AND status = 'completed'").join(sessions.select("session_id", "student_id", "lecture_id", "video_id"), "session_id")
    out = asked.join(lectures.select("lecture_id", F.col("course_id").alias("_l")), "lecture_id", "left").join(videos.select("video_id", F.col("course_id").alias("_v")), "video_id", "left").join(topics.select("topic_id", F.col("name").alias("_t")), "topic_id", "left")
    return out.withColumns({"course_id": F.coalesce("_l", "_v"), "topic": F.coalesce("_t", F.lit(UNSORTED))}).drop("_l", "_v", "_t")


def exam_questions(questions: DataFrame, topics: DataFrame, options: DataFrame) -> DataFrame:
    """questions (question_id, topic_id, ...) with the topic's name and their options (question_id, option_id, position,
    is_key) as an array in order of (position, option_id); empty where a question has none."""
    listed = options.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", "option_id", "is_key"))).alias("_o"))
    out = questions.join(topics.select("topic_id", F.col("name").alias("_t")), "topic_id", "left").join(listed, "question_id", "left")
    none = F.array().cast(listed.schema["_o"].dataType)
    return out.withColumns({"topic": F.coalesce("_t", F.lit(UNSORTED)), "options": F.coalesce("_o", none)}).drop("_t", "_o")


def latest_course(enrolments: DataFrame, courses: DataFrame, doctors: DataFrame, as_of: Column) -> DataFrame:
    """Of each student, the course enrolled in last that is live, with its title and doctor; ties go to the least course."""
    open_ = enrolments.filter(live(as_of)).join(courses.select("course_id", "title", "doctor_id"), "course_id").join(doctors.select("doctor_id", F.col("name").alias("doctor")), "doctor_id")
    first = F.max_by(F.struct("course_id", "title", "doctor", "enrolled_at"), F.struct("enrolled_at", -F.col("course_id")))
    return open_.groupBy("student_id").agg(first.alias("_c")).select("student_id", "_c.*")


def watchable(asked: DataFrame, videos: DataFrame, enrolments: DataFrame, as_of: Column) -> DataFrame:
    """The rows of asked (student_id, video_id) whose video is of a course the student's enrolment in is live. The courses of a
    video go to the rows that ask for it: all videos of a student's courses would be students times videos."""
    courses = videos.groupBy("video_id").agg(F.collect_set("course_id").alias("_courses"))
    may = enrolments.filter(live(as_of)).select(F.col("student_id").alias("_student"), F.col("course_id").alias("_course")).distinct()
    on = (F.col("student_id") == F.col("_student")) & F.array_contains("_courses", F.col("_course"))
    return asked.join(courses, "video_id").join(may, on, "left_semi").select(*asked.columns)


def taught(asked: DataFrame, enrolments: DataFrame, courses: DataFrame, as_of: Column) -> DataFrame:
    """The rows of asked (doctor_id, student_id) where the doctor owns a course the student's enrolment in is live."""
    pairs = enrolments.filter(live(as_of)).join(courses.select("course_id", "doctor_id"), "course_id").select("doctor_id", "student_id")
    return asked.join(pairs, ["doctor_id", "student_id"], "left_semi")


def level_members(levels: DataFrame, categories: DataFrame, items: dict[str, DataFrame]) -> DataFrame:
    """levels (level_id, type) with the number of their active categories, and of the published rows of each of items
    (category_id, status). A category is of a level by the column of the level's type: one key instead of an OR."""
    stages = {"pre_college": "pre_college_stage_id", "college": "college_stage_id"}
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).alias("level_id")) for t, c in stages.items()]))
    of = categories.filter("is_active").select("category_id", each.alias("_l")).select("category_id", "_l.*").dropna(subset=["level_id"])
    sizes = of
    for name, rows in items.items():
        n = rows.filter("status = 'published'").groupBy("category_id").agg(F.count(F.lit(1)).alias(name))
        sizes = sizes.join(n, "category_id", "left")
    totals = sizes.groupBy("type", "level_id").agg(F.count(F.lit(1)).alias("categories"), *[F.sum(name).alias(name) for name in items])
    names = ["categories", *items]
    return levels.join(totals, ["type", "level_id"], "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in names})


def bridged(lectures: DataFrame, videos: DataFrame) -> DataFrame:
    """lecture_id and video_id of equal guid, where the guid stands for one lecture and one video alone."""
    alone = lambda df, c: df.dropna(subset=["guid"]).groupBy("guid").agg(F.min(c).alias(c), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return alone(lectures, "lecture_id").join(alone(videos, "video_id"), "guid").select("lecture_id", "video_id")


def with_doctor_of_course(lectures: DataFrame, courses: DataFrame) -> DataFrame:
    """lectures whose doctor_id is that of their course, and whether it was another (null counts as another); lectures of no
    known course stay as they are."""
    out = lectures.join(courses.select("course_id", F.col("doctor_id").alias("_d"), F.lit(True).alias("_known")), "course_id", "left")
    known = F.coalesce("_known", F.lit(False))
    return out.withColumns({"changed": known & ~F.col("doctor_id").eqNullSafe(F.col("_d")), "doctor_id": F.when(known, F.col("_d")).otherwise(F.col("doctor_id"))}).drop("_d", "_known")


def with_exams(quiz: DataFrame, exams: DataFrame) -> DataFrame:
    """Quiz attempts and exam results as one kind of evidence; the ids of exam questions are `exam:<id>`."""
    return quiz.withColumn("question_id", F.col("question_id").cast("string")).unionByName(exams.withColumn("question_id", F.concat(F.lit("exam:"), F.col("question_id").cast("string"))), allowMissingColumns=True)


def top_repeated(rows: DataFrame, keys: list[str], item: str, order: list[str], k: int = 5) -> DataFrame:
    """keys, item, n and place of the k commonest items that occur more than once; ties go to what occurs first in `order`,
    then by item. Null items don't count."""
    n = rows.dropna(subset=[item]).groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first")).filter("n > 1")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_first", item))
    return n.withColumn("place", place).filter(F.col("place") <= k).drop("_first")


def graded(attempts: DataFrame) -> DataFrame:
    """attempts (selected, answer, outcome, shown_ms, answered_ms, response_ms, allowed_s) with is_correct (texts equal but
    for case and outer white space; NULL unless answered) and problem, the first that holds: answered before shown, a response
    time off the stamps, or one beyond the time allowed. Null stamps and times make no problem."""
    answered = F.col("outcome") == "answered"
    off = F.abs(F.col("answered_ms") - F.col("shown_ms") - F.col("response_ms")) > TOLERANCE
    late = F.col("response_ms") > F.col("allowed_s") * 1000 + TOLERANCE
    problem = F.when(F.col("answered_ms") < F.col("shown_ms"), "answered_before_shown").when(answered & off, "response_time_mismatch").when(answered & late, "over_allowed_time")
    return attempts.withColumns({"is_correct": F.when(answered, answer_key(F.col("selected")) == answer_key(F.col("answer"))), "problem": problem})


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit in the order given, with the number of all rows. The total is one row joined to the
    page, so the whole table isn't brought to one task for it."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def cache_state(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, fingerprint) with what is stored (keys, fingerprint, payload): state is fresh where the fingerprints are
    equal, stale where they differ (the payload is a fallback), and missing."""
    old = stored.select(*keys, F.col("fingerprint").alias("_f"), "payload", F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "missing").when(F.col("fingerprint").eqNullSafe(F.col("_f")), "fresh").otherwise("stale")
    return wanted.join(old, keys, "left").withColumn("state", state).drop("_f", "_known")
