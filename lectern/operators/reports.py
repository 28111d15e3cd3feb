"""The weekly report and the exam report, for all students and exams at once.

Rates are per cent to one place (half-even on the binary value) and NULL without a base; missing evidence stays NULL, never
zero. Null flags count as false, a null topic is unsorted, empty tables give no rows, and repeated rows count as often as
they stand. Everything is grouped by a report's key, so no report passes through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import UNSORTED, rounded, safe_rate
from . import exam, scoring
from ..stored import stored
from .intervals import covered_seconds
from .replay import MAX_GAP, SESSION, replay
from .scoring import confidence as evidence_confidence
from .scoring import ever_correct

# What a topic of an exam needs, and the students and attempts of high and medium confidence.
TOPIC_QUESTIONS, TOPIC_ATTEMPTS, PASS_MARK, SCORE_BINS = 2, 10, 60.0, 5
CONFIDENCE = [(30, 60, "HIGH"), (10, 20, "MEDIUM")]


def percent(part: Column, whole: Column) -> Column:
    return rounded(safe_rate(part, whole))


def sample_confidence(students: Column, attempts: Column) -> Column:
    """By the number of students and of attempts."""
    out = F.when(F.lit(False), "")
    for n, m, name in CONFIDENCE:
        out = out.when((students >= n) & (attempts >= m), name)
    return out.otherwise("LOW")


# Exams


def final_answers(responses: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of keys and question: first_ok and final_ok (NULL unless answered), response_s, skipped (or timed out)
    and tries, in the order of exam.ORDER. responses has is_correct, answered, response_s, skipped and timed_out."""
    order = F.struct(*exam.ORDER)
    ok = F.when(F.col("answered"), F.coalesce("is_correct", F.lit(False)))
    missed = F.coalesce("skipped", F.lit(False)) | F.coalesce("timed_out", F.lit(False))
    out = responses.groupBy(*keys, "question_id").agg(F.min_by(F.struct(ok.alias("ok")), order).alias("_f"), F.max_by(F.struct(ok.alias("ok"), "response_s", missed.alias("missed")), order).alias("_l"), F.count(F.lit(1)).alias("tries"))
    return out.select(*keys, "question_id", F.col("_f.ok").alias("first_ok"), F.col("_l.ok").alias("final_ok"), F.col("_l.response_s").alias("response_s"), F.col("_l.missed").alias("skipped"), "tries")


def _rates(of: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy at the first and the final answer, the gain between them, and what the counts rest on."""
    out = of.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shown"), F.count("final_ok").alias("answered"), F.count_if("final_ok").alias("correct"), F.count("first_ok").alias("_fn"), F.count_if("first_ok").alias("_fk"),
        F.count_if(F.col("tries") > 1).alias("retried"), F.count_if("skipped").alias("skipped"), F.sum("tries").alias("attempts"),
    )
    rates = {"accuracy": percent(F.col("correct"), F.col("answered")), "first_accuracy": percent(F.col("_fk"), F.col("_fn")), "retry_rate": percent(F.col("retried"), F.col("shown")), "skip_rate": percent(F.col("skipped"), F.col("shown"))}
    return out.withColumns(rates).withColumn("gain", rounded(F.col("accuracy") - F.col("first_accuracy"))).drop("_fn", "_fk")


def sittings_of(sittings: DataFrame) -> DataFrame:
    """exam_id, student_id, the number of sittings, whether one was submitted, and of the latest terminal sitting (else the
    latest): score and points; duration_s is that of the last terminal one with both stamps. Times are in seconds."""
    terminal = F.col("status").isin("submitted", "expired")
    order = F.struct("attempt_number", "sitting_id")
    timed = terminal & F.col("submitted_at").isNotNull() & F.col("started_at").isNotNull()
    latest = F.max_by(F.struct("score", "max_score", "awarded_points"), F.struct(terminal.alias("t"), "attempt_number", "sitting_id"))
    duration = F.max_by(F.when(timed, F.col("submitted_at") - F.col("started_at")), F.when(timed, order))
    out = sittings.groupBy("exam_id", "student_id").agg(F.count(F.lit(1)).alias("sittings"), F.bool_or(F.col("status") == "submitted").alias("completed"), latest.alias("_l"), rounded(duration).alias("duration_s"))
    given = F.coalesce(percent(F.col("_l.awarded_points"), F.nullif(F.col("_l.max_score"), F.lit(0.0))), F.col("_l.score"))
    return out.withColumn("sitting_score", given).drop("_l")


def exam_finals(cohort: DataFrame, responses: DataFrame, questions: DataFrame) -> DataFrame:
    """final_answers of the cohort to the questions of the exam."""
    key = ["exam_id", "student_id"]
    own = responses.join(cohort.select(*key).distinct(), key, "left_semi").join(questions.select("exam_id", "question_id").distinct(), ["exam_id", "question_id"], "left_semi")
    return final_answers(own, key)


def exam_scores(cohort: DataFrame, sittings: DataFrame, finals: DataFrame, questions: DataFrame) -> DataFrame:
    """A row for each of cohort with what its final answers and sittings give, and the score, but nothing by topic."""
    key = ["exam_id", "student_id"]
    size = questions.groupBy("exam_id").agg(F.count_distinct("question_id").alias("_size"))
    out = cohort.select(*key).distinct().join(_rates(finals, key), key, "left").join(sittings_of(sittings), key, "left").join(size, "exam_id", "left")
    return out.withColumn("score", F.when(F.col("shown") > 0, percent(F.col("correct"), F.col("_size"))).otherwise(F.col("sitting_score")))


def exam_students(cohort: DataFrame, sittings: DataFrame, responses: DataFrame, questions: DataFrame, finals: DataFrame | None = None) -> DataFrame:
    """A row for each of cohort (exam_id, student_id): score (of all questions of the exam where there are responses, else
    that of the sitting), accuracy, retries, sittings, weak topics and support group. questions: exam_id, question_id, topic.
    finals: those of exam_finals where they are at hand; else they are stored, as several parts rest on them."""
    key = ["exam_id", "student_id"]
    finals = stored(exam_finals(cohort, responses, questions), "finals") if finals is None else finals
    out = exam_scores(cohort, sittings, finals, questions)
    weak = exam_topics(finals, questions).filter(F.col("conclusive") & (F.col("accuracy") < exam.MASTERY)).select("exam_id", "topic")
    each = _topics_of(finals, questions, [*key, "topic"]).filter(F.col("accuracy") < exam.MASTERY).join(weak, ["exam_id", "topic"], "left_semi")
    listed = each.groupBy(*key).agg(F.array_sort(F.collect_list("topic")).alias("weak_topics"))
    zero = {n: F.coalesce(n, F.lit(0)).cast("bigint") for n in ("answered", "correct", "sittings")}
    out = out.join(listed, key, "left").withColumns(zero | {"completed": F.coalesce("completed", F.lit(False)), "retries": F.coalesce(F.col("attempts") - F.col("shown"), F.lit(0)), "weak_topics": F.coalesce("weak_topics", F.array().cast("array<string>"))})
    return exam.support(out).select(*key, "sittings", "completed", "answered", "correct", "score", "accuracy", "first_accuracy", "retries", "retry_rate", "duration_s", "weak_topics", "support", "issue")


def _topics_of(finals: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    named = questions.select("exam_id", "question_id", F.coalesce(F.col("topic").cast("string"), F.lit(UNSORTED)).alias("topic")).distinct()
    return _rates(finals.join(named, ["exam_id", "question_id"]), keys)


def exam_topics(finals: DataFrame, questions: DataFrame) -> DataFrame:
    """exam_id and topic with its questions, participants, accuracy, gain, retry rate (students of the topic who tried a
    question twice), students below mastery, and whether the evidence is conclusive; finals as of final_answers."""
    named = questions.select("exam_id", "question_id", F.coalesce(F.col("topic").cast("string"), F.lit(UNSORTED)).alias("topic")).distinct()
    sizes = named.groupBy("exam_id", "topic").agg(F.count(F.lit(1)).alias("questions"))
    per = _topics_of(finals, questions, ["exam_id", "topic", "student_id"])
    people = per.groupBy("exam_id", "topic").agg(F.count(F.lit(1)).alias("participants"), F.count_if(F.col("retried") > 0).alias("_again"), F.count("accuracy").alias("_known"), F.count_if(F.col("accuracy") < exam.MASTERY).alias("_below"))
    rates = _topics_of(finals, questions, ["exam_id", "topic"]).select("exam_id", "topic", "attempts", "accuracy", "first_accuracy", "gain")
    out = sizes.join(people, ["exam_id", "topic"], "left").join(rates, ["exam_id", "topic"], "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in ("participants", "attempts")})
    conclusive = (F.col("questions") >= TOPIC_QUESTIONS) & (F.col("attempts") >= TOPIC_ATTEMPTS)
    out = out.withColumns({"retry_rate": percent(F.col("_again"), F.col("participants")), "below_mastery": percent(F.col("_below"), F.col("_known")), "conclusive": conclusive})
    return out.withColumn("confidence", F.when(conclusive, sample_confidence(F.col("participants"), F.col("attempts"))).otherwise("LOW")).drop("_again", "_known", "_below")


def exam_summary(cohort: DataFrame, sittings: DataFrame, responses: DataFrame, questions: DataFrame, pass_mark: float = PASS_MARK, finals: DataFrame | None = None, students: DataFrame | None = None) -> DataFrame:
    """A row for each exam of questions: cohort, participation, completion, scores, pass rate, gain, retries, responses from
    outside the cohort, and confidence. Means and medians are rounded to one place. finals, students: the tables of exam_finals
    and exam_students where they are at hand."""
    finals = stored(exam_finals(cohort, responses, questions), "finals") if finals is None else finals
    students = exam_students(cohort, sittings, responses, questions, finals) if students is None else students
    people = students.groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("cohort"), F.count_if(F.col("sittings") > 0).alias("started"), F.count_if("completed").alias("completed"), rounded(F.avg("score")).alias("average_score"), rounded(F.median("score")).alias("median_score"),
        percent(F.count_if(F.col("score") >= pass_mark), F.count("score")).alias("pass_rate"), F.count_if(F.col("support") == "NEEDS_SUPPORT").alias("need_support"), F.count_if(F.col("retries") > 0).alias("_again"),
    )
    known = responses.join(questions.select("exam_id", "question_id").distinct(), ["exam_id", "question_id"], "left_semi")
    # what isn't among the tries of the cohort is from outside, so the responses needn't meet the cohort once more
    every = known.groupBy("exam_id").agg(F.count(F.lit(1)).alias("_every"))
    sizes = questions.groupBy("exam_id").agg(F.count_distinct("question_id").alias("questions"))
    out = sizes.join(people, "exam_id", "left").join(_rates(finals, ["exam_id"]).select("exam_id", "accuracy", "first_accuracy", "gain", "attempts", "shown"), "exam_id", "left").join(every, "exam_id", "left")
    out = out.withColumn("from_outsiders", F.col("_every") - F.coalesce("attempts", F.lit(0)))
    counts = {n: F.coalesce(n, F.lit(0)).cast("bigint") for n in ("cohort", "started", "completed", "need_support", "attempts", "_again", "from_outsiders")}
    out = out.withColumns(counts)
    c = F.col
    out = out.withColumns({"participation": percent(c("started"), c("cohort")), "completion": percent(c("completed"), c("started")), "abandonment": percent(c("started") - c("completed"), c("started")), "attempts_per_question": F.bround(F.try_divide("attempts", "shown"), 2), "needing_retry": percent(c("_again"), c("started")), "confidence": sample_confidence(c("started"), c("attempts"))})
    return out.drop("_again", "shown", "_every")


def exam_items(finals: DataFrame, questions: DataFrame) -> DataFrame:
    """exam_id and question_id with accuracy, gain, retries, skips and item-rest correlation, all exams at once. The rest of a
    student's score is over all other questions of the exam; an unanswered one is wrong there, and no item of its own."""
    key = ["exam_id", "question_id"]
    item, own = F.col("final_ok").cast("double"), F.coalesce(F.col("final_ok").cast("double"), F.lit(0.0))
    total = F.sum(own).over(Window.partitionBy("exam_id", "student_id"))
    size = questions.groupBy("exam_id").agg(F.count_distinct("question_id").alias("_size"))
    x = finals.join(size, "exam_id").withColumns({"_x": item, "_y": F.try_divide(total - own, F.col("_size") - 1)}).filter("_x IS NOT NULL")
    pairs = x.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.covar_pop("_x", "_y").alias("_c"), F.var_pop("_x").alias("_vx"), F.var_pop("_y").alias("_vy"))
    enough = (F.col("_n") >= exam.LEAST_STUDENTS) & (F.col("_vx") > 1e-12) & (F.col("_vy") > 1e-12)
    r = pairs.select(*key, F.round(F.when(enough, F.try_divide("_c", F.sqrt(F.col("_vx") * F.col("_vy")))), 3).alias("discrimination"))
    return _rates(finals, key).join(r, key, "left")


# Weeks


def lecture_lines(events: DataFrame, durations: DataFrame, keys: list[str] = SESSION[:2], max_gap: float = MAX_GAP) -> DataFrame:
    """A row for each student and resource: sittings, watch, away and session time, pauses, seeks, coverage, rates and whether
    it was completed. durations: resource_id, duration (null or zero: no rate). Each sitting is replayed alone and its times
    rounded before they are added."""
    done = replay(events, max_gap)
    per = done.groupBy(*SESSION).agg(
        rounded(F.sum("elapsed")).alias("watch"), rounded(F.sum("away")).alias("away"), rounded(F.max("at") - F.min("at")).alias("session"), F.count_if(F.col("event_type") == "pause").alias("pauses"), F.count("seek").alias("seeks"),
        F.count_if(F.col("seek") == "back").alias("back"), F.count_if(F.col("seek") == "forward").alias("forward"), F.bool_or(F.col("event_type") == "complete").alias("completed"), F.min("at").alias("first"), F.max("at").alias("last"),
    )
    sums = ["watch", "away", "session", "pauses", "seeks", "back", "forward"]
    out = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions"), *[F.sum(n).alias(n) for n in sums], F.bool_or("completed").alias("completed"), F.min("first").alias("first_opened"), F.max("last").alias("last_opened"))
    out = out.join(covered_seconds(done.select(*keys, "start", "end"), keys), keys, "left").join(durations.select("resource_id", "duration"), "resource_id", "left")
    length = F.when(F.col("duration") > 0, F.col("duration"))
    out = out.withColumn("covered", F.when(length.isNotNull(), F.least(F.coalesce("covered", F.lit(0.0)), length)).otherwise(0.0))
    return out.withColumns({"watch_rate": percent(F.col("watch"), length), "coverage": percent(F.col("covered"), length), "away_rate": percent(F.col("away"), F.col("session"))})


def watch_by_day(events: DataFrame, max_gap: float = MAX_GAP, zone: str = "UTC") -> DataFrame:
    """student_id, day and watch: a sitting counts for the local day it began on. `at` is in seconds since 1970 UTC."""
    per = replay(events, max_gap).groupBy(*SESSION).agg(rounded(F.sum("elapsed")).alias("watch"), F.min("at").alias("_at"))
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MICROSECOND", (F.col("_at") * 1_000_000).cast("bigint"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))))
    return per.groupBy("student_id", day.alias("day")).agg(F.sum("watch").alias("watch"))


def week_sums(registered: DataFrame, lines: DataFrame) -> DataFrame:
    """The counts and the sums of week_totals, not rounded."""
    keys = ["student_id", "resource_id"]
    x = registered.select(*keys, "duration").join(lines.drop("duration"), keys, "left")
    known = F.coalesce("duration", F.lit(0.0)) > 0
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return x.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("registered"), F.count("sessions").alias("opened"), F.count_if("completed").alias("completed"), F.count_if(~known).alias("without_length"), zero(F.when(known, F.col("duration"))).alias("material"),
        zero("watch").alias("watch"), zero(F.when(known, F.col("covered"))).alias("covered"), zero("session").alias("session"), zero("away").alias("away"), F.coalesce(F.sum("pauses"), F.lit(0)).alias("pauses"), F.coalesce(F.sum("seeks"), F.lit(0)).alias("seeks"),
    )


def week_totals(registered: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each student: lectures registered (student_id, resource_id, duration), opened, completed and untouched,
    material, watch and covered time, and rates, which are those of the sums before they are rounded. Lectures without a
    known length aren't part of any rate's base."""
    rates = {"untouched": F.col("registered") - F.col("opened"), "coverage": percent(F.col("covered"), F.col("material")), "away_rate": percent(F.col("away"), F.col("session"))}
    return week_sums(registered, lines).withColumns(rates).withColumns({n: rounded(F.col(n)) for n in ("material", "watch", "covered", "session", "away")})


def period_metrics(events: DataFrame, quiz: DataFrame, checkpoints: DataFrame, registered: DataFrame, period: str = "week", max_gap: float = MAX_GAP) -> DataFrame:
    """A row for each student and period of the events (with period and day): coverage of all that the student is registered
    for (student_id, resource_id, duration), active days, sittings, quiz and checkpoint accuracy (student_id, period,
    question_id, is_correct; student_id, period, answered, is_correct) and mastery. Each period is replayed by itself: a sitting
    over its end is cut there. Periods without an event have no row."""
    keys = ["student_id", period]
    done = replay(events.withColumn("session_id", F.to_json(F.struct("session_id", period))), max_gap)
    covered = covered_seconds(done.select(*keys, "resource_id", "start", "end"), [*keys, "resource_id"])
    known = registered.filter("duration > 0")
    seen = covered.join(known, ["student_id", "resource_id"]).groupBy(*keys).agg(F.sum(F.least("covered", "duration")).alias("_seen"))
    base = known.groupBy("student_id").agg(F.sum("duration").alias("_all"))
    active = events.groupBy(*keys).agg(F.count_distinct("day").alias("active_days"), F.count_distinct("resource_id", "session_id").alias("sessions"))
    out = active.join(seen, keys, "left").join(base, "student_id", "left").withColumn("coverage", percent(F.coalesce("_seen", F.lit(0.0)), F.col("_all"))).drop("_seen", "_all")
    rates = mastery_by(keys, quiz, checkpoints, out.select(*keys, "coverage")).select(*keys, "quiz_accuracy", "checkpoint_accuracy", F.col("score").alias("mastery"))
    return out.join(rates, keys, "left")


def mastery(assessment: Column, checkpoint: Column, coverage: Column) -> Column:
    return scoring.mastery(assessment, checkpoint, coverage, exact=True)


def mastery_by(keys: list[str], quiz: DataFrame, checkpoints: DataFrame, coverage: DataFrame) -> DataFrame:
    """Mastery over keys (a topic, or a resource) from quiz attempts (keys, question_id, is_correct), checkpoints (keys,
    answered, is_correct) and coverage (keys, coverage), all of it optional: keys of quiz or checkpoints have a row, those of
    coverage alone have one too but no score. Worst first is a matter of the reader's order (score, nulls last)."""
    q = ever_correct(quiz.withColumn("is_correct", F.coalesce("is_correct", F.lit(False))), keys).select(*keys, "questions", rounded(F.col("score")).alias("quiz_accuracy"))
    c = checkpoints.groupBy(*keys).agg(F.count_if("answered").alias("checkpoints"), F.count_if(F.col("answered") & F.col("is_correct")).alias("_ok")).select(*keys, "checkpoints", percent(F.col("_ok"), F.col("checkpoints")).alias("checkpoint_accuracy"))
    out = q.join(c, keys, "full").join(coverage.groupBy(*keys).agg(rounded(F.avg("coverage")).alias("coverage")), keys, "full")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in ("questions", "checkpoints")})
    # a tie of the decimals is one: the last bits that products of doubles leave over don't part it
    score = F.rint(mastery(F.col("quiz_accuracy"), F.col("checkpoint_accuracy"), F.col("coverage")) * 10) / 10
    kinds = F.col("quiz_accuracy").isNotNull().cast("int") + F.col("checkpoint_accuracy").isNotNull().cast("int")
    named = F.col("topic") != UNSORTED if "topic" in keys else None
    return out.withColumn("score", score).withColumn("confidence", evidence_confidence(F.col("questions") + F.col("checkpoints"), kinds, named))
