"""The exam report of all exams at once, a table for each section: scores, times, options, questions, topics, roster, actions.

 cohort     exam_id, student_id
 sittings   as reports.sittings_of takes them
 responses  exam_id, student_id, question_id, sitting_id, attempt_number, response_id, is_correct, answered, response_s, skipped,
            timed_out, selected (an array of options)
 questions  exam_id, question_id, topic, place (its order in the exam)
 options    exam_id, question_id, option_id, is_key, place

High performers are those of the cohort whose score lies above the exam's exact median, low ones those below it; scores
equal to the median, or missing, are in neither. Cases are those of `reports`: nothing answered is NULL, not zero; rows of
students outside the cohort and of questions the exam doesn't have don't count; empty tables give no rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import UNSORTED, label, rounded_exactly, safe_rate
from ..stored import stored
from . import exam, reports
from .quantiles import bundle, quantiles

# The codes of teaching actions, in their order, and the bins of scores.
ACTIONS = ["review_question", "reteach_topic", "follow_up_students", "contact_incomplete", "keep_sequence"]
BINS = [(0, 20), (20, 40), (40, 60), (60, 80), (80, 100)]
KEY = ["exam_id", "student_id"]
ITEM = ["exam_id", "question_id"]


def _rate(part, whole):
    return rounded_exactly(safe_rate(part, whole))


def answers(responses: DataFrame, cohort: DataFrame, questions: DataFrame) -> DataFrame:
    """KEY and question_id with the first and the final response (ok is NULL unless answered), seconds of both, the final
    selection and the number of tries."""
    own = responses.join(cohort.select(*KEY).distinct(), KEY, "left_semi").join(questions.select(*ITEM).distinct(), ITEM, "left_semi")
    order = F.struct(*exam.ORDER)
    ok = F.when(F.col("answered"), F.coalesce("is_correct", F.lit(False)))
    missed = F.coalesce("skipped", F.lit(False)) | F.coalesce("timed_out", F.lit(False))
    row = F.struct(ok.alias("ok"), "response_s", missed.alias("missed"), "selected")
    out = own.groupBy(*KEY, "question_id").agg(F.min_by(row, order).alias("f"), F.max_by(row, order).alias("l"), F.count(F.lit(1)).alias("tries"))
    return out.select(*KEY, "question_id", F.col("f.ok").alias("first_ok"), F.col("f.response_s").alias("first_s"), F.col("l.ok").alias("final_ok"), F.col("l.response_s").alias("response_s"), F.col("l.missed").alias("skipped"), F.col("l.selected").alias("selected"), "tries")


def levels(students: DataFrame) -> DataFrame:
    """KEY and level (high, low or middle) of the students with a score, split strictly at the exam's exact median."""
    medians = quantiles(students.select("exam_id", F.col("score").alias("value")), ["exam_id"], [0.5]).select("exam_id", F.col("quantiles")[0].alias("_m"))
    level = F.when(F.col("score") > F.col("_m"), "high").when(F.col("score") < F.col("_m"), "low").otherwise("middle")
    return students.filter("score IS NOT NULL").join(medians, "exam_id").select(*KEY, level.alias("level"))


def score_distribution(students: DataFrame) -> DataFrame:
    """exam_id, low, high and students of five bins, closed below, the last one above too; empty bins are kept."""
    at = F.least(F.floor(F.col("score") / 20), F.lit(len(BINS) - 1))
    counts = students.filter("score IS NOT NULL").groupBy("exam_id", at.alias("_b")).agg(F.count(F.lit(1)).alias("students"))
    grid = students.select("exam_id").distinct().withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(BINS) - 1).cast("bigint"))))
    return grid.join(counts, ["exam_id", "_b"], "left").select("exam_id", (F.col("_b") * 20).alias("low"), (F.col("_b") * 20 + 20).alias("high"), F.coalesce("students", F.lit(0)).cast("bigint").alias("students"))


def times(finals: DataFrame, responses: DataFrame, cohort: DataFrame, sittings: DataFrame, questions: DataFrame) -> DataFrame:
    """exam_id, kind, item, n, mean, p25, median and p75 in seconds, all kinds in one refinement: every response of the exam
    ('response'), submitted sittings ('duration'), and by question the final answers ('final'), those of them that are right and
    wrong ('correct', 'incorrect') and the first ones ('first'); by topic the final answers ('topic')."""
    members = cohort.select(*KEY).distinct()
    known = questions.select(*ITEM, F.coalesce(F.col("topic").cast("string"), F.lit(UNSORTED)).alias("topic")).distinct()
    every = responses.join(members, KEY, "left_semi").join(known.select(*ITEM).distinct(), ITEM, "left_semi").select("exam_id", F.lit("response").alias("kind"), F.lit(None).cast("string").alias("item"), F.col("response_s").alias("value"))
    sat = sittings.filter("status = 'submitted' AND submitted_at IS NOT NULL").join(members, KEY, "left_semi").select("exam_id", F.lit("duration").alias("kind"), F.lit(None).cast("string").alias("item"), (F.col("submitted_at") - F.col("started_at")).alias("value"))
    q = F.col("question_id").cast("string")
    answered, ok = F.col("final_ok").isNotNull(), F.col("final_ok")
    one = lambda on, kind, item, value: F.when(on, F.struct(F.lit(kind).alias("kind"), item.alias("item"), F.col(value).alias("value")))
    parts = F.array(one(answered, "final", q, "response_s"), one(answered & ok, "correct", q, "response_s"), one(answered & ~ok, "incorrect", q, "response_s"), one(F.col("first_ok").isNotNull(), "first", q, "first_s"), one(answered, "topic", F.col("topic"), "response_s"))
    each = finals.join(known, ITEM).select("exam_id", F.explode(F.array_compact(parts)).alias("x")).select("exam_id", "x.kind", "x.item", "x.value")
    long = every.unionByName(sat).unionByName(each).withColumn("item", F.coalesce("item", F.lit("")))
    return bundle(long, ["exam_id", "kind", "item"])


def options(finals: DataFrame, split: DataFrame, listed: DataFrame) -> DataFrame:
    """ITEM, option_id, place, is_key, picks, percent (of the answers to the question), the per cent of the exam's high and low
    performers that picked it, and its class. An option twice in one answer counts once."""
    totals = finals.groupBy(*ITEM).agg(F.count("final_ok").alias("_answers"))
    sizes = split.groupBy("exam_id").agg(F.count_if(F.col("level") == "high").alias("_high"), F.count_if(F.col("level") == "low").alias("_low"))
    picked = finals.filter("final_ok IS NOT NULL").select(*KEY, "question_id", F.explode(F.array_distinct("selected")).alias("option_id")).join(split, KEY, "left")
    each = picked.groupBy(*ITEM, "option_id").agg(F.count(F.lit(1)).alias("picks"), F.count_if(F.col("level") == "high").alias("_h"), F.count_if(F.col("level") == "low").alias("_l"))
    out = listed.select(*ITEM, "option_id", "place", "is_key").distinct().join(totals, ITEM, "left").join(sizes, "exam_id", "left").join(each, [*ITEM, "option_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumns({"picks": zero("picks").cast("bigint"), "percent": _rate(zero("picks"), zero("_answers")), "high_percent": _rate(zero("_h"), zero("_high")), "low_percent": _rate(zero("_l"), zero("_low"))})
    share = F.coalesce("percent", F.lit(0.0))
    suspicious = (F.col("_high") >= exam.LEAST_GROUP) & (F.col("_low") >= exam.LEAST_GROUP) & (F.col("high_percent") - F.col("low_percent") >= exam.SUSPICIOUS)
    kind = F.when(F.col("is_key"), "correct").when(suspicious, "suspicious").when(share >= exam.MISCONCEPTION, "strong_misconception").when(share < exam.NON_FUNCTIONING, "non_functioning").otherwise("functioning")
    return out.select(*ITEM, "option_id", "place", "is_key", "picks", "percent", "high_percent", "low_percent", kind.alias("class"))


def question_rows(finals: DataFrame, questions: DataFrame, classed: DataFrame, timed: DataFrame) -> DataFrame:
    """A row for each question, answered or not: counts, rates, difficulty, discrimination and its label, confidence, median times
    and the review priority with its reasons."""
    known = questions.select(*ITEM, F.coalesce(F.col("topic").cast("string"), F.lit(UNSORTED)).alias("topic"), "place").dropDuplicates(ITEM)
    rates = reports.exam_items(finals, questions).select(*ITEM, "shown", "answered", "correct", "attempts", "accuracy", "first_accuracy", "gain", "retry_rate", "skip_rate", F.col("discrimination").alias("discrimination_value"))
    size = known.groupBy("exam_id").agg(F.count(F.lit(1)).alias("_size"))
    first = lambda name: F.min_by(F.struct("percent", "place"), F.when(F.col("class") == name, F.struct("place", "option_id")))
    odd = classed.groupBy(*ITEM).agg(first("strong_misconception").alias("_m"), first("suspicious").alias("_s"))
    at = lambda kind, name: timed.filter(F.col("kind") == kind).select("exam_id", F.col("item").alias("_q"), F.col("median").alias(name))
    out = known.join(rates, ITEM, "left").join(size, "exam_id").join(odd, ITEM, "left").withColumn("_q", F.col("question_id").cast("string"))
    for kind, name in (("final", "median_response"), ("correct", "correct_median"), ("incorrect", "incorrect_median"), ("first", "first_median")):
        out = out.join(at(kind, name), ["exam_id", "_q"], "left")
    out = out.join(timed.filter("kind = 'response'").select("exam_id", F.col("p75").alias("exam_p75")), "exam_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = out.withColumns({c: zero(c) for c in ("shown", "answered", "correct", "attempts")})
    value, thin = F.col("discrimination_value"), (F.col("answered") < exam.LEAST_STUDENTS) | (F.col("_size") < exam.LEAST_QUESTIONS)
    kind = F.when(thin, "insufficient_data").when(value.isNull(), "insufficient_variance").when(value < 0, "negative").otherwise(label(value, exam.DISCRIMINATION, "weak"))
    out = out.withColumns({
        "attempts_per_student": rounded_exactly(F.try_divide("attempts", "shown"), 2), "difficulty": label(F.col("accuracy"), exam.DIFFICULTY, "difficult"), "discrimination_value": F.when(thin, None).otherwise(value), "discrimination": kind,
        "confidence": reports.sample_confidence(F.col("answered"), F.col("attempts")), "misconception_share": F.col("_m.percent"), "misconception_order": F.col("_m.place"), "suspicious_order": F.col("_s.place"),
    })
    ranked = exam.priorities(out).drop("score")
    return ranked.withColumn("priority", rounded_exactly(F.col("priority"))).drop("_size", "_m", "_s", "_q")


def topic_rows(finals: DataFrame, questions: DataFrame, timed: DataFrame) -> DataFrame:
    """reports.exam_topics with the median response time, its place (worst accuracy first) and whether it is a weak topic."""
    median = timed.filter("kind = 'topic'").select("exam_id", F.col("item").alias("topic"), F.col("median").alias("median_response"))
    out = reports.exam_topics(finals, questions).join(median, ["exam_id", "topic"], "left")
    place = F.row_number().over(Window.partitionBy("exam_id").orderBy(F.col("accuracy").asc_nulls_last(), "topic"))
    return out.withColumns({"place": place, "weak": F.col("conclusive") & F.coalesce(F.col("accuracy") < exam.MASTERY, F.lit(False))})


def teaching_actions(summary: DataFrame, items: DataFrame, topics: DataFrame) -> DataFrame:
    """exam_id, position, action, subject and count: review the question of the highest priority (if HIGH), reteach the weakest
    conclusive topic, follow up students who need support, contact those who left; keep_sequence where no rule holds."""
    one = lambda rows, step, subject, n: rows.select("exam_id", F.lit(step).alias("_s"), subject.cast("string").alias("subject"), n.cast("bigint").alias("count"))
    null = F.lit(None)
    top = items.groupBy("exam_id").agg(F.max_by(F.struct("category", "place"), F.struct("priority", -F.col("place"))).alias("t")).filter("t.category = 'HIGH'")
    weakest = topics.filter("weak").groupBy("exam_id").agg(F.min_by("topic", "place").alias("t"))
    found = one(top, 0, F.col("t.place"), null).unionByName(one(weakest, 1, F.col("t"), null))
    found = found.unionByName(one(summary.filter("need_support > 0"), 2, null, F.col("need_support"))).unionByName(one(summary.filter("abandonment > 0"), 3, null, F.col("started") - F.col("completed")))
    found = found.unionByName(one(summary.join(found.select("exam_id").distinct(), "exam_id", "left_anti"), 4, null, null))
    position = F.row_number().over(Window.partitionBy("exam_id").orderBy("_s"))
    return found.select("exam_id", position.alias("position"), F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("_s") + 1).alias("action"), "subject", "count")


@dataclass
class ExamReport:
    """The sections of the report, each a table over all exams, made when they are first asked for; what several sections are made
    of is stored."""

    cohort: DataFrame
    sittings: DataFrame
    responses: DataFrame
    asked: DataFrame
    listed: DataFrame
    pass_mark: float = reports.PASS_MARK

    @cached_property
    def finals(self) -> DataFrame:
        return stored(answers(self.responses, self.cohort, self.asked), "answers")

    @cached_property
    def _people(self) -> DataFrame:
        return stored(reports.exam_students(self.cohort, self.sittings, self.responses, self.asked, self.finals), "roster")

    @cached_property
    def _scores(self) -> DataFrame:
        return stored(reports.exam_scores(self.cohort, self.sittings, self.finals, self.asked).select(*KEY, "score"), "scores")

    @cached_property
    def times(self) -> DataFrame:
        return stored(times(self.finals, self.responses, self.cohort, self.sittings, self.asked), "times")

    @cached_property
    def options(self) -> DataFrame:
        return stored(options(self.finals, levels(self._scores), self.listed), "options")

    @cached_property
    def questions(self) -> DataFrame:
        return stored(question_rows(self.finals, self.asked, self.options, self.times), "questions")

    @cached_property
    def topics(self) -> DataFrame:
        return stored(topic_rows(self.finals, self.asked, self.times), "topics")

    @cached_property
    def roster(self) -> DataFrame:
        return self._people.withColumn("weak_topics", F.slice("weak_topics", 1, 2))

    @cached_property
    def distribution(self) -> DataFrame:
        return score_distribution(self._people)

    @cached_property
    def summary(self) -> DataFrame:
        known, place = F.col("accuracy").isNotNull(), F.col("place")
        counts = self.questions.groupBy("exam_id").agg(*[F.count_if(F.col("difficulty") == d).alias(d) for d in ("easy", "moderate", "difficult")], F.min_by("question_id", F.when(known, F.struct("accuracy", place))).alias("hardest"), F.max_by("question_id", F.when(known, F.struct("accuracy", -place))).alias("easiest"))
        out = stored(reports.exam_summary(self.cohort, self.sittings, self.responses, self.asked, self.pass_mark, self.finals, self._people), "summary").join(counts, "exam_id", "left")
        for kind in ("duration", "response"):
            out = out.join(self.times.filter(F.col("kind") == kind).select("exam_id", F.struct("n", "mean", "p25", "median", "p75").alias(kind)), "exam_id", "left")
        return out

    @cached_property
    def clusters(self) -> DataFrame:
        odd = self.options.groupBy(*ITEM).agg(F.bool_or(F.col("class") == "strong_misconception").alias("misconception"))
        found = exam.clusters(self.questions.join(odd, ITEM, "left"), ["exam_id"])
        return found.join(self.topics.select("exam_id", "topic", "confidence"), ["exam_id", "topic"], "left")

    @cached_property
    def actions(self) -> DataFrame:
        return teaching_actions(stored(self.summary, "summary"), self.questions, self.topics)


def exam_reports(cohort: DataFrame, sittings: DataFrame, responses: DataFrame, questions: DataFrame, listed: DataFrame, pass_mark: float = reports.PASS_MARK) -> ExamReport:
    return ExamReport(cohort, sittings, responses, questions, listed, pass_mark)
