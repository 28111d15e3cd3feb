"""Exam analytics: first and final responses, item and cohort statistics, options, priorities and support groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import label, rounded, safe_rate

# Difficulty and discrimination steps, what a correlation needs, and the limits of the rules below.
DIFFICULTY = [(80.0, "easy"), (50.0, "moderate")]
DISCRIMINATION = [(0.2, "good")]
MODERATE, MASTERY, STRONG_SCORE, STRONG_ACCURACY, RETRY_DEPENDENT, FEW_RETRIES = 50.0, 60.0, 85.0, 80.0, 50.0, 25.0
PRIORITY = [(50.0, "HIGH"), (25.0, "MEDIUM")]
LEAST_STUDENTS, LEAST_QUESTIONS, NON_FUNCTIONING, MISCONCEPTION, SUSPICIOUS, LEAST_GROUP = 10, 2, 5.0, 25.0, 20.0, 5

ORDER = ["sitting_id", "attempt_number", "response_id"]


def first_final(responses: DataFrame, keys: list[str]) -> DataFrame:
    """The first and the final response to each question over keys, and how many there were."""
    key = F.struct(*ORDER)
    ok = F.col("is_correct")
    return responses.groupBy(*keys, "question_id").agg(F.min_by(ok, key).alias("first_correct"), F.max_by(ok, key).alias("final_correct"), F.max_by("response_s", key).alias("final_response"), F.count(F.lit(1)).alias("tries"))


def item_stats(finals: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, retry rate and response times of each question."""
    out = finals.groupBy(*keys).agg(F.count(F.lit(1)).alias("students"), F.count_if("final_correct").alias("correct"), F.count_if("first_correct").alias("first_ok"), F.count_if(F.col("tries") > 1).alias("retried"), F.avg("final_response").alias("mean_response"), F.percentile("final_response", [0.25, 0.5, 0.75]).alias("_p"))
    out = out.withColumns({"accuracy": safe_rate(F.col("correct"), F.col("students")), "first_accuracy": safe_rate(F.col("first_ok"), F.col("students")), "retry_rate": safe_rate(F.col("retried"), F.col("students")), "p25": F.col("_p")[0], "median_response": F.col("_p")[1], "p75": F.col("_p")[2]})
    return out.withColumn("difficulty", label(F.col("accuracy"), DIFFICULTY, "difficult")).drop("_p", "first_ok", "retried")


def histogram(scores: DataFrame, bins: int = 5, top: float = 100.0) -> DataFrame:
    """bin and n over scores from 0 to top; the last bin is closed and empty bins are kept."""
    spark = scores.sparkSession
    dealt = scores.filter("score IS NOT NULL").select(F.least(F.floor(F.col("score") / (top / bins)), F.lit(bins - 1)).alias("bin")).groupBy("bin").count()
    return spark.range(bins).select(F.col("id").alias("bin")).join(F.broadcast(dealt), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


def item_rest(finals: DataFrame, total_questions: int | None = None) -> DataFrame:
    """The correlation of each question with the rest of the score, by sums; NULL without variance, for fewer than 10
    students or 2 questions. finals: student_id, question_id, final_correct."""
    x = finals.select("student_id", "question_id", F.col("final_correct").cast("double").alias("item"))
    if total_questions is None:
        totals = x.select("question_id").distinct().agg(F.count(F.lit(1)).alias("_n"))
        x = x.crossJoin(F.broadcast(totals))  # one row
    else:
        x = x.withColumn("_n", F.lit(total_questions))
    own = F.sum("item").over(Window.partitionBy("student_id"))
    x = x.withColumn("rest", F.when(F.col("_n") > 1, (own - F.col("item")) / (F.col("_n") - 1)))
    s = x.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.sum("item").alias("sx"), F.sum("rest").alias("sy"), F.sum(F.col("item") * F.col("rest")).alias("sxy"), F.sum(F.col("item") * F.col("item")).alias("sxx"), F.sum(F.col("rest") * F.col("rest")).alias("syy"), F.max("_n").alias("q"))
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    r = F.when((n >= LEAST_STUDENTS) & (F.col("q") >= LEAST_QUESTIONS) & (vx > 1e-9) & (vy > 1e-9), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    unknown = F.when((n < LEAST_STUDENTS) | (F.col("q") < LEAST_QUESTIONS), "insufficient_data").otherwise("insufficient_variance")
    shown = F.round("correlation", 3)
    kind = F.when(F.col("correlation").isNull(), F.col("unknown")).when(shown < 0, "negative").otherwise(label(shown, DISCRIMINATION, "weak"))
    return s.select("question_id", n.alias("students"), r.alias("correlation"), unknown.alias("unknown")).withColumn("discrimination", kind).drop("unknown")


def distractors(answers: DataFrame, options: DataFrame) -> DataFrame:
    """answers: question_id, selected (options, any number) and level (high, low or middle) of each student's answer; options:
    question_id, option_id, is_key. The class of each wrong option, one that nobody picked included; later rules win. Shares
    are per cent of the answers, rounded to one place; without answers they are NULL and the class is non_functioning. An
    option twice in one answer counts once; null selections pick nothing."""
    totals = answers.groupBy("question_id").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("level") == "high").alias("high"), F.count_if(F.col("level") == "low").alias("low"))
    each = answers.select("question_id", "level", F.explode(F.array_distinct("selected")).alias("option_id")).groupBy("question_id", "option_id").agg(F.count(F.lit(1)).alias("picked"), F.count_if(F.col("level") == "high").alias("_h"), F.count_if(F.col("level") == "low").alias("_l"))
    out = options.filter(~F.col("is_key")).select("question_id", "option_id").distinct().join(totals, "question_id", "left").join(each, ["question_id", "option_id"], "left")
    part = lambda c, of: rounded(safe_rate(F.coalesce(c, F.lit(0)), F.col(of)))
    out = out.withColumns({"share": part("picked", "answers"), "high_share": part("_h", "high"), "low_share": part("_l", "low")})
    suspicious = (F.col("high") >= LEAST_GROUP) & (F.col("low") >= LEAST_GROUP) & (F.col("high_share") - F.col("low_share") >= SUSPICIOUS)
    share = F.coalesce("share", F.lit(0.0))
    kind = F.when(suspicious, "suspicious").when(share >= MISCONCEPTION, "strong_misconception").when(share < NON_FUNCTIONING, "non_functioning").otherwise("functioning")
    return out.select("question_id", "option_id", F.coalesce("picked", F.lit(0)).cast("bigint").alias("picked"), "share", kind.alias("class"))


def priorities(items: DataFrame) -> DataFrame:
    """items with a review priority of at most 100, its category and its reasons. items has accuracy, discrimination,
    misconception_share and misconception_order (the first strong misconception), suspicious_order, retry_rate, skip_rate,
    median_response and exam_p75; what is NULL adds nothing."""
    c = F.col
    rules = [
        (c("accuracy").isNotNull(), (100 - c("accuracy")) * 0.35, c("accuracy") < MODERATE, F.format_string("%.1f%% correct", "accuracy")),
        (c("discrimination") == "negative", F.lit(25.0), F.lit(True), F.lit("negative discrimination; review recommended")),
        (c("discrimination") == "weak", F.lit(12.0), F.lit(True), F.lit("weak discrimination")),
        (c("misconception_share").isNotNull(), F.lit(15.0), F.lit(True), F.format_string("%.1f%% selected distractor %d", "misconception_share", "misconception_order")),
        (c("suspicious_order").isNotNull(), F.lit(10.0), F.lit(True), F.format_string("distractor %d over-selected by higher performers", "suspicious_order")),
        (c("retry_rate").isNotNull(), c("retry_rate") * 0.15, c("retry_rate") >= 25, F.format_string("%.1f%% required retry", "retry_rate")),
        (c("skip_rate").isNotNull(), c("skip_rate") * 0.15, c("skip_rate") >= 10, F.format_string("%.1f%% skipped/timed out", "skip_rate")),
        (c("median_response") > c("exam_p75"), F.lit(10.0), F.lit(True), F.lit("response time above exam p75")),
    ]
    score = sum((F.when(on, points).otherwise(0.0) for on, points, _, _ in rules), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(on & named, text) for on, _, named, text in rules]))
    out = items.withColumn("score", F.least(score, F.lit(100.0))).withColumn("priority", F.round("score", 1))
    return out.withColumns({"category": label(c("priority"), PRIORITY, "LOW"), "reasons": F.array_join(reasons, ", ")})


def support(students: DataFrame) -> DataFrame:
    """students (completed, score, accuracy, first_accuracy, retry_rate, weak_topics) with the first group whose rule holds,
    and its issue."""
    c, weak = F.col, "NEEDS_SUPPORT"
    rules = [
        (~c("completed"), "INCOMPLETE_OR_INSUFFICIENT", F.lit("Low completion")),
        (c("accuracy").isNull() | c("first_accuracy").isNull() | c("score").isNull(), "INCOMPLETE_OR_INSUFFICIENT", F.lit("Insufficient question-level evidence")),
        (F.size("weak_topics") > 0, weak, F.concat(F.lit("Weak topic: "), F.try_element_at("weak_topics", F.lit(1)))),
        (c("retry_rate") >= RETRY_DEPENDENT, weak, F.lit("High retry dependency")),
        (c("accuracy") < MASTERY, weak, F.lit("Low attempted accuracy")),
        (c("first_accuracy") < MODERATE, weak, F.lit("Low first-attempt knowledge")),
        ((c("score") >= STRONG_SCORE) & (c("accuracy") >= STRONG_ACCURACY) & (F.coalesce("retry_rate", F.lit(0.0)) < FEW_RETRIES), "STRONG_PERFORMANCE", F.lit("Secure first-attempt performance")),
        (F.lit(True), "ON_TRACK", F.lit("No immediate concern")),
    ]
    first = F.coalesce(*[F.when(on, F.struct(F.lit(group).alias("support"), issue.alias("issue"))) for on, group, issue in rules])
    return students.withColumn("_s", first).select(*students.columns, "_s.support", "_s.issue")


def clusters(questions: DataFrame, keys: list[str]) -> DataFrame:
    """Topics of at least two questions of which one has a strong misconception, or two are mostly missed at first; questions
    has keys, topic, first_accuracy and misconception (boolean)."""
    missed = F.coalesce("first_accuracy", F.lit(100.0)) < MASTERY
    out = questions.groupBy(*keys, "topic").agg(F.count(F.lit(1)).alias("questions"), F.count_if("misconception").alias("dominant"), F.count_if(missed).alias("missed"))
    return out.filter((F.col("questions") >= LEAST_QUESTIONS) & ((F.col("dominant") > 0) | (F.col("missed") >= 2)))
