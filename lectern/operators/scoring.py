"""Progress evidence: scores, checkpoints, mastery, trends and retention. Missing evidence stays NULL, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import UNSORTED, clamp, rounded_exactly, safe_rate

# Weights of the mastery components, and the limits of strengths, weaknesses and conclusive topics.
WEIGHTS = {"assessment": 0.60, "checkpoint": 0.35, "coverage": 0.05}
STRONG, WEAK, CONCLUSIVE = 75.0, 60.0, 2
# The gap that calls for catching up, the score below which a topic is revised, actions before other rules.
BEHIND, REVISE, TOPIC_ACTIONS = -5.0, 65.0, 3


def ever_correct(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, questions, correct and score: a question counts as correct once any attempt was."""
    each = attempts.groupBy(*keys, "question_id").agg(F.max(F.col("is_correct").cast("int")).alias("ok"))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("ok"), F.lit(0)).alias("correct")).withColumn("score", safe_rate(F.col("correct"), F.col("questions")))


def checkpoint_bundle(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Shown, answered (answered_at is known), correct, skipped and timed-out checkpoints over keys (missing: unsorted),
    their rates in per cent, and over answered ones the median and mean response and the median share of the allowed time
    (allowed_s; zero or none: left out). A null or zero attempt_number is the first; rates without a base are NULL."""
    answered, ok = F.col("answered_at").isNotNull(), F.coalesce("is_correct", F.lit(False))
    first = answered & F.coalesce(F.col("attempt_number"), F.lit(1)).isin(0, 1)
    named = attempts.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(UNSORTED)) for k in keys})
    out = named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shown"), F.count_if(answered).alias("answered"), F.count_if(answered & ok).alias("correct"), F.count_if(F.col("skipped")).alias("skipped"), F.count_if(F.col("timed_out")).alias("timed_out"),
        F.count_if(first).alias("_first"), F.count_if(first & ok).alias("_first_ok"),
        F.median(F.when(answered, F.col("response_s"))).alias("median_response"), F.avg(F.when(answered, F.col("response_s"))).alias("mean_response"),
        F.median(F.when(answered & (F.col("allowed_s") > 0), 100 * F.col("response_s") / F.col("allowed_s"))).alias("median_allowed_share"),
    )
    rates = {"accuracy": ("correct", "answered"), "completion": ("answered", "shown"), "first_accuracy": ("_first_ok", "_first"), "skip_rate": ("skipped", "shown"), "timeout_rate": ("timed_out", "shown")}
    return out.withColumns({k: safe_rate(F.col(a), F.col(b)) for k, (a, b) in rates.items()}).drop("_first", "_first_ok")


def breakdown(attempts: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, questions, correct, score along each dimension at once (grouping sets); null values are left out."""
    each = attempts.groupBy(*dimensions, "question_id").agg(F.max(F.col("is_correct").cast("int")).alias("ok"))
    which = F.array(*[F.when(F.grouping(d) == 0, F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))) for d in dimensions])
    # within a dimension's value a question of several rows (other dimensions) counts once
    sets = each.groupingSets([[F.col(d), F.col("question_id")] for d in dimensions], *[F.col(d) for d in dimensions], F.col("question_id")).agg(which.alias("w"), F.max("ok").alias("ok"))
    one = sets.select(F.filter("w", lambda x: x.isNotNull())[0].alias("w"), "ok").filter("w.value IS NOT NULL").select("w.dimension", "w.value", "ok")
    return one.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("questions"), F.sum("ok").alias("correct")).withColumn("score", safe_rate(F.col("correct"), F.col("questions")))


def topics(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The score by topic, whether it rests on enough questions, and its verdict."""
    out = ever_correct(attempts.withColumn("topic", F.coalesce(F.col("topic").cast("string"), F.lit(UNSORTED))), [*keys, "topic"])
    enough = F.col("questions") >= CONCLUSIVE
    return out.withColumn("conclusive", enough).withColumn("verdict", F.when(enough & (F.col("score") >= STRONG), "strength").when(enough & (F.col("score") < WEAK), "weakness").otherwise("open"))


def mastery(assessment: Column, checkpoint: Column, coverage: Column, exact: bool = False) -> Column:
    """The weighted mean of what is known; coverage alone is no evidence of mastery. exact: the known weights are added as
    decimals (0.35 and 0.05 are 0.4), else as doubles (a little less), which parts ties of the rounded value."""
    assessed = assessment.isNotNull() | checkpoint.isNotNull()
    parts = [(assessment, WEIGHTS["assessment"]), (checkpoint, WEIGHTS["checkpoint"]), (F.when(assessed, coverage), WEIGHTS["coverage"])]
    unit = 100 if exact else 1
    weight = lambda w: round(w * unit) if exact else w
    total = sum((F.when(x.isNotNull(), weight(w)).otherwise(weight(0.0)) for x, w in parts[1:]), F.when(parts[0][0].isNotNull(), weight(parts[0][1])).otherwise(weight(0.0))) / unit
    value = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    return F.when(total > 0, value / total)


def confidence(graded: Column, kinds: Column, named: Column | None = None) -> Column:
    """Of a mastery value: by the number of graded items and of kinds of evidence. named: whether the topic is known, as a high
    confidence needs (taken as known where not given)."""
    sorted_ = F.lit(True) if named is None else F.coalesce(named, F.lit(False))
    return F.when((graded >= 8) & (kinds >= 2) & sorted_, "HIGH").when((graded >= 3) & (kinds >= 1), "MEDIUM").otherwise("LOW")


def trend(weekly: DataFrame, keys: list[str], value: str) -> DataFrame:
    """weekly (keys, week, value) with the value of the week before and the change in points; NULL if either is missing."""
    before = weekly.select(*keys, F.date_add("week", 7).alias("week"), F.col(value).alias("previous"))
    return weekly.join(before, [*keys, "week"], "left").withColumn("change", F.col(value) - F.col("previous"))


def baseline(weekly: DataFrame, keys: list[str], value: str, back: int = 4) -> DataFrame:
    """weekly with the median of the value over the weeks 2 to back + 1 before."""
    past = weekly.select(*keys, F.explode(F.sequence(F.lit(2), F.lit(back + 1))).alias("_n"), "week", F.col(value).alias("_v")).select(*keys, F.expr("date_add(week, 7 * _n)").alias("week"), "_v")
    return weekly.join(past.groupBy(*keys, "week").agg(F.median("_v").alias("baseline")), [*keys, "week"], "left")


def retention(evidence: DataFrame, keys: list[str], delay: int = 3) -> DataFrame:
    """A row for each of keys: the accuracy of all topics on their own first days (immediate), and of all answers `delay` days
    or more after the first of their topic (delayed), the change in points, and how many answers are delayed; without any the
    status is NOT_ENOUGH_DATA. evidence has keys, topic, day, is_correct; rows without a topic or a day are left out."""
    known = evidence.filter("topic IS NOT NULL AND topic != '' AND day IS NOT NULL" if dict(evidence.dtypes)["topic"] == "string" else "topic IS NOT NULL AND day IS NOT NULL")
    first = F.min("day").over(Window.partitionBy(*keys, "topic"))
    after, ok = F.datediff("day", first), F.coalesce("is_correct", F.lit(False))
    x = known.select(*keys, after.alias("_after"), ok.alias("_ok"))
    now, late = F.col("_after") == 0, F.col("_after") >= delay
    out = x.groupBy(*keys).agg(F.count_if(now & F.col("_ok")).alias("_nk"), F.count_if(now).alias("_n"), F.count_if(late & F.col("_ok")).alias("_lk"), F.count_if(late).alias("delayed_items"))
    out = out.withColumns({"immediate": rounded_exactly(safe_rate(F.col("_nk"), F.col("_n"))), "delayed": rounded_exactly(safe_rate(F.col("_lk"), F.col("delayed_items")))})
    status = F.when(F.col("delayed_items") > 0, "AVAILABLE").otherwise("NOT_ENOUGH_DATA")
    return out.select(*keys, status.alias("status"), "immediate", "delayed", rounded_exactly(F.col("delayed") - F.col("immediate")).alias("change"), "delayed_items")


def expected_progress(assignments: DataFrame, keys: list[str], as_of: float | Column) -> DataFrame:
    """Expected against actual progress and the gap (actual - expected) in per cent, weighed by duration (1 if unknown), with the
    number of assignments; keys without any have no row, which reads as NOT_ENOUGH_DATA. assignments has keys, available, due,
    duration and coverage (per cent of the resource)."""
    at = as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    weight = F.when(F.col("duration") > 0, F.col("duration")).otherwise(1.0)
    due = clamp((at - F.col("available")) / F.greatest(F.col("due") - F.col("available"), F.lit(1.0)), 0.0, 1.0)
    done = clamp(F.coalesce(F.col("coverage"), F.lit(0.0)), 0.0, 100.0) / 100
    out = assignments.groupBy(*keys).agg(F.sum(weight).alias("_w"), F.sum(due * weight).alias("_e"), F.sum(done * weight).alias("_a"), F.count(F.lit(1)).alias("assigned"))
    out = out.withColumns({"expected": rounded_exactly(safe_rate(F.col("_e"), F.col("_w"))), "actual": rounded_exactly(safe_rate(F.col("_a"), F.col("_w")))})
    return out.select(*keys, F.lit("AVAILABLE").alias("status"), "expected", "actual", rounded_exactly(F.col("actual") - F.col("expected")).alias("gap"), "assigned")


def attention_counts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a map from playback context to the number of attempts in it, right or wrong; attempts without a context
    don't count, and keys without any have no row."""
    each = attempts.filter("context IS NOT NULL").groupBy(*keys, "context").count()
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("context", "count")))).alias("contexts"))


def action_plan(students: DataFrame, progress: DataFrame, topics: DataFrame, missed: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """key, position, action and subject of at most five actions a student: catch up (progress has key, gap), revise weak
    topics (key, topic, score, rank) up to three actions in all, retry the first missed checkpoint (key, subject, rank),
    watch the first skipped span (key, subject, rank); keep_going where no rule holds. Ties of rank go by subject."""
    part = lambda df, step, action, subject, rank: df.select(key, F.lit(step).alias("step"), F.lit(action).alias("action"), subject.cast("string").alias("subject"), rank.cast("double").alias("rank"))
    found = part(progress.filter(F.col("gap") < BEHIND), 1, "catch_up", F.lit(None), F.lit(0))
    found = found.unionByName(part(topics.filter(F.col("score") < REVISE), 2, "revise", F.col("topic"), F.col("rank")))
    found = found.unionByName(part(missed, 3, "retry", F.col("subject"), F.col("rank"))).unionByName(part(skipped, 4, "watch", F.col("subject"), F.col("rank")))
    behind = F.max((F.col("step") == 1).cast("int")).over(Window.partitionBy(key))
    nth = F.row_number().over(Window.partitionBy(key, "step").orderBy("rank", "subject"))
    most = F.when(F.col("step") == 2, TOPIC_ACTIONS - F.col("behind")).otherwise(1)
    kept = found.withColumns({"behind": behind, "nth": nth}).filter(F.col("nth") <= most).drop("behind")
    none = students.select(key).distinct().join(kept.select(key), key, "left_anti").select(key, F.lit(5).alias("step"), F.lit("keep_going").alias("action"), F.lit(None).cast("string").alias("subject"), F.lit(1).alias("nth"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("step", "nth"))
    return kept.drop("rank").unionByName(none).select(key, place.alias("position"), "action", "subject")
