"""Exact replay of player sessions with window functions only: one shuffle and one sort on the session's key.

Events have student_id, resource_id, session_id, id, event_type, video_ts, at (seconds) and rate, and are ordered by
(at, id). Play and heartbeat mean playing; pause, complete and tab_hidden don't; tab_visible restores what was so before
the tab was hidden (unmatched: not playing). Between two events at most max_gap seconds count, at the last rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import covered_seconds, repeated_spans

SESSION = ["student_id", "resource_id", "session_id"]
MAX_GAP, SEEK_SLACK, LEAST_RATE = 90.0, 2.0, 0.25


def replay(events: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """events with elapsed (watched seconds before the event), away, start and end (the span watched), seek (back, forward or none)."""
    order = Window.partitionBy(*SESSION).orderBy("at", "id")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("event_type")
    on, off = kind.isin("play", "heartbeat"), kind.isin("pause", "complete", "tab_hidden")
    hidden, visible = kind == "tab_hidden", kind == "tab_visible"
    last = lambda x, frame: F.last(x, ignorenulls=True).over(frame)
    x = events.withColumn("_n", F.row_number().over(order)).withColumn("_was", last(F.when(on | off | visible, kind), before))
    was = F.col("_was")
    # playing before a hidden tab; NULL: as the visible tab before it found
    own = F.when(was.isNull() | was.isin("pause", "complete", "tab_hidden"), 0).when(was.isin("play", "heartbeat"), 1)
    x = x.withColumn("_h", last(F.when(hidden, F.struct("_n", "at", own.alias("state"))), before)).withColumn("_pv", last(F.when(visible, F.col("_n")), before))
    unmatched = F.col("_h").isNull() | (F.col("_h._n") < F.coalesce("_pv", F.lit(0)))
    x = x.withColumn("_base", last(F.when(visible, F.when(unmatched, 0).otherwise(F.col("_h.state"))), upto))
    effect = F.when(on, 1).when(off, 0).when(visible, F.coalesce("_base", F.lit(0)))
    x = x.withColumn("away", F.when(visible & ~unmatched, F.greatest(F.col("at") - F.col("_h.at"), F.lit(0.0))).otherwise(0.0))
    x = x.withColumn("_playing", F.coalesce(last(effect, before), F.lit(0))).withColumn("_rate", last(F.when(on, F.coalesce("rate", F.lit(1.0))), before))
    rate = F.greatest(F.coalesce(F.nullif("_rate", F.lit(0.0)), F.lit(1.0)), F.lit(LEAST_RATE))
    gap = F.least(F.greatest(F.col("at") - F.lag("at").over(order), F.lit(0.0)), F.lit(float(max_gap)))
    x = x.withColumn("elapsed", F.when(F.col("_playing") == 1, F.coalesce(gap, F.lit(0.0))).otherwise(0.0))
    x = x.withColumn("start", F.greatest(F.coalesce(F.lag("video_ts").over(order), F.lit(0.0)), F.lit(0.0))).withColumn("end", F.col("start") + F.col("elapsed") * rate)
    seek = F.when(kind == "seek", F.when(F.col("video_ts") < F.col("end") - SEEK_SLACK, "back").when(F.col("video_ts") > F.col("end") + SEEK_SLACK, "forward").otherwise("none"))
    return x.withColumn("seek", seek).drop("_n", "_was", "_h", "_pv", "_base", "_playing", "_rate")


def session_totals(replayed: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over keys; each session's times are rounded before they are added."""
    per = replayed.groupBy(*SESSION).agg(F.bround(F.sum("elapsed"), 1).alias("watch"), F.bround(F.sum("away"), 1).alias("away"), F.count_if(F.col("seek") == "back").alias("back"), F.count_if(F.col("seek") == "forward").alias("forward"), F.count("seek").alias("seeks"), F.bool_or(F.col("event_type") == "complete").alias("completed"))
    return per.groupBy(*keys).agg(F.sum("watch").alias("watch"), F.sum("away").alias("away"), F.sum("back").alias("back"), F.sum("forward").alias("forward"), F.sum("seeks").alias("seeks"), F.bool_or("completed").alias("completed"), F.count(F.lit(1)).alias("sessions"))


def resource_report(events: DataFrame, durations: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """One line for each student and resource: totals and the part of the duration that was watched."""
    keys = ["student_id", "resource_id"]
    done = replay(events, max_gap)
    covered = covered_seconds(done.select(*keys, "start", "end"), keys)
    out = session_totals(done, keys).join(covered, keys, "left").join(durations, "resource_id", "left")
    seen = F.least(F.coalesce("covered", F.lit(0.0)), F.coalesce("duration", F.lit(float("inf"))))
    return out.withColumn("covered", seen).withColumn("coverage", F.when(F.col("duration") > 0, 100 * seen / F.col("duration")))


def playback_context(attempts: DataFrame, events: DataFrame, look_back: float = 120.0, least_span: float = 5.0) -> DataFrame:
    """attempts (session key, attempt_id, shown_at, checkpoint_ts) with what went before; events are replayed. The first rule
    that holds: the tab is hidden by the last tab event before it, however long ago; within the look-back a seek to a place
    before that of the event before it (which must be within it too); a pause; the checkpoint lies in a stretch of at least
    least_span seconds that the session watched twice; within the look-back something happened, and no pause, seek or tab
    event. Attempts and events are put in one order, so a session is shuffled once. Null times or places meet no rule; an
    attempt without events is `other`; equal attempts are all returned."""
    order = Window.partitionBy(*SESSION).orderBy("at", "id")
    kind, tab = F.col("event_type"), F.col("event_type").isin("tab_hidden", "tab_visible")
    back = F.when((kind == "seek") & (F.col("video_ts") < F.lag("video_ts").over(order)), F.lag("at").over(order))
    seen = events.select(*SESSION, "at", F.lit(0).alias("_kind"), "id", F.lit(None).cast("bigint").alias("_nth"), F.when(tab, kind).alias("_tab"), back.alias("_back"), (kind == "pause").alias("_pause"), (tab | kind.isin("pause", "seek")).alias("_break"))
    nth = attempts.withColumn("_nth", F.monotonically_increasing_id())
    none = {"_tab": "string", "_back": "double", "_pause": "boolean", "_break": "boolean"}
    asked = nth.select(*SESSION, F.col("shown_at").alias("at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("id"), "_nth", *[F.lit(None).cast(t).alias(k) for k, t in none.items()])
    before = Window.partitionBy(*SESSION).orderBy("at", "_kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    recent = Window.partitionBy(*SESSION).orderBy((F.col("at") * 1_000_000).cast("bigint")).rangeBetween(-int(look_back * 1_000_000), Window.currentRow)
    flags = seen.unionByName(asked).withColumns({"_tab": F.last("_tab", ignorenulls=True).over(before), "_back": F.max("_back").over(recent) >= F.col("at") - look_back, "_pause": F.max("_pause").over(recent), "_break": F.max("_break").over(recent)})
    twice = repeated_spans(events.select(*SESSION, "start", "end"), SESSION, least_span)
    again = nth.join(twice, SESSION).filter(F.col("checkpoint_ts").between(F.col("start"), F.col("end"))).select("_nth").distinct().withColumn("_again", F.lit(True))
    context = F.when(F.col("_tab") == "tab_hidden", "page_hidden").when(F.col("_back"), "after_backward_seek").when(F.col("_pause"), "after_pause").when(F.col("_again"), "after_rewatch").when(~F.col("_break"), "after_uninterrupted_viewing").otherwise("other")
    out = nth.join(flags.filter("_kind = 1").select("_nth", "_tab", "_back", "_pause", "_break"), "_nth", "left").join(again, "_nth", "left")
    return out.withColumn("context", context).drop("_nth", "_tab", "_back", "_pause", "_break", "_again")


def study_sessions(events: DataFrame) -> DataFrame:
    """First, last and end (the last complete or tab_hidden) of each session."""
    return events.groupBy(*SESSION).agg(F.min("at").alias("started_at"), F.max("at").alias("last_event_at"), F.max(F.when(F.col("event_type").isin("complete", "tab_hidden"), F.col("at"))).alias("ended_at"), F.count(F.lit(1)).alias("n_events"))


def longest_inactive_run(days: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """keys and the longest run of days of [first, last] without activity; days has keys and day."""
    inside = days.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(*keys, "day").distinct()
    tail = inside.select(*keys).distinct().withColumn("day", F.date_add(F.lit(last).cast("date"), 1))
    order = Window.partitionBy(*keys).orderBy("day")
    gap = F.datediff("day", F.coalesce(F.lag("day").over(order), F.date_sub(F.lit(first).cast("date"), 1))) - 1
    return inside.unionByName(tail).select(*keys, gap.alias("_gap")).groupBy(*keys).agg(F.max("_gap").alias("longest_inactive"))


def daily_series(values: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """keys, day and value for every day of [first, last], days without a value as 0; values has keys, day, value."""
    calendar = values.select(*keys).distinct().withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    summed = values.groupBy(*keys, "day").agg(F.sum("value").alias("value"))
    return calendar.join(summed, [*keys, "day"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
