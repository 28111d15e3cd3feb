"""The weekly report against the published validation scenario, and by hand for its edges."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import filled, rounded_exactly
from lectern.operators import scoring, weekly

TABLES = {
    "members": "student_id int, course_id int",
    "resources": "course_id int, resource string, title string, duration double",
    "events": "student_id int, resource string, session_id string, id int, event_type string, video_ts double, at double, rate double",
    "quiz": "student_id int, course_id int, resource string, question_id string, topic string, is_correct boolean, at double, learning_objective string, difficulty string, cognitive_level string",
    "checkpoints": "student_id int, course_id int, resource string, session_id string, attempt_id int, topic string, place double, shown_at double, answered_at double, response_ms double, allowed_s double, is_correct boolean, skipped boolean, timed_out boolean, attempt_number int",
    "assignments": "course_id int, resource string, week_start date, available double, due double, duration double, required boolean",
    "chats": "student_id int, course_id int, topic string, content string, grounded boolean, at double",
    "retention": "student_id int, course_id int, topic string, at double, is_correct boolean",
}
SINCE = dt.datetime(2026, 8, 31, 21, tzinfo=dt.UTC).timestamp()
DAY = 86400.0


def tables(spark, **rows):
    return [spark.createDataFrame(rows.get(k, []), schema) for k, schema in TABLES.items()]


@pytest.fixture(scope="module")
def scenario(spark):
    now, before = SINCE + 9 * 3600, SINCE - 7 * DAY + 9 * 3600
    later = now + 3 * DAY
    made = []
    for start, session, steps in (
        (before, "p", [(0, "play", 0), (30, "heartbeat", 30), (60, "pause", 60)]),
        (now, "a", [(0, "play", 0), (30, "heartbeat", 30), (40, "seek", 300), (70, "heartbeat", 330), (100, "pause", 360)]),
        (later, "b", [(0, "play", 300), (30, "heartbeat", 330), (60, "seek", 300), (90, "heartbeat", 330), (120, "pause", 360)]),
    ):
        made += [(1, "v", session, len(made) + i, kind, float(place), start + t, 1.0) for i, (t, kind, place) in enumerate(steps)]

    def check(i, question_place, shown, session, answer, timeout=False):
        answered = answer is not None
        return (1, 2, "v", session, i, "column", float(question_place), shown, shown + 10 if answered else None, 10000.0 if answered else None, 20.0, answer, False, timeout, 1)

    checks = [check(1, 60, before + 65, "p", False), check(2, 60, now + 65, "a", True), check(3, 210, now + 75, "a", False), check(4, 330, later + 95, "b", True), check(5, 480, later + 125, "b", None, True)]
    quiz = [(1, 2, None, f"exam:{i}", "column", ok, now + 600, "structures", "medium", "understanding") for i, ok in enumerate((True, True, False))]
    kept = [(1, 2, "column", SINCE - 4 * DAY, True)] * 2 + [(1, 2, "column", now, False)]
    chats = [(1, 2, "column", text, ok, now + i) for i, (text, ok) in enumerate([("What is  T1?", True), ("what is t1? ", False), ("else", None)])]
    chats.append((1, 2, "column", "too late", True, SINCE + 7 * DAY))
    args = tables(spark, members=[(1, 2), (9, 2)], resources=[(2, "v", "Column", 600.0), (2, "w", "Unknown", None)], events=made, quiz=quiz, checkpoints=checks, assignments=[(2, "v", dt.date(2026, 9, 1), SINCE, SINCE + 7 * DAY, 600.0, True)], chats=chats, retention=kept)
    found = weekly.weekly_reports(weekly.Week("2026-09-01", "Africa/Cairo"), *args, as_of=SINCE + 0.968 * 7 * DAY)
    return {r.student_id: r for r in found.collect()}


def test_published_figures(scenario):
    r = scenario[1]
    assert (str(r.week_start), str(r.week_end)) == ("2026-09-01", "2026-09-07")
    assert (r.totals.coverage, r.totals.watch, r.totals.active_days, r.totals.accuracy) == (16.7, 220.0, 2, 66.7)
    c = r.checkpoints
    assert (c.shown, c.answered, c.correct, c.median_response, c.accuracy, c.completion, c.timeout_rate) == (4, 3, 2, 10.0, 66.7, 75.0, 25.0)
    assert c.median_allowed_share == 50.0
    m = r.mastery.overall
    assert (m.score, m.confidence, m.evidence_items) == (64.2, "MEDIUM", 6)
    t = r.trend
    assert tuple(t.coverage) == (10.0, 16.7, 6.7) and tuple(t.active_days) == (1, 2, 1)
    assert (r.progress.status, r.progress.expected, r.progress.actual, r.progress.gap, r.progress.assigned) == ("AVAILABLE", 96.8, 16.7, -80.1, 1)
    assert (r.retention.status, r.retention.immediate, r.retention.delayed, r.retention.change) == ("AVAILABLE", 100.0, 0.0, -100.0)
    assert r.baseline.coverage == 0.0 and r.baseline.mastery is None


def test_document_sections(scenario):
    r = scenario[1]
    line, other = r.lectures
    assert (line.title, line.opened, line.sessions, line.seeks, line.seeks_back, line.seeks_forward) == ("Column", True, 2, 2, 1, 1)
    assert [(s.start, s.end) for s in line.skipped] == [(40.0, 300.0), (360.0, 600.0)]
    assert [(s.start, s.end) for s in line.rewatched] == [(300.0, 360.0)]
    assert (other.known, other.opened, other.coverage, other.skipped) == (False, False, None, [])
    assert [d.active for d in r.totals.by_day] == [True, False, False, True, False, False, False] and sum(d.watch for d in r.totals.by_day) == 220.0
    assert r.consistency.longest_idle == 3 and r.consistency.sessions_a_day == 1.0 and r.consistency.last_two_days == 0.0
    assert [a.action for a in r.actions] == ["catch_up", "revise", "retry", "watch"]
    assert (r.actions[2].resource, r.actions[2].place) == ("v", 480.0) and (r.actions[3].place, r.actions[3].evidence) == (40.0, 300.0)
    assert [i.kind for i in r.insights] == ["checkpoints", "weakest_topic"]
    assert (r.chat.questions, r.chat.grounded) == (3, 1) and [tuple(q) for q in r.chat.repeated] == [("what is t1?", 2)] and [tuple(q) for q in r.chat.confusing] == [("column", 3)]
    assert {b.dimension for b in r.analysis.breakdown} == {"topic", "learning_objective", "difficulty", "cognitive_level"}
    assert [t.topic for t in r.topics] == ["column"] and r.strengths == [] and r.weaknesses == []
    assert sum(r.checkpoints.contexts.values()) == 4


def test_member_without_evidence(scenario):
    r = scenario[9]
    assert (r.totals.watch, r.totals.opened, r.totals.registered, r.totals.accuracy, r.totals.coverage) == (0.0, 0, 2, None, 0.0)
    assert (r.mastery.overall.score, r.mastery.overall.confidence) == (None, "LOW") and r.checkpoints.shown == 0 and r.checkpoints.accuracy is None
    assert r.retention.status == "NOT_ENOUGH_DATA" and r.chat.questions == 0 and r.consistency.longest_idle == 7 and r.consistency.active_days == 0
    assert r.lectures[0].skipped == [] and r.lectures[0].mastery.score is None


def test_all_tables_empty(spark):
    assert weekly.weekly_reports(weekly.Week("2026-09-01"), *tables(spark)).collect() == []
    (r,) = weekly.weekly_reports(weekly.Week("2026-09-01"), *tables(spark, members=[(1, 2)])).collect()
    assert r.student_id == 1 and r.lectures is not None and [a.action for a in r.actions] == ["keep_going"]


def test_week_over_a_change_of_clocks(spark):
    # Cairo put its clocks forward on 26 April 2024: that week has 167 hours
    week = weekly.Week("2024-04-22", "Africa/Cairo")
    (r,) = spark.range(1).select(week.since.alias("a"), week.until.alias("b"), *[week.back(F.lit(x)).alias(f"n{i}") for i, x in enumerate([0.0])]).collect()
    assert r.b - r.a == 167 * 3600 and r.n0 is None
    at = [(r.a - 0.5, 1), (r.a, 0), (r.b - 0.5, 0), (r.b, None), (r.a - 7 * DAY, 1), (r.a - 7 * DAY - 1, 2), (r.a - 35 * DAY, 5), (r.a - 35 * DAY - 1, None)]
    got = spark.createDataFrame(at, "at double, n int").select(week.back(F.col("at")).alias("b"), "n").collect()
    assert [x.b for x in got] == [x.n for x in got]


def test_sitting_cut_at_the_edge(spark):
    week = weekly.Week("2026-09-01", "Africa/Cairo")
    steps = [(-40.0, "play", 0.0), (-10.0, "heartbeat", 30.0), (20.0, "heartbeat", 60.0), (50.0, "pause", 90.0)]
    events = [(1, "v", "s", i, k, p, SINCE + t, 1.0) for i, (t, k, p) in enumerate(steps)]
    args = tables(spark, members=[(1, 2)], resources=[(2, "v", "V", 600.0)], events=events)
    got = {r.back: (r.watch, r.sessions) for r in weekly.week_lines(week, *args[:3]).collect()}
    assert got == {1: (30.0, 1), 0: (30.0, 1)}


def brute_line(spans, duration):
    """covered, holes of 30 s or more, stretches of depth two of 30 s or more."""
    merged = []
    for a, b in sorted(s for s in spans if s[1] > s[0]):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    holes, at = [], 0.0
    for a, b in merged:
        if a - at >= 30:
            holes.append((at, a))
        at = max(at, b)
    if duration - at >= 30:
        holes.append((at, duration))
    places = sorted({x for s in spans if s[1] > s[0] for x in s})
    deep = []
    for a, b in zip(places, places[1:], strict=False):
        if sum(s[0] <= a and s[1] >= b for s in spans if s[1] > s[0]) >= 2:
            if deep and deep[-1][1] == a:
                deep[-1][1] = b
            else:
                deep.append([a, b])
    out = []
    for a, b in deep:
        if b - a >= 30:
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return round(sum(b - a for a, b in merged), 1), holes, out


def test_sweep_against_brute_force(spark):
    rng = random.Random(3)
    events, spans = [], {}
    for k in range(40):
        session, n = f"s{k % 3}", 0
        for student in (k,):
            at = 0.0
            for _ in range(rng.randint(1, 25)):
                place = float(rng.randint(0, 40) * 15)
                events.append((student, "v", session, n, rng.choice(["play", "heartbeat", "pause", "seek"]), place, SINCE + at, 1.0))
                at += rng.choice([0.0, 15.0, 30.0, 60.0])
                n += 1
    frame = spark.createDataFrame(events, TABLES["events"]).withColumnRenamed("resource", "resource_id")
    for r in weekly.replay(frame).collect():
        spans.setdefault(r.student_id, []).append((r.start, r.end))
    lines = weekly.lecture_lines(frame.withColumn("duration", F.lit(500.0)), ["student_id", "resource_id", "duration"], ["student_id", "resource_id"])
    got = {r.student_id: r for r in lines.withColumn("skipped", weekly.skipped(F.col("duration"))).collect()}
    assert len(got) == 40
    for k, r in got.items():
        covered, holes, deep = brute_line(spans[k], 500.0)
        assert (r.covered, [tuple(s) for s in r.skipped], [tuple(s) for s in r.rewatched]) == (covered, holes, deep), k


def test_lines_shuffle_once(spark):
    frame = spark.createDataFrame([], TABLES["events"]).withColumnRenamed("resource", "resource_id")
    plan = weekly.lecture_lines(frame, ["student_id", "resource_id"], ["student_id", "resource_id"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hash|range|single)", plan)) == 1


def test_retention_is_pooled(spark):
    d = dt.date(2026, 1, 1)
    rows = [(1, "a", d, True), (1, "b", d, False), (1, "a", d + dt.timedelta(3), True), (1, "a", d + dt.timedelta(2), False), (2, "a", d, True), (2, None, d, True), (2, "c", None, True)]
    got = {r.s: tuple(r)[1:] for r in scoring.retention(spark.createDataFrame(rows, "s int, topic string, day date, is_correct boolean"), ["s"]).collect()}
    assert got == {1: ("AVAILABLE", 50.0, 100.0, 50.0, 1), 2: ("NOT_ENOUGH_DATA", 100.0, None, None, 0)}


def test_confidence_needs_a_topic(spark):
    (r,) = spark.range(1).select(scoring.confidence(F.lit(8), F.lit(2), F.lit(True)).alias("a"), scoring.confidence(F.lit(8), F.lit(2), F.lit(False)).alias("b"), scoring.confidence(F.lit(8), F.lit(2)).alias("c")).collect()
    assert tuple(r) == ("HIGH", "MEDIUM", "HIGH")


def test_progress_is_weighed(spark):
    rows = [(1, 0.0, 100.0, 300.0, 50.0), (1, 0.0, 100.0, None, 200.0), (1, 50.0, 150.0, 100.0, None)]
    (r,) = scoring.expected_progress(spark.createDataFrame(rows, "s int, available double, due double, duration double, coverage double"), ["s"], 75.0).collect()
    assert (r.status, r.expected, r.actual, r.gap, r.assigned) == ("AVAILABLE", round(100 * (0.75 * 301 + 25) / 401, 1), round(100 * 151 / 401, 1), round(37.7 - 62.5, 1), 3)


def test_exact_rounding_is_pythons(spark):
    rng = random.Random(1)
    xs = [2.675, 0.25, 0.35, 0.15, -0.25, -2.675, 1e300, -1e16, 4503599627370497.5, 0.0, 0.05, 1.005, 5e-324, math.inf]
    xs += [rng.uniform(-1e6, 1e6) for _ in range(40_000)] + [rng.randint(-10**7, 10**7) / 1000 for _ in range(40_000)] + [rng.randint(-(10**6), 10**6) / 2**rng.randint(1, 12) for _ in range(20_000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", rounded_exactly(F.col("x"), 1).alias("a"), rounded_exactly(F.col("x"), 2).alias("b")).collect()
    for r in got:
        assert (r.a, r.b) == (round(r.x, 1), round(r.x, 2)), r.x


def test_templates(spark):
    rows = [("a {x} and {y}{x}", {"x": "1{y}", "y": "2"}), ("{gone} {x", {"x": "1"}), (None, {}), ("", None)]
    got = [r.t for r in spark.createDataFrame(rows, "t string, v map<string,string>").select(filled(F.col("t"), F.col("v")).alias("t")).collect()]
    assert got == ["a 1{y} and 21{y}", "{gone} {x", None, ""]


def test_responses_may_come_in_seconds(spark):
    # their median is the double 2.05, a little under the tie; over milliseconds (20.01 * 100 / 1000) it lies above it
    seconds = [20.01 / 10, 20.99 / 10]
    rows = [(1, 2, 1.0, x, 20.0, True, False, False, 1) for x in seconds]
    checks = spark.createDataFrame(rows, "student_id int, course_id int, answered_at double, response_s double, allowed_s double, is_correct boolean, skipped boolean, timed_out boolean, attempt_number int")
    assert weekly._checks(checks, weekly.KEYS).collect()[0].median_response == 2.0
