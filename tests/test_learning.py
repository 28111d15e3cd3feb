import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import redacted_url, host_allowed
from lectern.operators import access, exam, intervals, jobs, memory, replay, retrieval, scoring
from lectern.plans import Target, checked, diagnose, outcome, search
from lectern import sources, streaming

EVENT = "student_id bigint, resource_id bigint, session_id string, id bigint, event_type string, video_ts double, at double, rate double"


def fold(events, max_gap):
    """One session's replay, event by event."""
    playing, saved, rate, prev, hidden = False, None, 1.0, None, None
    watch = away = 0.0
    back = forward = 0
    spans = []
    for kind, video, at, r in events:
        elapsed = 0.0
        anchor = max((prev[0] if prev else 0.0) or 0.0, 0.0)
        if prev and playing:
            elapsed = min(max(at - prev[1], 0), max_gap)
        watch += elapsed
        expected = anchor + elapsed * rate
        if elapsed:
            spans.append((anchor, expected))
        if kind == "seek":
            back += video < expected - 2
            forward += video > expected + 2
        elif kind in ("play", "heartbeat"):
            playing, rate = True, max(r if r else 1.0, 0.25)
        elif kind in ("pause", "complete"):
            playing = False
        elif kind == "tab_hidden":
            saved, hidden, playing = playing, at, False
        elif kind == "tab_visible":
            if hidden is not None:
                away += max(at - hidden, 0)
            playing = bool(saved) if hidden is not None else False
            hidden = saved = None
        prev = (video, at)
    return round(watch, 3), round(away, 3), back, forward, spans


def test_replay_equals_a_fold(spark):
    rng = random.Random(4)
    kinds = ["play", "heartbeat", "pause", "complete", "tab_hidden", "tab_visible", "seek"]
    sessions, rows = {}, []
    for k in range(300):
        at, sessions[str(k)] = 0.0, []
        for i in range(rng.randint(1, 14)):
            at += rng.choice([0, 1, 20, 200])
            e = (rng.choice(kinds), rng.choice([-5.0, 0.0, 10.0, 50.0, 300.0]), at, rng.choice([None, 0.0, 0.1, 1.0, 2.0]))
            sessions[str(k)].append(e)
            rows.append((k % 7, 1, str(k), i, *e))
    rng.shuffle(rows)
    done = replay.replay(spark.createDataFrame(rows, EVENT), 90.0)
    got = {r.session_id: r for r in done.groupBy("session_id").agg(F.sum("elapsed").alias("w"), F.sum("away").alias("a"), F.count_if(F.col("seek") == "back").alias("b"), F.count_if(F.col("seek") == "forward").alias("f"), F.sum(F.col("end") - F.col("start")).alias("l")).collect()}
    for k, events in sessions.items():
        watch, away, back, forward, spans = fold(events, 90.0)
        r = got[k]
        assert (round(r.w, 3), round(r.a, 3), r.b, r.f) == (watch, away, back, forward), events
        assert abs(r.l - sum(e - s for s, e in spans)) < 1e-6
    assert replay.replay(spark.createDataFrame([], EVENT)).count() == 0


def test_intervals_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, float(a), float(a + rng.randint(-2, 40))) for k in range(40) for a in (rng.randint(0, 200) for _ in range(rng.randint(1, 9)))]
    spans = spark.createDataFrame(rows, "k bigint, start double, end double")
    cover = lambda k, n: {t for t in range(300) if sum(s <= t < e for q, s, e in rows if q == k) >= n}
    union, twice, gaps = {}, {}, {}
    for r in intervals.merge_spans(spans, ["k"], 0.0).collect():
        union.setdefault(r.k, set()).update(range(int(r.start), int(r.end)))
    for r in intervals.repeated_spans(spans, ["k"], 0.0).collect():
        twice.setdefault(r.k, set()).update(range(int(r.start), int(r.end)))
    durations = spark.createDataFrame([(k, 250.0) for k in range(40)] + [(99, None)], "k bigint, duration double")
    for r in intervals.missing_spans(spans, durations, ["k"], 30.0).collect():
        gaps.setdefault(r.k, []).append((r.start, r.end))
    for k in range(40):
        assert union.get(k, set()) == cover(k, 1) and twice.get(k, set()) == cover(k, 2)
        for s, e in gaps.get(k, []):
            assert e - s >= 30 and not cover(k, 1) & set(range(int(s), int(e)))
    assert 99 not in gaps
    p = spark.createDataFrame([(1, 10.0, 40.0, 0.3), (1, 60.0, 90.0, 0.2), (1, 200.0, 210.0, 0.1), (2, 1.0, 5.0, 0.4)], "video_id bigint, start double, end double, distance double")
    assert sorted(map(tuple, intervals.segments(p).collect())) == [(1, 7.0, 90.0, 0.2, 2), (1, 197.0, 210.0, 0.1, 1), (2, 0.0, 5.0, 0.4, 1)]


def test_exam_figures(spark):
    scores = spark.createDataFrame([(x,) for x in [0.0, 19.9, 20.0, 40.0, 59.9, 60.0, 80.0, 100.0]], "score double")
    assert [r.n for r in exam.histogram(scores).orderBy("bin").collect()] == [2, 1, 2, 1, 2]
    assert [r.n for r in exam.histogram(scores.limit(0)).collect()] == [0] * 5
    same = spark.createDataFrame([(s, q, s % 2 == 0) for s in range(12) for q in range(3)] + [(s, 3, True) for s in range(12)], "student_id bigint, question_id bigint, final_correct boolean")
    got = {r.question_id: r for r in exam.item_rest(same).collect()}
    assert got[0].correlation == pytest.approx(1.0) and got[3].correlation is None and got[0].discrimination == "good"
    assert all(r.correlation is None for r in exam.item_rest(same.filter("student_id < 9")).collect())


def test_mastery_and_checkpoints(spark):
    x = spark.createDataFrame([(70.0, 50.0, 80.0), (None, 50.0, None), (None, None, 90.0)], "a double, b double, c double")
    got = [r.m for r in x.select(scoring.mastery(F.col("a"), F.col("b"), F.col("c")).alias("m")).collect()]
    assert got[0] == pytest.approx(63.5) and got[1] == pytest.approx(50.0) and got[2] is None
    rows = [(None, True, False, False, None, 10.0, 1, 20.0), (None, None, True, False, 1, 90.0, None, 30.0), (None, False, False, True, 0, 20.0, 1, 0.0), (None, True, False, False, 2, 30.0, 1, 60.0)]
    schema = "topic string, is_correct boolean, skipped boolean, timed_out boolean, attempt_number int, response_s double, answered_at int, allowed_s double"
    (r,) = scoring.checkpoint_bundle(spark.createDataFrame(rows, schema), ["topic"]).collect()
    assert (r.shown, r.answered, r.correct, r.skipped, r.median_response, r.completion, r.first_accuracy, r.median_allowed_share, r.timeout_rate) == (4, 3, 2, 1, 20.0, 75.0, 50.0, 50.0, 25.0)
    assert scoring.checkpoint_bundle(spark.createDataFrame([], schema), ["topic"]).count() == 0
    assert scoring.attention_counts(spark.createDataFrame([(1, False, "other"), (1, True, "other"), (1, False, "after_pause")], "s int, is_correct boolean, context string"), ["s"]).first().contexts == {"other": 2, "after_pause": 1}


def test_chunks_and_memory(spark):
    words = [f"w{i}" + ("." if i % 50 == 49 else "") for i in range(300)]
    # an end at word 100 is within 25 words of 120, that at 150 isn't within 25 of 195
    assert retrieval.chunk_bounds(words, 120, 25) == [(0, 100), (75, 195), (170, 300)]
    assert retrieval.chunk_bounds(["w"] * 200, 120, 25) == [(0, 120), (95, 200)]
    assert retrieval.chunk_bounds(["w"] * 225, 120, 25) == [(0, 120), (95, 225)]  # the last 35 words join the chunk before
    assert retrieval.chunk_bounds([*["w"] * 110, "x؟", *["w"] * 60], 120, 25) == [(0, 111), (86, 171)]
    assert retrieval.chunk_bounds([*["w"] * 90, "x.", *["w"] * 80], 120, 25) == [(0, 120), (95, 171)]
    assert retrieval.chunk_bounds(["w"] * 30, 120, 25) == [(0, 30)] and retrieval.chunk_bounds([], 120, 25) == []
    with pytest.raises(ValueError):
        retrieval.chunk_texts(spark.range(1), 100, 50)
    blocks = spark.createDataFrame([(1, " ".join(words), 0, 300), (2, None, 0, 1), (3, "", 0, 1)], "block_id bigint, text string, start_ts bigint, end_ts bigint")
    got = retrieval.chunk_texts(blocks).collect()
    assert {r.block_id for r in got} == {1} and all(r.end_ts > r.start_ts for r in got)
    p = spark.createDataFrame([(1, 0, 5, 34), (1, 1, 6, 80), (1, 2, 5, 10), (1, 3, 7, 34), (1, 4, 8, 1), (2, 0, 5, 200)], "key bigint, rank bigint, chunk_id bigint, tokens bigint")
    assert sorted((r.key, r["rank"]) for r in memory.packed(p, 100).collect()) == [(1, 0), (1, 3)]
    assert memory.packed(p.limit(0), 100).count() == 0
    m = spark.createDataFrame([(1, 0, "assistant", "x"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (1, 4, "user", "d")], "conv_id bigint, turn bigint, role string, text string")
    # each message counts 1 and 4 more; a question that has no answer yet is a turn
    assert sorted((r.user_turn, r.assistant_turn or 0, r.tokens) for r in memory.turns(m).collect()) == [(1, 2, 10), (4, 0, 5)]
    assert [(r.user_turn, r.used) for r in memory.recent_turns(memory.turns(m), 14).collect()] == [(4, 5)]
    marks = spark.createDataFrame([(1, 1)], "conv_id bigint, checkpoint bigint")
    summed = lambda least, **k: sorted(r.turn for r in memory.to_summarise(m, least, 2, **k).collect())
    assert summed(15) == [0, 1, 2] and summed(16) == [] and summed(5, checkpoints=marks) == [2]
    chunks = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.1]), (3, 2, [0.0, 1.0])], "vec_id bigint, video_id bigint, embedding array<float>")
    assert [(r.vec_id, r.fallback) for r in retrieval.search_or_siblings(chunks, [1.0, 0.0], 1, [2]).collect()] == [(1, False)]
    assert [(r.vec_id, r.fallback) for r in retrieval.search_or_siblings(chunks, [1.0, 0.0], 7, [2]).collect()] == [(2, True)]


def test_access(spark):
    results = spark.createDataFrame([(1, 1, 1, "yes"), (1, 2, 1, "partial"), (1, 1, 2, "contradicted")], "question_id int, criterion_id int, answer_id int, status string")
    criteria = spark.createDataFrame([(1, 1, 3), (1, 2, 1)], "question_id int, criterion_id int, m int").withColumn("marks", F.col("m").cast("decimal(10,2)"))
    got = {r.answer_id: r for r in access.rubric_scores(results, criteria).collect()}
    assert got[1].points == 3.5 and got[2].points is None and got[2].problem == "missing" and not got[2].complete
    odd = spark.createDataFrame([(1, 1, 3, "yes"), (1, 2, 3, "yes"), (1, 9, 3, "yes"), (1, 1, 4, "yes"), (1, 2, 4, "yes"), (1, 2, 4, "no"), (1, 1, 5, "yes"), (1, 2, 5, None)], results.schema)
    assert [(r.answer_id, r.problem, r.points) for r in access.rubric_scores(odd, criteria, 2.0).orderBy("answer_id").collect()] == [(3, "unknown", None), (4, "repeated", None), (5, None, 2.0)]
    plain = criteria.withColumn("marks", F.when(F.col("criterion_id") == 1, F.col("marks")))
    assert {r.answer_id: r.points for r in access.rubric_scores(results, plain).collect()} == {1: 7.5, 2: None}
    jobs = spark.createDataFrame([(1, 3, "failed", 4, 5, "r", None), (2, 1, "failed", 5, 5, "r", None), (3, 2, "done", 0, 5, "r", None), (4, 4, "pending", 0, 5, "r", "2020-01-01")], "id int, created_at int, status string, attempt_count int, max_attempts int, remote_id string, s string").withColumn("started_at", F.to_timestamp("s"))
    assert [(r.id, r.attempt_count, r.remote_id, str(r.started_at)[:10]) for r in access.claimable(jobs, 5, "2024-02-02").collect()] == [(1, 5, None, "2024-02-02"), (4, 1, None, "2020-01-01")]
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string"), spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, None)], "k int, v int, x string")
    assert {r.k: r.x for r in access.upserted(old, new, ["k"], "v").collect()} == {1: "c", 2: "b", 3: None}
    need = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "course int, item int")
    done = spark.createDataFrame([(7, 1, 1), (7, 1, 2), (8, 1, 1), (8, 2, 9)], "s int, course int, item int")
    assert [(r.s, r.course) for r in access.completed_all(done, need, ["s"], ["course"], "item").collect()] == [(7, 1)]


def test_catalog(spark):
    rows = spark.createDataFrame([(1, "Algebra", 3), (2, "algebra II", 9), (3, None, 1)], "id int, name string, level int")
    t = Target(rows, "id", {"name": "text", "level": "number"}, {"lesson": (spark.createDataFrame([(2, "intro")], "course int, title string"), "course", {"title": "text"})})
    name = {"column": "name", "op": "contains", "value": "ALG"}
    assert [r.id for r in search({"filters": [name]}, t).collect()] == [1, 2]
    assert outcome({"filters": [name]}, t) == "choose" and outcome({"filters": [name, {"table": "lesson", "column": "title", "op": "eq", "value": "Intro"}]}, t) == "go"
    # clarify and unsupported are the plan's to say; without filters, or with none that can be used, the search runs
    assert [outcome({"intent": i}, t) for i in ("clarify", "unsupported", "search")] == ["clarify", "unsupported", "choose"] and outcome({"filters": [{"column": "x", "op": "eq", "value": 1}]}, t) == "choose"
    assert outcome({"filters": [{"column": "name", "op": "eq", "value": "none such"}]}, t) == "none"
    good = checked({"filters": [{"column": "level", "op": "eq", "value": "x"}, {"column": "name", "op": "in", "value": []}], "limit": 99}, t)
    assert (good["filters"], good["limit"], len(good["dropped"]), checked({}, t)["limit"]) == ([], 50, 2, 20)
    assert {r.position: r.n for r in diagnose({"filters": [name, {"column": "level", "op": "gte", "value": 5}]}, t).collect()} == {-1: 1, 0: 2, 1: 1}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("===== one | 00:00:05 --> 00:01:00 =====\nhello  there\n===== two | 00:01:00 --> 01:00:00 =====\nbye\n")
    got = sources.transcripts(spark, str(tmp_path / "a.txt")).orderBy("block").collect()
    assert [(r.name, r.start_ts, r.end_ts, r.text) for r in got] == [("one", 5, 60, "hello there"), ("two", 60, 3600, "bye")]
    raw = spark.createDataFrame([(1, json.dumps([{"start": 1.5, "end": 1.6, "text": "x"}])), (2, "nonsense")], "video_id int, json string")
    assert sorted((r.video_id, r.start, r.end, r.bad) for r in sources.speech(raw).collect() if not r.bad) == [(1, 1, 2, False)]
    assert [r.video_id for r in sources.speech(raw).filter("bad").collect()] == [2]
    path = str(tmp_path / "chunks")
    sources.replace_chunks(spark.createDataFrame([(1, "a"), (2, "b")], "video_id int, text string"), path)
    sources.replace_chunks(spark.createDataFrame([(1, "c")], "video_id int, text string"), path)
    assert sorted((r.video_id, r.text) for r in spark.read.parquet(path).collect()) == [(1, "c"), (2, "b")]
    sources.save_report(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), str(tmp_path / "report"))
    urls = spark.createDataFrame([("https://a.com/x?token=1&k=2",), ("https://a.com/x?expires=1",), ("http://a.com/",), ("https://u@a.com/",)], "u string")
    assert [tuple(r) for r in urls.select(redacted_url(F.col("u")), host_allowed(F.col("u"), ["A.com"])).collect()] == [("https://a.com/x?k=2", True), ("https://a.com/x?…", True), ("http://a.com/", False), ("https://u@a.com/", False)]


def test_streaming(spark, tmp_path):
    rows = [(1, "a", "s1", "play", "2024-01-01 00:00:00"), (1, "a", "s1", "play", "2024-01-01 00:00:00"), (1, None, "s1", "complete", "2024-01-01 00:05:00"), (1, None, "s1", "complete", "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "student_id bigint, client_event_id string, session_id string, event_type string, t string").withColumn("created_at", F.col("t").cast("timestamp")).drop("t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", streaming.deduplicated(stream), "append"), ("sessions", streaming.session_state(stream), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("once").count() == 3
    r = spark.table("sessions").collect()[-1]
    assert str(r.ended_at) == str(r.last_event_at) and r.started_at < r.ended_at
    hits = spark.createDataFrame([(1, float(t), t) for t in (0, 1, 2, 3, 11)] + [(2, 0.0, 9)], "key bigint, at double, id bigint")
    assert sorted((r.key, r.id) for r in streaming.rate_limited(hits, 2, 10.0).collect()) == [(1, 0), (1, 1), (1, 11), (2, 9)]


def test_module_reports_are_stored_once(spark):
    lectures = spark.createDataFrame([(1, 10), (1, 11)], "course_id bigint, resource_id bigint")
    done = spark.createDataFrame([(5, 1, 10), (5, 1, 11)], "student_id bigint, course_id bigint, resource_id bigint")
    kept = []
    stored = lambda: spark.createDataFrame(kept, "student_id bigint, course_id bigint")
    on_batch = streaming.module_reports(lambda: done, lectures, stored, lambda df: kept.extend(map(tuple, df.collect())))
    batch = spark.createDataFrame([(5, 11, "complete")], "student_id bigint, resource_id bigint, event_type string")
    on_batch(batch, 0)
    on_batch(batch, 1)
    assert kept == [(5, 1)]


def test_priority_support_and_clusters(spark):
    schema = "accuracy double, discrimination string, misconception_share double, misconception_order int, suspicious_order int, retry_rate double, skip_rate double, median_response double, exam_p75 double"
    rows = [(20.0, "negative", 40.0, 2, 3, 50.0, 20.0, 90.0, 60.0), (None, None, None, None, None, None, None, None, None), (90.0, "weak", None, None, None, 10.0, 0.0, 5.0, 60.0)]
    got = exam.priorities(spark.createDataFrame(rows, schema)).collect()
    assert [(r.priority, r.category) for r in got] == [(98.5, "HIGH"), (0.0, "LOW"), (17.0, "LOW")]
    assert got[0].reasons.split(", ") == ["20.0% correct", "negative discrimination; review recommended", "40.0% selected distractor 2", "distractor 3 over-selected by higher performers", "50.0% required retry", "20.0% skipped/timed out", "response time above exam p75"]
    assert got[1].reasons == "" and got[2].reasons == "weak discrimination"
    rows = [(False, 90.0, 90.0, 90.0, 0.0, []), (True, None, 90.0, 90.0, 0.0, []), (True, 90.0, 90.0, 90.0, 0.0, ["t"]), (True, 90.0, 90.0, 90.0, 50.0, []), (True, 90.0, 50.0, 90.0, None, []), (True, 90.0, 70.0, 40.0, None, []), (True, 90.0, 90.0, 90.0, None, []), (True, 70.0, 70.0, 70.0, 10.0, [])]
    got = exam.support(spark.createDataFrame(rows, "completed boolean, score double, accuracy double, first_accuracy double, retry_rate double, weak_topics array<string>")).collect()
    assert [r.issue for r in got] == ["Low completion", "Insufficient question-level evidence", "Weak topic: t", "High retry dependency", "Low attempted accuracy", "Low first-attempt knowledge", "Secure first-attempt performance", "No immediate concern"]
    rows = [("a", 50.0, False), ("a", 59.9, False), ("b", 90.0, True), ("c", 90.0, True), ("c", None, False), ("d", 50.0, False), ("d", 60.0, False)]
    got = exam.clusters(spark.createDataFrame(rows, "topic string, first_accuracy double, misconception boolean"), []).collect()
    assert sorted((r.topic, r.questions, r.dominant, r.missed) for r in got) == [("a", 2, 0, 2), ("c", 2, 1, 0)]


def test_job_states(spark):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")
    rows = [(1, "submitted", 2, 3, None, "2026-01-01 11:00:00"), (2, "submitted", 2, 3, "r", "2026-01-01 11:00:00"), (3, "submitted", 2, 3, None, "2026-01-01 11:50:00"), (4, "completed", 1, 3, "r", "2026-01-01 10:00:00")]
    queue = spark.createDataFrame(rows, "id int, status string, attempt_count int, max_attempts int, remote_id string, updated_at string").withColumns({"updated_at": F.col("updated_at").cast("timestamp_ntz"), "last_error": F.lit(None).cast("string")})
    state = lambda df: [(r.status, r.attempt_count) for r in df.orderBy("id").collect()]
    assert state(jobs.recovered(queue, now, 30)) == [("failed", 2), ("submitted", 2), ("submitted", 2), ("completed", 1)]
    steps = spark.createDataFrame([(1, "a", True), (1, "a", True), (3, "b", False), (4, "c", None), (None, "d", True)], "id int, reason string, permanent boolean")
    assert state(jobs.failed(queue, steps, now)) == [("failed", 3), ("submitted", 2), ("failed", 2), ("failed", 1)]
    assert state(jobs.deferred(queue, steps.drop("permanent"), now)) == [("pending", 1), ("submitted", 2), ("pending", 1), ("pending", 0)]
    assert state(jobs.cancelled(queue, steps.drop("permanent"), now)) == [("failed", 3), ("submitted", 2), ("failed", 3), ("completed", 1)]


def test_message_order_and_violations(spark):
    stored = spark.createDataFrame([(1, "a", 4), (1, None, 5)], "session_id int, request_key string, message_order int")
    new = spark.createDataFrame([(1, 10, 1, "a"), (1, 12, 2, "b"), (1, 11, 2, None), (1, 13, 3, "b"), (1, 14, 4, None), (2, 15, 1, "a")], "session_id int, id int, at int, request_key string")
    got = access.allocated(new, stored).collect()
    assert sorted((r.session_id, r.id, r.message_order) for r in got) == [(1, 11, 6), (1, 12, 7), (1, 14, 8), (2, 15, 1)]
    found = access.violations({"twice": access.repeated(new, ["session_id", "request_key"]), "none": new.filter("id < 0")}).collect()
    assert {r.check: r.offending for r in found} == {"twice": 2, "none": 0}


def test_action_plan(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    people = df([(1,), (2,), (3,)], "s int")
    topics = df([(1, "a", 10.0, 1), (1, "b", 64.9, 2), (1, "c", 20.0, 3), (2, "a", 1.0, 4), (2, "b", 65.0, 1), (2, "c", 2.0, 3), (2, "d", 3.0, 2), (2, "e", 4.0, 5), (3, "a", None, 1)], "s int, topic string, score double, rank int")
    spans = df([(1, "x", 2), (1, "y", 1)], "s int, subject string, rank int")
    got = scoring.action_plan(people, df([(1, -5.1), (2, -5.0), (3, None)], "s int, gap double"), topics, spans, spans, "s").orderBy("s", "position").collect()
    assert [(r.s, r.action, r.subject) for r in got] == [(1, "catch_up", None), (1, "revise", "a"), (1, "revise", "b"), (1, "retry", "y"), (1, "watch", "y"), (2, "revise", "d"), (2, "revise", "c"), (2, "revise", "a"), (3, "keep_going", None)]


def test_playback_context_follows_the_rules_in_order(spark):
    from lectern.operators import replay

    events, attempts, want = [], [], {}

    def session(name, rows, shown, checkpoint, context):
        events.extend((1, 1, name, len(events) + i, kind, place, at, 1.0) for i, (at, kind, place) in enumerate(rows))
        if shown is not None:
            attempts.append((1, 1, name, name, shown, checkpoint))
            want[name] = context

    session("hidden long ago", [(0.0, "play", 0.0), (10.0, "tab_hidden", 10.0), (480.0, "heartbeat", 12.0)], 500.0, 300.0, "page_hidden")
    session("shown again", [(0.0, "play", 0.0), (10.0, "tab_hidden", 10.0), (20.0, "tab_visible", 10.0), (450.0, "play", 12.0), (470.0, "heartbeat", 30.0)], 500.0, 300.0, "after_uninterrupted_viewing")
    session("back", [(400.0, "play", 90.0), (420.0, "seek", 50.0), (430.0, "pause", 60.0)], 440.0, 300.0, "after_backward_seek")
    # the event before the seek is out of reach, so it isn't known to go back
    session("first seek", [(300.0, "play", 90.0), (420.0, "seek", 50.0)], 440.0, 300.0, "other")
    session("forward", [(400.0, "play", 10.0), (420.0, "seek", 90.0)], 440.0, 300.0, "other")
    session("pause", [(400.0, "play", 10.0), (420.0, "pause", 30.0)], 440.0, 300.0, "after_pause")
    session("rewatch", [(0.0, "play", 0.0), (30.0, "heartbeat", 30.0), (31.0, "seek", 0.0), (32.0, "play", 0.0), (62.0, "heartbeat", 30.0)], 300.0, 20.0, "after_rewatch")
    session("nothing near", [(0.0, "play", 0.0)], 300.0, 20.0, "other")
    attempts.append((1, 1, "no events", "no events", 5.0, 1.0))
    want["no events"] = "other"
    e = spark.createDataFrame(events, "student_id int, resource_id int, session_id string, id int, event_type string, video_ts double, at double, rate double")
    a = spark.createDataFrame(attempts, "student_id int, resource_id int, session_id string, attempt_id string, shown_at double, checkpoint_ts double")
    got = replay.playback_context(a, replay.replay(e))
    assert {r.attempt_id: r.context for r in got.collect()} == want and got.columns == [*a.columns, "context"]
    assert replay.playback_context(a.limit(0), replay.replay(e)).count() == 0


def test_distractors_keep_options_nobody_picked(spark):
    from lectern.operators import exam

    answers = spark.createDataFrame([(1, [0], "high")] * 20 + [(2, [0, 3, 3], "low")] * 6 + [(2, [1], "high")] * 6 + [(2, None, "middle")], "question_id int, selected array<int>, level string")
    options = spark.createDataFrame([(q, o, o == 0) for q in (1, 2, 3) for o in range(4)], "question_id int, option_id int, is_key boolean")
    got = {(r.question_id, r.option_id): (r.picked, r["class"]) for r in exam.distractors(answers, options).collect()}
    assert got[1, 1] == got[1, 3] == got[3, 2] == (0, "non_functioning")
    assert got[2, 1] == (6, "suspicious") and got[2, 3] == (6, "strong_misconception") and got[2, 2] == (0, "non_functioning")


def test_redacted_texts(spark):
    given = ["ffmpeg: 'https://v.x/a.m3u8?Token=SECRET&expires=5' failed", "https://a/b?k=2&TOKEN_PATH=x&k=3 and http://c/d?token=1", "https://a/b", "https://a/b?", "no address, ?token=1", "xhttps://a?u=https://b/?token=1&v=2", "", None]
    want = ["ffmpeg: 'https://v.x/a.m3u8?…' failed", "https://a/b?k=2&k=3 and http://c/d?…", "https://a/b", "https://a/b?", "no address, ?token=1", "xhttps://a?u=https://b/?token=1&v=2", "", None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(redacted_url(F.col("u"))).collect()] == want
