"""Limits and quotas as streams against their batch form, the queue's writer over failures, and vector search against a full scan."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import vectors
from lectern.streaming import limits, queue


@pytest.fixture(scope="module")
def stateful(spark):
    session = spark.newSession()
    for k, v in limits.STORE.items():
        session.conf.set(k, v)
    return session


def brute_log(rows, limit, window):
    out, log = [], {}
    for k, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        kept = [t for t in log.get(k, []) if t > at - window]
        ok = len(kept) < limit
        out.append((k, i, ok, None if ok else max(1, int(kept[0] + window - at) + 1)))
        log[k] = [*kept, at] if ok else kept
    return sorted(out)


def brute_quota(rows, limit):
    out, used = [], {}
    for k, i, at, feature, units in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        day = int(at // 86400)
        valid = units is not None and 0 < units <= limit and feature and len(feature) <= 50
        ok = bool(valid and used.get((k, day), 0) + units <= limit)
        used[k, day] = used.get((k, day), 0) + (units if ok else 0)
        out.append((k, i, ok, used[k, day]))
    return sorted(out)


#: A UTC midnight: a watermark begins at 1970.
DAY = 86_400.0
BASE = 19_676 * DAY
HITS = [(k, i * 10 + k, BASE + i * 7 % 50 + i // 3 * 40) for k in range(4) for i in range(40)]
ASKS = [(k, i * 10 + k, BASE + i * 9000.0 + k, ["ask", "grade", "", None, "x" * 51][i % 5 if i % 3 else 0], [1, 2, 3, 9, 0, None, 4][i % 7]) for k in range(3) for i in range(40)]


def test_limits_of_tables(spark):
    hits = spark.createDataFrame(HITS, "key bigint, id bigint, at double")
    assert sorted((r.key, r.id, r.accepted, r.retry_after) for r in limits.limited(hits, 3, 60.0).collect()) == brute_log(HITS, 3, 60.0)
    asks = spark.createDataFrame(ASKS, "key bigint, id bigint, at double, feature string, units bigint")
    done = limits.metered(asks, 5)
    assert sorted((r.key, r.id, r.accepted, r.used) for r in done.collect()) == brute_quota(ASKS, 5)
    assert {r.problem for r in done.collect()} == {None, "units", "feature"}
    assert all(sum(r.features.values()) == r.used <= 5 for r in limits.usage_by_feature(done).collect())
    odd = spark.createDataFrame([(None, 1, 0.0), (1, 2, None), (1, 3, 5.0), (1, 3, 5.0)], "key bigint, id bigint, at double")
    assert sorted((r.id, r.accepted) for r in limits.limited(odd, 1, 10.0).collect()) == [(1, False), (2, False), (3, False), (3, True)]
    assert limits.limited(hits.limit(0), 3, 60.0).count() == 0 and limits.metered(asks.limit(0), 3).count() == 0


def streamed(session, tmp_path, name, rows, schema, parts, make):
    """The output of a stream that gets the rows in `parts` batches by time, a file each."""
    at = schema.split(", ").index("at double")
    ordered = sorted(rows, key=lambda r: (r[at], r[1]))
    size = -(-len(ordered) // parts)
    for k in range(parts):
        session.createDataFrame(ordered[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"part={k}"))
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(*[str(tmp_path / name / "part=*")])
    q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) > 1
    return session.read.parquet(str(tmp_path / f"{name}-out")), q


def test_stream_of_hits_equals_the_fold(stateful, tmp_path):
    out, _ = streamed(stateful, tmp_path, "hits", HITS, "key bigint, id bigint, at double", 3, lambda s: limits.limited_stream(s, 3, 60.0, "1 day"))
    assert sorted((r.key, r.id, r.accepted, r.retry_after) for r in out.collect()) == brute_log(HITS, 3, 60.0)


def test_stream_of_requests_equals_the_fold_and_forgets(stateful, tmp_path):
    out, q = streamed(stateful, tmp_path, "asks", ASKS, "key bigint, id bigint, at double, feature string, units bigint", 3, lambda s: limits.metered_stream(s, 5, "2 hours"))
    assert sorted((r.key, r.id, r.accepted, r.used) for r in out.collect()) == brute_quota(ASKS, 5)


def test_timers_clear_keys_that_stay_away(stateful, tmp_path):
    # key 1 is seen on the first day only; the watermark passes it with the second batch
    rows = [(k, i, BASE + at, "ask", n) for k, i, at, n in [(1, 1, 10.0, 2), (2, 2, 20.0, 1), (2, 3, 5 * 86400.0, 1), (2, 4, 9 * 86400.0, 1), (2, 5, 12 * 86400.0, 1)]]
    out, q = streamed(stateful, tmp_path, "away", rows, "key bigint, id bigint, at double, feature string, units bigint", 5, lambda s: limits.metered_stream(s, 5, "1 hour"))
    assert sorted((r.id, r.accepted, r.used) for r in out.collect()) == [(1, True, 2), (2, True, 1), (3, True, 1), (4, True, 1), (5, True, 1)]
    left = stateful.read.format("statestore").option("stateVarName", "today").load(str(tmp_path / "away-ck")).select("key.key", "value.day").collect()
    assert [(r.key, r.day) for r in left] == [(2, BASE // DAY + 12)]


NOW = dt.datetime(2024, 1, 1, 12)
JOB = (1, "g1", "pending", 0, 3, None, NOW, None, None, None, NOW, None, None)


def job(**change):
    names = [c.split()[0] for c in queue.JOBS.split(", ")]
    return tuple({**dict(zip(names, JOB)), **change}.values())


def message(**what):
    names = [c.split()[0] for c in queue.MESSAGE.split(", ")]
    return tuple({**dict.fromkeys(names), **what}[n] for n in names)


def after(spark, jobs, messages, claims=0, **limits_):
    now = F.lit(NOW + dt.timedelta(hours=1)).cast("timestamp")
    out = queue.stepped(spark.createDataFrame(jobs, queue.JOBS), spark.createDataFrame(messages, queue.MESSAGE), now, claims, **limits_)
    return {r.id: r for r in out.collect()}


def test_settling(spark):
    held = {"status": "submitted", "remote_id": "r", "submitted_at": NOW, "attempt_count": 1}
    jobs = [job(id=i, guid=f"g{i}", **held) for i in range(1, 10)] + [job(id=10, guid="g10", **{**held, "submitted_at": NOW - dt.timedelta(hours=5)}), job(id=11, guid="g11", status="completed", remote_id="r")]
    said = [
        message(kind="status", id=1, state="IN_PROGRESS"), message(kind="status", id=2, state="IN_QUEUE"), message(kind="status", id=3, state="COMPLETED", chunks=7), message(kind="status", id=4, state="COMPLETED", chunks=0), message(kind="status", id=5, state="FAILED", reason="bad", permanent=True),
        message(kind="status", id=6, state="FAILED", reason="busy", permanent=False), message(kind="status", id=7, state="UNAVAILABLE"), message(kind="status", id=8, state="PUZZLED"), message(kind="status", id=10, state="IN_PROGRESS"), message(kind="status", id=11, state="FAILED"), message(kind="status", id=99, state="FAILED"), message(kind="odd", id=1),
        message(kind="status", id=9, state="FAILED", at=NOW), message(kind="status", id=9, state="IN_PROGRESS", at=NOW + dt.timedelta(1)),
    ]
    got = after(spark, jobs, said)
    assert [(got[i].status, got[i].attempt_count, got[i].last_error) for i in range(1, 12)] == [
        ("processing", 1, None), ("submitted", 1, None), ("completed", 1, None), ("failed", 1, "no transcript blocks"), ("failed", 3, "FAILED: bad"), ("failed", 1, "FAILED: busy"), ("submitted", 1, None), ("failed", 1, "unknown status PUZZLED"), ("processing", 1, None), ("failed", 1, "gave up, still IN_PROGRESS"), ("completed", 0, None),
    ]
    assert got[3].chunk_count == 7 and got[7].updated_at == NOW and got[2].updated_at > NOW


def test_a_finished_job_is_not_taken_for_abandoned(spark):
    old = NOW - dt.timedelta(hours=9)
    jobs = [job(id=1, status="submitted", remote_id="r", attempt_count=1, submitted_at=NOW, updated_at=old), job(id=2, guid="g2", status="submitted", attempt_count=1, updated_at=old), job(id=3, guid="g3", status="submitted", attempt_count=3, updated_at=old), job(id=4, guid="g4", created_at=NOW + dt.timedelta(1))]
    got = after(spark, jobs, [message(kind="status", id=1, state="COMPLETED", chunks=2), message(kind="enqueue", guid="g4"), message(kind="enqueue", guid="g9", max_attempts=5)], claims=2)
    assert got[1].status == "completed"
    # job 2 was recovered and, being the oldest, claimed again; job 3 is out of attempts; g4 was there already
    assert (got[2].status, got[2].attempt_count, got[2].claimed) == ("submitted", 2, True) and (got[3].status, got[3].claimed) == ("failed", False)
    assert sorted(got) == [1, 2, 3, 4, 5] and (got[5].guid, got[5].max_attempts, got[5].claimed) == ("g9", 5, True) and not got[4].claimed


def test_a_job_is_claimed_once_a_batch(spark):
    jobs = [job(id=1, status="submitted", remote_id="r", attempt_count=1, submitted_at=NOW), job(id=2, guid="g2", status="submitted", attempt_count=1)]
    got = after(spark, jobs, [message(kind="status", id=1, state="FAILED"), message(kind="refused", id=2, reason="no", permanent=False)], claims=5)
    assert [(got[i].status, got[i].claimed) for i in (1, 2)] == [("failed", False)] * 2
    got = after(spark, [job(id=2, guid="g2", status="failed", attempt_count=1)], [], claims=5)
    assert got[2].claimed and got[2].attempt_count == 2


def test_writer_is_idempotent(spark, tmp_path):
    kept = queue.Queue(spark, str(tmp_path / "jobs"), keep=2)
    sent, broken = [], [False]

    def send(claims):
        if broken[0]:
            raise RuntimeError("no connection")
        sent.append(sorted((r.guid, r.attempt_count) for r in claims.collect()))

    write = kept.writer(lambda: F.lit(NOW).cast("timestamp"), 1, send)
    new = spark.createDataFrame([message(kind="enqueue", guid=g) for g in ("a", "b", "a")], queue.MESSAGE)
    none = new.limit(0)
    assert kept.jobs().count() == 0
    write(new, 0)
    first = sorted(map(tuple, kept.jobs().collect()))
    write(new, 0)  # the batch runs again after it was done
    assert sorted(map(tuple, kept.jobs().collect())) == first and sent == [[("a", 1)], [("a", 1)]]
    broken[0] = True
    with pytest.raises(RuntimeError):
        write(none, 1)  # its version stands, its claims were not sent
    broken[0] = False
    write(none, 1)
    assert sent[-1] == [("b", 1)] and {r.guid: r.attempt_count for r in kept.jobs().collect()} == {"a": 1, "b": 1}
    # a version that was not finished is not there, and is written anew
    (tmp_path / "jobs" / "batch=2").mkdir()
    (tmp_path / "jobs" / "batch=2" / "part-0.parquet").write_text("half")
    assert kept.versions() == [0, 1]
    write(spark.createDataFrame([message(kind="accepted", id=1, remote_id="r1")], queue.MESSAGE), 2)
    assert kept.versions() == [1, 2] and {r.id: r.remote_id for r in kept.jobs().collect()} == {1: "r1", 2: None}


def test_writer_of_a_stream(spark, tmp_path):
    kept = queue.Queue(spark, str(tmp_path / "jobs"))
    for k, rows in enumerate(([message(kind="enqueue", guid="a")], [message(kind="accepted", id=1, remote_id="x")], [message(kind="status", id=1, state="COMPLETED", chunks=3)])):
        spark.createDataFrame(rows, queue.MESSAGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
        stream = spark.readStream.schema(queue.MESSAGE).parquet(str(tmp_path / "in" / "k=*"))
        q = stream.writeStream.foreachBatch(kept.writer(lambda: F.lit(NOW).cast("timestamp"), 5)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    (r,) = kept.jobs().collect()
    assert (r.guid, r.status, r.chunk_count, r.attempt_count) == ("a", "completed", 3, 1)


def scan(rows, asked, k, scope=None):
    out = []
    unit = lambda v: np.array(v, dtype=float) / np.linalg.norm(v)
    good = lambda v: v is not None and len(v) == 8 and all(x is not None for x in v) and np.isfinite(v).all() and np.linalg.norm(v) > 0
    for q, v in asked:
        if not good(v):
            continue
        found = sorted((round(1 - float(unit(v) @ unit(e)), 12), i, video) for i, video, e in rows if good(e) and (scope is None or video in scope[q]))
        out += [(q, i, video, rank + 1) for rank, (_, i, video) in enumerate(found[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(7)
    heads = rng.normal(size=(12, 8))
    out = [(i, i % 9, (heads[i % 12] + rng.normal(size=8) * 0.3).tolist()) for i in range(600)]
    out += [(600 + i, 3, [1.0] * 8) for i in range(300)]  # a third are equal
    out += [(900, 1, None), (901, 1, [0.0] * 8), (902, 1, [1.0] * 7), (903, 1, [float("nan")] + [1.0] * 7), (904, 1, [None] + [1.0] * 7)]
    asked = [(q, (heads[q % 12] + rng.normal(size=8) * 0.5).tolist()) for q in range(40)] + [(50, [1.0] * 8), (51, None), (52, [0.0] * 8), (53, (-heads[0]).tolist())]
    return out, asked


ROWS, ASKED = "vec_id bigint, video_id bigint, embedding array<double>", "query_id bigint, embedding array<double>"


@pytest.mark.parametrize(("cells", "block", "k"), [(None, 64, 5), (3, 4096, 1), (40, 50, 30), (1, 10, 2000)])
def test_index_equals_a_full_scan(spark, vector_rows, cells, block, k):
    rows, asked = vector_rows
    index = vectors.build(spark.createDataFrame(rows, ROWS), cells=cells, block=block)
    got = vectors.nearest(index, spark.createDataFrame(asked, ASKED), k).collect()
    assert sorted((r.query_id, r.vec_id, r.video_id, r["rank"]) for r in got) == scan(rows, asked, k)


def test_index_looks_into_few_cells(spark, vector_rows, tmp_path):
    rows, asked = vector_rows
    index = vectors.build(spark.createDataFrame(rows, ROWS), str(tmp_path / "index"), cells=24)
    looked = vectors._planned(index, spark.createDataFrame(asked, ASKED), 3, None).count()
    assert looked < 24 * len(asked) / 4 and index.sizes.sum() == 900 and index.blocks.max() == 1
    got = vectors.nearest(index, spark.createDataFrame(asked, ASKED), 3).collect()
    assert sorted((r.query_id, r.vec_id, r.video_id, r["rank"]) for r in got) == scan(rows, asked, 3)


def test_empty_index_and_no_questions(spark, vector_rows):
    rows, asked = vector_rows
    assert vectors.nearest(vectors.build(spark.createDataFrame([], ROWS)), spark.createDataFrame(asked, ASKED), 3).count() == 0
    assert vectors.nearest(vectors.build(spark.createDataFrame(rows, ROWS)), spark.createDataFrame([], ASKED), 3).count() == 0


def test_siblings_only_where_the_own_video_has_nothing(spark, vector_rows):
    rows, asked = vector_rows
    own = {q: (q + q % 2) % 9 for q, _ in asked}
    siblings = {q: {(q + d) % 9 for d in (0, 1, 2)} for q, _ in asked}  # the own video among them
    questions = spark.createDataFrame([(q, own[q], v) for q, v in asked], "query_id bigint, video_id bigint, embedding array<double>")
    others = spark.createDataFrame([(q, v) for q, vs in siblings.items() for v in vs], "query_id bigint, video_id bigint")
    cut = 0.25
    got = vectors.own_or_siblings(spark.createDataFrame(rows, ROWS), questions, others, 4, cut, dims=8).collect()
    near = {(q, i): d for q, v in asked if v is not None for i, _, e in rows if e is not None and len(e) == 8 for d in [1 - float(np.dot(v, np.array(e, dtype=float)) / (np.linalg.norm(v) * np.linalg.norm(np.array(e, dtype=float)) or 1))]}
    first = [r for r in scan(rows, asked, 4, {q: {own[q]} for q in own}) if near[r[0], r[1]] <= cut]
    some = {r[0] for r in first}
    rest = [r for r in scan(rows, asked, 4, {q: siblings[q] - {own[q]} for q in own}) if near[r[0], r[1]] <= cut and r[0] not in some]
    assert sorted((r.query_id, r.vec_id, r.video_id, r["rank"], r.fallback) for r in got) == sorted([(*r, False) for r in first] + [(*r, True) for r in rest])
    assert some and rest


def test_citations_keep_their_order(spark):
    chunks = spark.createDataFrame([(i, i % 3, [1.0]) for i in range(9)], ROWS)
    cited = spark.createDataFrame([(1, 0, 7), (1, 1, 2), (1, 2, 7), (1, 3, 99), (2, 0, 3)], "query_id bigint, position int, vec_id bigint")
    got = {r.query_id: [p.vec_id for p in r.passages] for r in vectors.restored(chunks, cited).collect()}
    assert got == {1: [7, 2], 2: [3]}
