"""Queries of limits, quotas, the queue and vector search on the driver's tables, with SQL for comparison; `queries` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as X
from .functions import epoch
from .operators import vectors
from .registry import query
from .sources import table
from .streaming import limits, queue, rate_limited

# of each key's hits in order: the log of accepted instants in the window before, as a fold
_LOG = f"""WITH RECURSIVE {X.EV}, h AS (SELECT student_id AS key, id, tm, row_number() OVER (PARTITION BY student_id ORDER BY tm, id) AS n FROM ev),
 f AS (SELECT key, id, tm, n, [tm] AS log, true AS accepted, NULL::BIGINT AS retry_after FROM h WHERE n = 1
  UNION ALL SELECT h.key, h.id, h.tm, h.n, CASE WHEN len(l.l) < 3 THEN list_append(l.l, h.tm) ELSE l.l END, len(l.l) < 3, CASE WHEN len(l.l) >= 3 THEN greatest(1, CAST(trunc(l.l[1] + 86400.0 - h.tm) AS BIGINT) + 1) END
  FROM f JOIN h ON h.key = f.key AND h.n = f.n + 1, LATERAL (SELECT list_filter(f.log, lambda x: x > h.tm - 86400.0) AS l) l)"""


@query(f"{_LOG} SELECT key, tm AS \"at\", id FROM f WHERE accepted")
def rate_limit_fold(s, d):
    return rate_limited(X.events(s, d).select(F.col("student_id").alias("key"), "at", "id"), 3, 86400.0)


@query(f"{_LOG} SELECT key, id, accepted, retry_after FROM f")
def rate_limit_decisions(s, d):
    return limits.limited(X.events(s, d).select(F.col("student_id").alias("key"), "at", "id"), 3, 86400.0).select("key", "id", "accepted", "retry_after")


def _requests(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), epoch(F.col("ts")).alias("at"), F.when(F.col("event_id") % 17 > 0, F.col("event_type")).alias("feature"), (F.col("event_id") % 4).alias("units"))


_QUOTA = """WITH RECURSIVE q AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 AS tm, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day, CASE WHEN event_id % 17 > 0 THEN event_type END AS feature, event_id % 4 AS units FROM events),
 n AS (SELECT *, units > 0 AND feature IS NOT NULL AS ok, row_number() OVER (PARTITION BY key, day ORDER BY tm, id) AS n FROM q),
 f AS (SELECT key, day, n, id, tm, feature, units, ok AS accepted, CASE WHEN ok THEN units ELSE 0 END AS used, CASE WHEN units = 0 THEN 'units' WHEN feature IS NULL THEN 'feature' END AS problem FROM n WHERE n = 1
  UNION ALL SELECT n.key, n.day, n.n, n.id, n.tm, n.feature, n.units, n.ok AND f.used + n.units <= 5, CASE WHEN n.ok AND f.used + n.units <= 5 THEN f.used + n.units ELSE f.used END, CASE WHEN n.units = 0 THEN 'units' WHEN n.feature IS NULL THEN 'feature' END FROM f JOIN n ON n.key = f.key AND n.day = f.day AND n.n = f.n + 1)"""


@query(f"{_QUOTA} SELECT key, id, units, problem, accepted, used, 5 - used AS remaining, CASE WHEN NOT accepted AND problem IS NULL THEN greatest(1, CAST(ceil((day + 1) * 86400 - tm) AS BIGINT)) END AS retry_after FROM f")
def quota_decisions(s, d):
    return limits.metered(_requests(s, d), 5).select("key", "id", "units", "problem", "accepted", "used", "remaining", "retry_after")


@query(f"{_QUOTA}, g AS (SELECT key, day, feature, sum(units) AS units FROM f WHERE accepted GROUP BY 1, 2, 3) SELECT key, day, CAST(sum(units) AS BIGINT) AS used, string_agg(feature || '=' || units, ',' ORDER BY feature) AS features FROM g GROUP BY 1, 2")
def quota_by_feature(s, d):
    x = limits.usage_by_feature(limits.metered(_requests(s, d), 5))
    return x.select("key", "day", "used", F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("features"))


def _queue(s, d):
    """Orders as jobs and the events as messages about them."""
    key, null = F.col("o_orderkey"), lambda t: F.lit(None).cast(t)
    at = F.col("o_orderdate").cast("timestamp")
    status = F.when(key % 5 == 0, "pending").when(key % 5 == 1, "failed").when(key % 5 == 2, "submitted").when(key % 5 == 3, "processing").otherwise("completed")
    remote = F.when((key % 5 == 3) | ((key % 5 == 2) & (key % 2 == 0)), F.concat(F.lit("r"), key.cast("string")))
    jobs = table(s, d, "orders").select(key.alias("id"), F.concat(F.lit("g"), key.cast("string")).alias("guid"), status.alias("status"), (F.col("o_custkey") % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"), remote.alias("remote_id"), at.alias("created_at"), null("timestamp").alias("started_at"), F.when(remote.isNotNull(), at).alias("submitted_at"), null("timestamp").alias("completed_at"), at.alias("updated_at"), null("bigint").alias("chunk_count"), null("string").alias("last_error"))
    e = F.col("event_id")
    said = F.when(e % 6 == 0, "IN_PROGRESS").when(e % 6 == 1, "COMPLETED").when(e % 6 == 2, "FAILED").when(e % 6 == 3, "UNAVAILABLE").when(e % 6 == 4, "odd").otherwise("COMPLETED")
    kind = F.when(e % 7 < 5, "status").when(e % 7 == 5, "defer").otherwise("enqueue")
    # one message a job
    messages = table(s, d, "events").select(kind.alias("kind"), e.alias("id"), F.when(e % 7 == 6, F.concat(F.lit("g"), (e * 3).cast("string"))).alias("guid"), null("int").alias("max_attempts"), null("string").alias("remote_id"), said.alias("state"), F.lit("why").alias("reason"), (e % 12 == 2).alias("permanent"), F.when(e % 6 == 1, e).alias("chunks"), F.col("ts").cast("timestamp").alias("at"))
    return jobs, messages


@query("""WITH j AS (SELECT o_orderkey AS id, 'g' || o_orderkey AS guid, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'submitted' WHEN 3 THEN 'processing' ELSE 'completed' END AS status, o_custkey % 4 AS tries, CASE WHEN o_orderkey % 5 = 3 OR (o_orderkey % 5 = 2 AND o_orderkey % 2 = 0) THEN 'r' END AS remote, o_orderdate AS tm FROM orders),
 m AS (SELECT event_id AS id, CASE WHEN event_id % 7 < 5 THEN 'status' WHEN event_id % 7 = 5 THEN 'defer' ELSE 'enqueue' END AS kind, CASE event_id % 6 WHEN 0 THEN 'IN_PROGRESS' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'UNAVAILABLE' WHEN 4 THEN 'odd' ELSE 'COMPLETED' END AS state FROM events),
 s1 AS (SELECT j.*, m.kind, m.state, status IN ('submitted', 'processing') AND remote IS NOT NULL AND kind = 'status' AND state <> 'UNAVAILABLE' AS polled FROM j LEFT JOIN m USING (id)),
 s2 AS (SELECT *, CASE WHEN polled AND state = 'COMPLETED' AND id % 6 = 1 THEN 'completed' WHEN polled THEN 'failed' ELSE status END AS st2, CASE WHEN polled AND NOT (state = 'COMPLETED' AND id % 6 = 1) AND state <> 'IN_PROGRESS' AND id % 12 = 2 THEN 3 ELSE tries END AS t2 FROM s1),
 s3 AS (SELECT id, guid, tm, kind, CASE WHEN kind = 'defer' THEN 'pending' ELSE st2 END AS st3, CASE WHEN kind = 'defer' THEN greatest(t2 - 1, 0) ELSE t2 END AS t3, CASE WHEN kind = 'defer' THEN NULL ELSE remote END AS r3 FROM s2),
 s4 AS (SELECT id, guid, tm, kind, CASE WHEN st3 IN ('submitted', 'processing') AND r3 IS NULL THEN 'failed' ELSE st3 END AS st4, t3 FROM s3),
 nw AS (SELECT 'g' || event_id * 3 AS guid FROM events WHERE event_id % 7 = 6 AND 'g' || event_id * 3 NOT IN (SELECT guid FROM j)),
 al AS (SELECT id, guid, tm, kind, st4 AS status, t3 AS tries FROM s4 UNION ALL SELECT (SELECT max(id) FROM j) + row_number() OVER (ORDER BY guid), guid, TIMESTAMP '2024-02-01', NULL, 'pending', 0 FROM nw),
 cl AS (SELECT id FROM al WHERE (kind IS NULL OR kind = 'enqueue') AND (status = 'pending' OR status = 'failed' AND tries < 3) ORDER BY tm, id LIMIT 500)
 SELECT al.id, guid, CASE WHEN cl.id IS NOT NULL THEN 'submitted' ELSE status END AS status, CAST(CASE WHEN cl.id IS NOT NULL THEN tries + 1 ELSE tries END AS INT) AS attempt_count, cl.id IS NOT NULL AS claimed FROM al LEFT JOIN cl ON cl.id = al.id""")
def queue_step(s, d):
    jobs, messages = _queue(s, d)
    return queue.stepped(jobs, messages, F.expr("TIMESTAMP'2024-02-01 00:00:00'"), 500).select("id", "guid", "status", "attempt_count", "claimed")


def _vectors(s, d):
    rows = X.chunks(s, d)
    return rows, rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "video_id", "embedding")


_NEAR = "q AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT query_id, q.label AS own, vec_id, CAST(e.label AS BIGINT) AS video_id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), v), 12) AS dist FROM q, embeddings e)"


@query(f"WITH {_NEAR}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INT) AS rank FROM x) SELECT query_id, vec_id, video_id, abs(round(dist, 6)) AS distance, rank FROM r WHERE rank <= 10")
def nearest_indexed(s, d):
    rows, asked = _vectors(s, d)
    return vectors.nearest(vectors.build(rows, block=200), asked, 10).select("query_id", "vec_id", "video_id", F.abs(F.round("distance", 6)).alias("distance"), "rank")


_CUT = 0.7


@query(f"WITH {_NEAR}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM x WHERE video_id = own AND vec_id % 20 > 0), a AS (SELECT * FROM o WHERE rank <= 4 AND dist <= {_CUT}), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM x WHERE vec_id % 20 > 0 AND video_id <> own AND video_id % 2 = own % 2 AND query_id NOT IN (SELECT query_id FROM a)) SELECT query_id, vec_id, video_id, abs(round(dist, 6)) AS distance, CAST(rank AS INT) AS rank, false AS fallback FROM a UNION ALL SELECT query_id, vec_id, video_id, abs(round(dist, 6)), CAST(rank AS INT), true FROM w WHERE rank <= 4 AND dist <= {_CUT}")
def nearest_or_siblings(s, d):
    rows, asked = _vectors(s, d)
    videos = rows.select("video_id").distinct()
    siblings = asked.alias("q").join(videos.alias("v"), F.col("q.video_id") % 2 == F.col("v.video_id") % 2).select("q.query_id", "v.video_id")
    x = vectors.own_or_siblings(rows.filter("vec_id % 20 > 0"), asked, siblings, 4, _CUT)
    return x.select("query_id", "vec_id", "video_id", F.abs(F.round("distance", 6)).alias("distance"), "rank", "fallback")


@query("WITH c AS (SELECT conv_id, vec_id, min(turn) AS position FROM (SELECT conv_id, turn, (conv_id * 7 + turn * 3) % 400 AS vec_id FROM conversations) GROUP BY 1, 2) SELECT conv_id AS query_id, string_agg(e.vec_id || ':' || label, ',' ORDER BY position, e.vec_id) AS passages FROM c JOIN embeddings e USING (vec_id) GROUP BY 1")
def cited_passages(s, d):
    cited = table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 400).alias("vec_id"))
    x = vectors.restored(X.chunks(s, d), cited)
    return x.select("query_id", F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["vec_id"], p["video_id"])), ",").alias("passages"))
