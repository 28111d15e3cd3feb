"""The registered queries on the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import fixtures as X
from . import queries_catalog, queries_exam, queries_listings, queries_reports, queries_services, queries_verification, queries_weekly  # noqa: F401
from .functions import collapsed, host_allowed, query_key, redacted_url, seconds, stamp, token_estimate
from .operators import access, exam, intervals, jobs, memory, replay, retrieval, scoring, vectors
from .plans import Target, diagnose, search
from .registry import QUERIES, SQL, query  # noqa: F401
from .sources import table

SR, SE = ["student_id", "resource_id"], ["student_id", "exam_id"]


def r3(*names: str) -> dict:
    return {n: F.round(n, 3) for n in names}


def _spans(s, d):
    return replay.replay(X.events(s, d), X.GAP).select(*SR, "start", "end")


def _first_final(s, d):
    return exam.first_final(X.responses(s, d), SE)


@query(f"WITH {X.RP} SELECT student_id, resource_id, round(sum(elapsed), 3) AS watch, round(sum(away), 3) AS away, sum(CASE WHEN seek = 'back' THEN 1 ELSE 0 END)::BIGINT AS back, sum(CASE WHEN seek = 'forward' THEN 1 ELSE 0 END)::BIGINT AS forward, count(seek) AS seeks, round(sum(\"end\" - \"start\"), 3) AS length FROM rp GROUP BY 1, 2")
def event_replay(s, d):
    x = replay.replay(X.events(s, d), X.GAP)
    return x.groupBy(*SR).agg(F.round(F.sum("elapsed"), 3).alias("watch"), F.round(F.sum("away"), 3).alias("away"), F.count_if(F.col("seek") == "back").alias("back"), F.count_if(F.col("seek") == "forward").alias("forward"), F.count("seek").alias("seeks"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("length"))


@query(f"WITH {X.RP}, per AS (SELECT student_id, session_id, resource_id, round_even(sum(elapsed), 1) AS w FROM rp GROUP BY 1, 2, 3) SELECT student_id, count(*) AS sessions, round(sum(w), 1) AS watch FROM per GROUP BY 1")
def session_totals(s, d):
    x = replay.session_totals(replay.replay(X.events(s, d), X.GAP), ["student_id"])
    return x.select("student_id", "sessions", F.round("watch", 1).alias("watch"))


@query(f"WITH {X.MERGED}, c AS (SELECT student_id, resource_id, sum(\"end\" - \"start\") AS covered FROM mg GROUP BY 1, 2) SELECT student_id, resource_id, round(least(coalesce(covered, 0), 6000), 3) AS covered, round(100 * least(coalesce(covered, 0), 6000) / 6000, 3) AS coverage FROM (SELECT DISTINCT student_id, resource_id FROM ev) LEFT JOIN c USING (student_id, resource_id)")
def resource_report(s, d):
    durations = s.range(X.RESOURCES).select(F.col("id").alias("resource_id"), F.lit(6000.0).alias("duration"))
    return replay.resource_report(X.events(s, d), durations, X.GAP).select(*SR, F.round("covered", 3).alias("covered"), F.round("coverage", 3).alias("coverage"))


@query(f"WITH {X.MERGED} SELECT student_id, resource_id, round(\"start\", 3) AS s0, round(\"end\", 3) AS s1, n FROM mg")
def span_union(s, d):
    return intervals.merge_spans(_spans(s, d), SR).select(*SR, F.round("start", 3).alias("s0"), F.round("end", 3).alias("s1"), "n")


@query(f"WITH {X.MERGED}, e AS (SELECT student_id, resource_id, least(\"start\", 6000.0) AS a, least(\"end\", 6000.0) AS b FROM mg UNION ALL SELECT DISTINCT student_id, resource_id, 6000.0, 6000.0 FROM ev), g AS (SELECT student_id, resource_id, lag(b, 1, 0.0) OVER (PARTITION BY student_id, resource_id ORDER BY a, b) AS f, a AS t FROM e) SELECT student_id, resource_id, round(f, 3) AS s0, round(t, 3) AS s1 FROM g WHERE t - f >= 30")
def span_gaps(s, d):
    spans = _spans(s, d)
    durations = X.events(s, d).select(*SR).distinct().withColumn("duration", F.lit(6000.0))
    return intervals.missing_spans(spans, durations, SR).select(*SR, F.round("start", 3).alias("s0"), F.round("end", 3).alias("s1"))


@query(f"WITH {X.SPANS}, e AS (SELECT student_id, resource_id, \"start\" AS tm, 1 AS c FROM sp UNION ALL SELECT student_id, resource_id, \"end\", -1 FROM sp), n AS (SELECT student_id, resource_id, tm, sum(c) AS c FROM e GROUP BY 1, 2, 3), p AS (SELECT student_id, resource_id, tm, lead(tm) OVER w AS nx, sum(c) OVER (PARTITION BY student_id, resource_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS depth FROM n WINDOW w AS (PARTITION BY student_id, resource_id ORDER BY tm)) SELECT student_id, resource_id, round(sum(nx - tm), 2) AS repeated FROM p WHERE depth >= 2 GROUP BY 1, 2")
def span_overlaps(s, d):
    return intervals.repeated_spans(_spans(s, d), SR, 0.0).groupBy(*SR).agg(F.round(F.sum(F.col("end") - F.col("start")), 2).alias("repeated"))


@query(f"WITH {X.EV}, l AS (SELECT student_id, lag(event_type) OVER w AS pt, tm - lag(tm) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY tm, id)) SELECT student_id, round(sum(CASE WHEN pt IN ('play','heartbeat','seek','tab_visible') THEN least(gap, 90) ELSE 0 END), 3) AS watch FROM l GROUP BY 1")
def lag_watch_estimate(s, d):
    w = Window.partitionBy("session_id").orderBy("at", "id")
    x = X.events(s, d).select("student_id", F.lag("event_type").over(w).alias("pt"), (F.col("at") - F.lag("at").over(w)).alias("gap"))
    return x.groupBy("student_id").agg(F.round(F.sum(F.when(F.col("pt").isin("play", "heartbeat", "seek", "tab_visible"), F.least("gap", F.lit(90.0))).otherwise(0.0)), 3).alias("watch"))


@query(f"WITH {X.EV}, l AS (SELECT resource_id, event_type, video_ts, lag(video_ts) OVER (PARTITION BY session_id, resource_id ORDER BY tm, id) AS came FROM ev) SELECT resource_id, CAST(floor(video_ts / 60) * 60 AS BIGINT) AS minute, count(*) AS rewinds FROM l WHERE event_type = 'seek' AND video_ts < came - 5 GROUP BY 1, 2")
def rewind_hotspots(s, d):
    x = X.events(s, d).withColumn("came", F.lag("video_ts").over(Window.partitionBy("session_id", "resource_id").orderBy("at", "id")))
    return x.filter((F.col("event_type") == "seek") & (F.col("video_ts") < F.col("came") - 5)).groupBy("resource_id", (F.floor(F.col("video_ts") / 60) * 60).alias("minute")).agg(F.count(F.lit(1)).alias("rewinds"))


@query(f"WITH {X.EV}, c AS (SELECT student_id, CAST(g AS DATE) AS day FROM (SELECT DISTINCT student_id FROM ev), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(g)) SELECT student_id, CAST(c.day AS VARCHAR) AS day, round(coalesce(sum(video_ts), 0), 3) AS value FROM c LEFT JOIN ev USING (student_id, day) GROUP BY 1, 2")
def daily_zero_fill(s, d):
    x = replay.daily_series(X.events(s, d).select("student_id", "day", F.col("video_ts").alias("value")), ["student_id"], "2024-01-01", "2024-01-31")
    return x.select("student_id", F.col("day").cast("string").alias("day"), F.round("value", 3).alias("value"))


@query("SELECT CAST(CAST(timezone('Africa/Cairo', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS students FROM events GROUP BY 1")
def local_day_activity(s, d):
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Africa/Cairo"), F.col("ts").cast("timestamp_ntz")))
    return table(s, d, "events").groupBy(local.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("students"))


@query(f"WITH {X.EV}, t AS (SELECT DISTINCT student_id, day FROM ev WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'), a AS (SELECT * FROM t UNION ALL SELECT DISTINCT student_id, DATE '2024-02-01' FROM t), g AS (SELECT student_id, day - coalesce(lag(day) OVER (PARTITION BY student_id ORDER BY day), DATE '2023-12-31') - 1 AS gap FROM a) SELECT student_id, CAST(max(gap) AS BIGINT) AS longest_inactive FROM g GROUP BY 1")
def inactivity_gap(s, d):
    return replay.longest_inactive_run(X.events(s, d), ["student_id"], "2024-01-01", "2024-01-31").withColumn("longest_inactive", F.col("longest_inactive").cast("bigint"))


@query(f"WITH {X.EV} SELECT student_id, resource_id, session_id, min(tm) AS started_at, max(tm) AS last_event_at, max(CASE WHEN event_type IN ('complete','tab_hidden') THEN tm END) AS ended_at, count(*) AS n_events FROM ev GROUP BY 1, 2, 3")
def session_lifecycle(s, d):
    return replay.study_sessions(X.events(s, d))


_SESSION = "student_id, resource_id, session_id"


@query(f"""WITH {X.RP}, l AS (SELECT *, lag(video_ts) OVER w AS place, lag(tm) OVER w AS since FROM rp WINDOW w AS (PARTITION BY {_SESSION} ORDER BY tm, id)),
 e AS (SELECT {_SESSION}, "start" AS x, 1 AS c FROM rp WHERE "end" > "start" UNION ALL SELECT {_SESSION}, "end", -1 FROM rp WHERE "end" > "start"),
 n AS (SELECT {_SESSION}, x, sum(c) AS c FROM e GROUP BY ALL), g AS (SELECT {_SESSION}, x, lead(x) OVER w AS y, sum(c) OVER w AS depth FROM n WINDOW w AS (PARTITION BY {_SESSION} ORDER BY x)),
 h AS (SELECT *, CASE WHEN x = lag(y) OVER w THEN 0 ELSE 1 END AS fresh FROM g WHERE depth >= 2 WINDOW w AS (PARTITION BY {_SESSION} ORDER BY x)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY {_SESSION} ORDER BY x) AS island FROM h),
 tw AS (SELECT {_SESSION}, min(x) AS x, max(y) AS y FROM i GROUP BY {_SESSION}, island HAVING max(y) - min(x) >= 5),
 a AS (SELECT id AS attempt_id, student_id, resource_id, session_id, tm AS shown, video_ts AS cts FROM ev WHERE event_type = 'heartbeat'),
 f AS (SELECT attempt_id, any_value(cts) AS cts, arg_max(CASE WHEN event_type IN ('tab_hidden', 'tab_visible') THEN event_type END, CASE WHEN event_type IN ('tab_hidden', 'tab_visible') THEN {{'a': tm, 'b': id}} END) AS tab,
  bool_or(tm >= shown - 7200 AND event_type = 'seek' AND video_ts < place AND since >= shown - 7200) AS bk, bool_or(tm >= shown - 7200 AND event_type = 'pause') AS ps,
  bool_or(tm >= shown - 7200 AND event_type IN ('pause', 'seek', 'tab_hidden', 'tab_visible')) AS br FROM a JOIN l USING ({_SESSION}) WHERE tm <= shown GROUP BY 1),
 t AS (SELECT DISTINCT attempt_id FROM a JOIN tw USING ({_SESSION}) WHERE cts BETWEEN x AND y)
 SELECT CASE WHEN tab = 'tab_hidden' THEN 'page_hidden' WHEN bk THEN 'after_backward_seek' WHEN ps THEN 'after_pause' WHEN attempt_id IN (SELECT attempt_id FROM t) THEN 'after_rewatch' WHEN NOT br THEN 'after_uninterrupted_viewing' ELSE 'other' END AS context, count(*) AS n FROM f GROUP BY 1""")
def playback_context(s, d):
    done = replay.replay(X.events(s, d), X.GAP)
    attempts = X.events(s, d).filter("event_type = 'heartbeat'").select(*replay.SESSION, F.col("id").alias("attempt_id"), F.col("at").alias("shown_at"), F.col("video_ts").alias("checkpoint_ts"))
    return replay.playback_context(attempts, done, 7200.0).groupBy("context").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X.RS}, q AS (SELECT student_id, exam_id, question_id, max(CAST(is_correct AS INT)) AS ok FROM rs GROUP BY 1, 2, 3) SELECT student_id, exam_id, count(*) AS questions, CAST(sum(ok) AS BIGINT) AS correct, round(100.0 * sum(ok) / count(*), 3) AS score FROM q GROUP BY 1, 2")
def ever_correct_score(s, d):
    return scoring.ever_correct(X.responses(s, d), SE).withColumns(r3("score"))


@query(f"WITH {X.RS}, c AS (SELECT *, option_id <> 1 AS answered, option_id <> 1 AND is_correct AS ok, nullif(attempt_number, 2) AS nth, CASE WHEN option_id <> 3 THEN 30 + topic END AS allowed FROM rs) SELECT CAST(topic AS VARCHAR) AS topic, count(*) AS shown, count(*) FILTER (WHERE answered) AS answered, count(*) FILTER (WHERE ok) AS correct, round(100.0 * count(*) FILTER (WHERE ok) / count(*) FILTER (WHERE answered), 3) AS accuracy, round(100.0 * count(*) FILTER (WHERE answered) / count(*), 3) AS completion, round(100.0 * count(*) FILTER (WHERE ok AND coalesce(nth, 1) = 1) / count(*) FILTER (WHERE answered AND coalesce(nth, 1) = 1), 3) AS first_accuracy, median(response_s) FILTER (WHERE answered) AS median_response, round(median(100 * response_s / allowed) FILTER (WHERE answered), 6) AS median_allowed_share, round(100.0 * count(*) FILTER (WHERE option_id = 0) / count(*), 3) AS skip_rate, round(100.0 * count(*) FILTER (WHERE response_s > 45) / count(*), 3) AS timeout_rate FROM c GROUP BY 1")
def checkpoint_bundle(s, d):
    rows = X.responses(s, d).withColumns({"skipped": F.col("option_id") == 0, "timed_out": F.col("response_s") > 45, "answered_at": F.when(F.col("option_id") != 1, F.col("day")), "attempt_number": F.nullif("attempt_number", F.lit(2)), "allowed_s": F.when(F.col("option_id") != 3, 30 + F.col("topic"))})
    out = scoring.checkpoint_bundle(rows, ["topic"]).withColumns(r3("accuracy", "completion", "first_accuracy", "skip_rate", "timeout_rate"))
    return out.select("topic", "shown", "answered", "correct", "accuracy", "completion", "first_accuracy", "median_response", F.round("median_allowed_share", 6).alias("median_allowed_share"), "skip_rate", "timeout_rate")


@query(f"WITH {X.RS} SELECT exam_id, count(*) FILTER (WHERE difficulty = 'F') AS f, count(*) FILTER (WHERE difficulty = 'O') AS o FROM rs GROUP BY 1")
def attention_contexts(s, d):
    counted = scoring.attention_counts(X.responses(s, d).withColumn("context", F.col("difficulty")), ["exam_id"])
    return counted.select("exam_id", F.coalesce(F.element_at("contexts", "F"), F.lit(0)).alias("f"), F.coalesce(F.element_at("contexts", "O"), F.lit(0)).alias("o"))


@query(f"WITH {X.RS}, a AS (SELECT 'topic' AS dimension, CAST(topic AS VARCHAR) AS value, question_id, max(CAST(is_correct AS INT)) AS ok FROM rs GROUP BY 1, 2, 3 UNION ALL SELECT 'difficulty', difficulty, question_id, max(CAST(is_correct AS INT)) FROM rs GROUP BY 1, 2, 3) SELECT dimension, value, count(*) AS questions, CAST(sum(ok) AS BIGINT) AS correct, round(100.0 * sum(ok) / count(*), 3) AS score FROM a WHERE value IS NOT NULL GROUP BY 1, 2")
def breakdown_grouping_sets(s, d):
    return scoring.breakdown(X.responses(s, d), ["topic", "difficulty"]).withColumns(r3("score"))


@query(f"WITH {X.RS}, q AS (SELECT student_id, topic, question_id, max(CAST(is_correct AS INT)) AS ok FROM rs GROUP BY 1, 2, 3), t AS (SELECT student_id, CAST(topic AS VARCHAR) AS topic, count(*) AS questions, CAST(sum(ok) AS BIGINT) AS correct, 100.0 * sum(ok) / count(*) AS score FROM q GROUP BY 1, 2) SELECT student_id, topic, questions, correct, round(score, 3) AS score, questions >= 2 AS conclusive, CASE WHEN questions >= 2 AND score >= 75 THEN 'strength' WHEN questions >= 2 AND score < 60 THEN 'weakness' ELSE 'open' END AS verdict FROM t")
def topic_conclusive(s, d):
    return scoring.topics(X.responses(s, d), ["student_id"]).withColumns(r3("score"))


@query(f"WITH {X.RS}, a AS (SELECT student_id, avg(CAST(is_correct AS INT)) FILTER (WHERE exam_id < 2) * 100 AS x, avg(CAST(is_correct AS INT)) FILTER (WHERE exam_id = 2) * 100 AS y, avg(response_s) FILTER (WHERE exam_id > 2) AS z, count(*) AS n FROM rs GROUP BY 1), w AS (SELECT *, CASE WHEN x IS NULL THEN 0 ELSE .6 END + CASE WHEN y IS NULL THEN 0 ELSE .35 END + CASE WHEN z IS NULL OR (x IS NULL AND y IS NULL) THEN 0 ELSE .05 END AS tw, coalesce(x * .6, 0) + coalesce(y * .35, 0) + CASE WHEN x IS NULL AND y IS NULL THEN 0 ELSE coalesce(z * .05, 0) END AS v FROM a) SELECT student_id, round(CASE WHEN tw > 0 THEN v / tw END, 9) AS mastery, CASE WHEN n >= 8 THEN 'HIGH' WHEN n >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM w")
def weighted_mastery(s, d):
    ok = F.col("is_correct").cast("int")
    a = X.responses(s, d).groupBy("student_id").agg((F.avg(F.when(F.col("exam_id") < 2, ok)) * 100).alias("x"), (F.avg(F.when(F.col("exam_id") == 2, ok)) * 100).alias("y"), F.avg(F.when(F.col("exam_id") > 2, F.col("response_s"))).alias("z"), F.count(F.lit(1)).alias("n"))
    return a.select("student_id", F.round(scoring.mastery(F.col("x"), F.col("y"), F.col("z")), 9).alias("mastery"), scoring.confidence(F.col("n"), F.lit(2)).alias("confidence"))


def _weekly(s, d):
    return X.responses(s, d).groupBy("exam_id", F.date_trunc("week", "day").cast("date").alias("week")).agg((100 * F.avg(F.col("is_correct").cast("int"))).alias("accuracy"))


_WEEKLY = X.RS + ", wk AS (SELECT exam_id, CAST(date_trunc('week', day) AS DATE) AS week, 100 * avg(CAST(is_correct AS INT)) AS accuracy FROM rs GROUP BY 1, 2)"


@query(f"WITH {_WEEKLY} SELECT a.exam_id, CAST(a.week AS VARCHAR) AS week, round(a.accuracy, 3) AS accuracy, round(b.accuracy, 3) AS previous, round(a.accuracy - b.accuracy, 3) AS change FROM wk a LEFT JOIN wk b ON a.exam_id = b.exam_id AND b.week = a.week - 7")
def week_trend(s, d):
    return scoring.trend(_weekly(s, d), ["exam_id"], "accuracy").withColumns(r3("accuracy", "previous", "change")).withColumn("week", F.col("week").cast("string"))


@query(f"WITH {_WEEKLY} SELECT a.exam_id, CAST(a.week AS VARCHAR) AS week, round(median(b.accuracy), 3) AS baseline FROM wk a LEFT JOIN wk b ON a.exam_id = b.exam_id AND b.week IN (a.week - 14, a.week - 21, a.week - 28, a.week - 35) GROUP BY 1, 2")
def baseline_median(s, d):
    return scoring.baseline(_weekly(s, d), ["exam_id"], "accuracy").select("exam_id", F.col("week").cast("string").alias("week"), F.round("baseline", 3).alias("baseline"))


@query(f"WITH {X.RS}, e AS (SELECT student_id, is_correct AS ok, day - min(day) OVER (PARTITION BY student_id, topic) AS k FROM rs WHERE topic > 0), g AS (SELECT student_id, round_even(100.0 * count(*) FILTER (WHERE k = 0 AND ok) / count(*) FILTER (WHERE k = 0), 1) AS immediate, CASE WHEN count(*) FILTER (WHERE k >= 3) > 0 THEN round_even(100.0 * count(*) FILTER (WHERE k >= 3 AND ok) / count(*) FILTER (WHERE k >= 3), 1) END AS delayed, count(*) FILTER (WHERE k >= 3) AS delayed_items FROM e GROUP BY 1) SELECT student_id, CASE WHEN delayed_items > 0 THEN 'AVAILABLE' ELSE 'NOT_ENOUGH_DATA' END AS status, immediate, delayed, round_even(delayed - immediate, 1) AS change, delayed_items FROM g")
def retention_delay(s, d):
    return scoring.retention(X.responses(s, d).withColumn("topic", F.nullif("topic", F.lit(0))), ["student_id"])


@query("SELECT o_custkey AS student_id, round_even(100 * sum(least(greatest((1704067200 - a) / greatest(b - a, 1), 0), 1) * w) / sum(w), 1) AS expected, round_even(100 * sum(least(greatest(c, 0), 100) / 100 * w) / sum(w), 1) AS actual, round_even(round_even(100 * sum(least(greatest(c, 0), 100) / 100 * w) / sum(w), 1) - round_even(100 * sum(least(greatest((1704067200 - a) / greatest(b - a, 1), 0), 1) * w) / sum(w), 1), 1) AS gap, count(*) AS assigned FROM (SELECT o_custkey, epoch_us(o_orderdate) / 1e6 AS a, epoch_us(o_orderdate) / 1e6 + 86400.0 * 365 * 4 AS b, CASE WHEN o_totalprice > 1000 THEN o_totalprice ELSE 1.0 END AS w, (o_orderkey % 150)::DOUBLE AS c FROM orders) GROUP BY 1")
def expected_progress(s, d):
    from .functions import epoch

    start = epoch(F.col("o_orderdate"))
    x = table(s, d, "orders").select(F.col("o_custkey").alias("student_id"), start.alias("available"), (start + 86400.0 * 365 * 4).alias("due"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("duration"), (F.col("o_orderkey") % 150).alias("coverage"))
    return scoring.expected_progress(x, ["student_id"], 1704067200.0).drop("status")


@query(f"WITH {X.FF} SELECT student_id, exam_id, question_id, first_correct, final_correct, final_response, tries FROM ff")
def first_final_response(s, d):
    return _first_final(s, d).select(*SE, "question_id", "first_correct", "final_correct", "final_response", "tries")


@query(f"WITH {X.FF} SELECT exam_id, question_id, count(*) AS students, count(*) FILTER (WHERE final_correct) AS correct, round(100.0 * count(*) FILTER (WHERE final_correct) / count(*), 3) AS accuracy, round(100.0 * count(*) FILTER (WHERE tries > 1) / count(*), 3) AS retry_rate, quantile_cont(final_response, 0.25) AS p25, quantile_cont(final_response, 0.5) AS median_response, quantile_cont(final_response, 0.75) AS p75, CASE WHEN 100.0 * count(*) FILTER (WHERE final_correct) / count(*) >= 80 THEN 'easy' WHEN 100.0 * count(*) FILTER (WHERE final_correct) / count(*) >= 50 THEN 'moderate' ELSE 'difficult' END AS difficulty FROM ff GROUP BY 1, 2")
def item_stats(s, d):
    return exam.item_stats(_first_final(s, d), ["exam_id", "question_id"]).withColumns(r3("accuracy", "retry_rate")).select("exam_id", "question_id", "students", "correct", "accuracy", "retry_rate", "p25", "median_response", "p75", "difficulty")


@query(f"WITH {X.FF}, t AS (SELECT student_id, exam_id, 100.0 * count(*) FILTER (WHERE final_correct) / count(*) AS score FROM ff GROUP BY 1, 2), h AS (SELECT CAST(least(floor(score / 20), 4) AS BIGINT) AS bin, count(*) AS n FROM t GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS bin) b LEFT JOIN h ON b.bin = h.bin")
def score_histogram(s, d):
    scores = _first_final(s, d).groupBy(*SE).agg((100.0 * F.count_if("final_correct") / F.count(F.lit(1))).alias("score"))
    return exam.histogram(scores)


@query(f"WITH {X.FF}, f AS (SELECT exam_id, student_id, question_id, CASE WHEN final_correct THEN 1.0 ELSE 0.0 END AS item FROM ff), g AS (SELECT *, sum(item) OVER (PARTITION BY exam_id, student_id) - item AS rest FROM f) SELECT exam_id * 100 + question_id AS question_id, count(*) AS students, round(corr(item, rest), 6) AS correlation FROM g GROUP BY 1")
def item_rest_correlation(s, d):
    # an exam's questions and sitters are its own
    own = _first_final(s, d).withColumns({"question_id": F.col("exam_id") * 100 + F.col("question_id"), "student_id": F.struct("exam_id", "student_id")})
    return exam.item_rest(own).select("question_id", "students", F.round("correlation", 6).alias("correlation"))


@query(f"WITH {X.RS}, c AS (SELECT question_id, CASE WHEN attempt_number = 3 THEN [option_id, (option_id + 1) % 4] ELSE [option_id] END AS selected, CASE WHEN o_totalprice >= 180000 THEN 'high' WHEN o_totalprice < 110000 THEN 'low' ELSE 'middle' END AS level FROM rs JOIN orders ON sitting_id = o_orderkey), o AS (SELECT q.question_id, r.option_id FROM (SELECT DISTINCT question_id FROM rs) q, (SELECT unnest(range(6)) AS option_id) r WHERE q.question_id % 4 <> r.option_id), t AS (SELECT question_id, count(*) AS a, count(*) FILTER (WHERE level = 'high') AS h, count(*) FILTER (WHERE level = 'low') AS l FROM c GROUP BY 1), e AS (SELECT question_id, option_id, count(*) AS p, count(*) FILTER (WHERE level = 'high') AS ph, count(*) FILTER (WHERE level = 'low') AS pl FROM (SELECT question_id, level, unnest(selected) AS option_id FROM c) GROUP BY 1, 2), x AS (SELECT question_id, option_id, coalesce(p, 0) AS picked, h, l, round_even(100.0::DOUBLE * coalesce(p, 0) / a, 1) AS share, round_even(100.0::DOUBLE * coalesce(ph, 0) / h, 1) AS hs, round_even(100.0::DOUBLE * coalesce(pl, 0) / l, 1) AS ls FROM o LEFT JOIN t USING (question_id) LEFT JOIN e USING (question_id, option_id)) SELECT question_id, option_id, picked, share, CASE WHEN h >= 5 AND l >= 5 AND hs - ls >= 20 THEN 'suspicious' WHEN share >= 25 THEN 'strong_misconception' WHEN share < 5 THEN 'non_functioning' ELSE 'functioning' END AS class FROM x")
def distractor_class(s, d):
    totals = table(s, d, "orders").select(F.col("o_orderkey").alias("sitting_id"), F.col("o_totalprice").alias("score"))
    level = F.when(F.col("score") >= 180000, "high").when(F.col("score") < 110000, "low").otherwise("middle")
    selected = F.when(F.col("attempt_number") == 3, F.array("option_id", (F.col("option_id") + 1) % 4)).otherwise(F.array("option_id"))
    answers = X.responses(s, d).join(totals, "sitting_id").select("question_id", selected.alias("selected"), level.alias("level"))
    options = answers.select("question_id").distinct().withColumn("option_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    return exam.distractors(answers, options.withColumn("is_key", F.col("question_id") % 4 == F.col("option_id")))


@query(f"WITH {X.FF}, e AS (SELECT exam_id, quantile_cont(final_response, 0.75) AS p75 FROM ff GROUP BY 1), i AS (SELECT exam_id, question_id, round(100.0 * count(*) FILTER (WHERE final_correct) / count(*), 1) AS acc, round(100.0 * count(*) FILTER (WHERE tries > 1) / count(*), 1) AS rr, quantile_cont(final_response, 0.5) AS mr FROM ff GROUP BY 1, 2) SELECT exam_id, question_id, round(least((100 - acc) * 0.35 + rr * 0.15 + CASE WHEN mr > p75 THEN 10 ELSE 0 END, 100), 3) AS score, concat_ws(', ', CASE WHEN acc < 50 THEN printf('%.1f%% correct', acc) END, CASE WHEN rr >= 25 THEN printf('%.1f%% required retry', rr) END, CASE WHEN mr > p75 THEN 'response time above exam p75' END) AS reasons FROM i JOIN e USING (exam_id)")
def priority_score(s, d):
    finals = _first_final(s, d)
    times = finals.groupBy("exam_id").agg(F.percentile("final_response", 0.75).alias("exam_p75"))
    none = {"discrimination": "string", "misconception_share": "double", "misconception_order": "int", "suspicious_order": "int", "skip_rate": "double"}
    items = exam.item_stats(finals, ["exam_id", "question_id"]).withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    items = items.withColumns({"accuracy": F.round("accuracy", 1), "retry_rate": F.round("retry_rate", 1)}).join(times, "exam_id")
    return exam.priorities(items).select("exam_id", "question_id", F.round("score", 3).alias("score"), "reasons")


@query(f"WITH {X.FF}, t AS (SELECT student_id, exam_id, count(*) >= 2 AS done, 100.0 * count(*) FILTER (WHERE final_correct) / count(*) AS score, 100.0 * count(*) FILTER (WHERE first_correct) / count(*) AS fa, 100.0 * count(*) FILTER (WHERE tries > 1) / count(*) AS rr FROM ff GROUP BY 1, 2) SELECT CASE WHEN NOT done THEN 'Low completion' WHEN rr >= 50 THEN 'High retry dependency' WHEN score < 60 THEN 'Low attempted accuracy' WHEN fa < 50 THEN 'Low first-attempt knowledge' WHEN score >= 85 AND rr < 25 THEN 'Secure first-attempt performance' ELSE 'No immediate concern' END AS issue, count(*) AS n FROM t GROUP BY 1")
def support_segment(s, d):
    n = F.count(F.lit(1))
    x = _first_final(s, d).groupBy(*SE).agg((n >= 2).alias("completed"), (100.0 * F.count_if("final_correct") / n).alias("score"), (100.0 * F.count_if("first_correct") / n).alias("first_accuracy"), (100.0 * F.count_if(F.col("tries") > 1) / n).alias("retry_rate"))
    x = x.withColumns({"accuracy": F.col("score"), "weak_topics": F.array().cast("array<string>")})
    return exam.support(x).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X.RS}, q AS (SELECT exam_id, topic, question_id, count(*) FILTER (WHERE attempt_number = 1) AS n, count(*) FILTER (WHERE attempt_number = 1 AND is_correct) AS ok, count(*) FILTER (WHERE option_id = 3) AS third, count(*) AS everyone FROM rs GROUP BY 1, 2, 3) SELECT exam_id, CAST(topic AS BIGINT) AS topic, count(*) AS questions, count(*) FILTER (WHERE 100.0 * third / everyone >= 25) AS dominant, count(*) FILTER (WHERE n > 0 AND 100.0 * ok / n < 60) AS missed FROM q GROUP BY 1, 2 HAVING count(*) >= 2 AND (count(*) FILTER (WHERE 100.0 * third / everyone >= 25) > 0 OR count(*) FILTER (WHERE n > 0 AND 100.0 * ok / n < 60) >= 2)")
def misconception_clusters(s, d):
    first, n = F.col("attempt_number") == 1, F.count(F.lit(1))
    x = X.responses(s, d).groupBy("exam_id", "topic", "question_id").agg((100.0 * F.count_if(first & F.col("is_correct")) / F.nullif(F.count_if(first), F.lit(0))).alias("first_accuracy"), (100.0 * F.count_if(F.col("option_id") == 3) / n >= 25).alias("misconception"))
    return exam.clusters(x, ["exam_id"]).select("exam_id", "topic", "questions", "dominant", "missed")


_STATES = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, o_custkey % 4 AS tries, CASE WHEN o_orderkey % 2 = 0 THEN 'r' END AS remote, o_orderdate AS seen FROM orders"


@query(f"WITH j AS ({_STATES}), r AS (SELECT id, CASE WHEN status = 'submitted' AND remote IS NULL AND seen < TIMESTAMP '1996-01-01' - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status, tries FROM j), f AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN id % 7 = 0 AND id % 2 = 1 THEN 3 ELSE tries END AS tries FROM r), d AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 11 = 0 THEN greatest(tries - 1, 0) ELSE tries END AS tries FROM f), c AS (SELECT CASE WHEN id % 13 = 0 AND status <> 'completed' THEN 'failed' ELSE status END AS status, CASE WHEN id % 13 = 0 AND status <> 'completed' THEN 3 ELSE tries END AS tries FROM d) SELECT status, CAST(tries AS BIGINT) AS attempt_count, count(*) AS n FROM c GROUP BY 1, 2")
def job_transitions(s, d):
    orders, now, state = table(s, d, "orders"), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderstatus")
    key = F.col("o_orderkey")
    rows = orders.select(key.alias("id"), F.when(state == "O", "submitted").when(state == "F", "failed").otherwise("completed").alias("status"), (F.col("o_custkey") % 4).alias("attempt_count"), F.lit(3).cast("bigint").alias("max_attempts"), F.when(key % 2 == 0, "r").alias("remote_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("string").alias("last_error"))
    ids = lambda m: orders.filter(key % m == 0).select(key.alias("id"), F.lit("x").alias("reason"))
    done = jobs.recovered(rows, now, 30)
    done = jobs.failed(done, ids(7).withColumn("permanent", F.col("id") % 2 == 1), now)
    done = jobs.cancelled(jobs.deferred(done, ids(11), now), ids(13), now)
    return done.groupBy("status", "attempt_count").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X.RS}, t AS (SELECT student_id, topic, 100.0 * count(*) FILTER (WHERE is_correct) / count(*) AS score FROM rs GROUP BY 1, 2), g AS (SELECT c_custkey AS student_id FROM customer WHERE c_acctbal / 100 < -5), w AS (SELECT student_id, topic, row_number() OVER (PARTITION BY student_id ORDER BY topic) AS nth FROM t WHERE score < 65), a AS (SELECT student_id, 1 AS step, 1 AS nth, 'catch_up' AS action, NULL AS subject FROM g UNION ALL SELECT student_id, 2, nth, 'revise', CAST(topic AS VARCHAR) FROM w WHERE nth <= CASE WHEN student_id IN (SELECT student_id FROM g) THEN 2 ELSE 3 END UNION ALL SELECT student_id, 3, 1, 'retry', CAST(min(sitting_id) AS VARCHAR) FROM rs WHERE response_s > 48 GROUP BY student_id UNION ALL SELECT student_id, 4, 1, 'watch', CAST(min(sitting_id) AS VARCHAR) FROM rs WHERE response_s < 3 GROUP BY student_id), e AS (SELECT * FROM a UNION ALL SELECT c_custkey, 5, 1, 'keep_going', NULL FROM customer WHERE c_custkey NOT IN (SELECT student_id FROM a)) SELECT student_id, CAST(row_number() OVER (PARTITION BY student_id ORDER BY step, nth) AS INT) AS position, action, subject FROM e")
def action_plan(s, d):
    rows, people = X.responses(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("student_id"), (F.col("c_acctbal") / 100).alias("gap"))
    topics = rows.groupBy("student_id", "topic").agg((100.0 * F.count_if("is_correct") / F.count(F.lit(1))).alias("score")).withColumn("rank", F.col("topic"))
    first = lambda on: rows.filter(on).groupBy("student_id").agg(F.min("sitting_id").alias("subject")).withColumn("rank", F.lit(0))
    return scoring.action_plan(people, people, topics, first("response_s > 48"), first("response_s < 3"), "student_id")


@query("""SELECT 'lines without a part' AS "check", count(*) AS offending FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT 'orders without a customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'repeated texts', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT 'unknown kinds', count(*) FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')
UNION ALL SELECT 'missing or negative values', count(*) FROM events WHERE value IS NULL OR value < 0
UNION ALL SELECT 'past the end', count(*) FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem GROUP BY 1) USING (l_orderkey) WHERE l_quantity > last * 10 + 1""")
def integrity_checks(s, d):
    lines, facts = table(s, d, "lineitem"), table(s, d, "events")
    last = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))
    return access.violations({
        "lines without a part": access.orphans(lines, table(s, d, "part").filter("p_size > 5"), {"l_partkey": "p_partkey"}),
        "orders without a customer": access.orphans(table(s, d, "orders"), table(s, d, "customer"), {"o_custkey": "c_custkey"}),
        "repeated texts": access.repeated(table(s, d, "documents"), ["text"]),
        "unknown kinds": facts.filter(~F.col("event_type").isin("view", "click", "purchase", "signup")),
        "missing or negative values": facts.filter("value IS NULL OR value < 0"),
        "past the end": lines.join(last, "l_orderkey").filter("l_quantity > last * 10 + 1"),
    })


@query("WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS k, role, text FROM conversations WHERE turn >= 2), f AS (SELECT conv_id, turn FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.turn < 2 AND c.conv_id = n.conv_id AND c.role = n.role AND c.text = n.text)), l AS (SELECT conv_id, max(turn) + 1 AS last FROM conversations WHERE turn < 2 GROUP BY 1) SELECT conv_id AS session_id, turn AS id, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS message_order FROM f LEFT JOIN l USING (conv_id)")
def message_order(s, d):
    x = table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("turn").alias("at"), F.concat_ws(":", "role", "text").alias("request_key"), (F.col("turn") + 1).alias("message_order"))
    return access.allocated(x.filter("id >= 2").drop("message_order"), x.filter("id < 2")).select("session_id", "id", "message_order")


@query(f"WITH {X.RS} SELECT e.exam_id, questions, sittings, students FROM (SELECT exam_id, count(DISTINCT question_id) AS questions FROM rs GROUP BY 1) e JOIN (SELECT o_orderkey % 5 AS exam_id, count(*) AS sittings, count(DISTINCT o_custkey) AS students FROM orders GROUP BY 1) t USING (exam_id)")
def exam_listing(s, d):
    questions = X.responses(s, d).groupBy("exam_id").agg(F.count_distinct("question_id").alias("questions"))
    sittings = table(s, d, "orders").groupBy((F.col("o_orderkey") % 5).alias("exam_id")).agg(F.count(F.lit(1)).alias("sittings"), F.count_distinct("o_custkey").alias("students"))
    return questions.join(sittings, "exam_id")


@query("SELECT count(*) AS sittings, count(DISTINCT o_custkey) AS students FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def outsider_count(s, d):
    cohort = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(cohort, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("sittings"), F.count_distinct("o_custkey").alias("students"))


@query(f"WITH {X.FF}, i AS (SELECT exam_id, question_id, 100.0 * count(*) FILTER (WHERE final_correct) / count(*) AS acc FROM ff GROUP BY 1, 2) SELECT exam_id, arg_min(question_id, {{'a': acc, 'b': question_id}}) AS hardest, arg_min(question_id, {{'a': -acc, 'b': question_id}}) AS easiest FROM i GROUP BY 1")
def question_extremes(s, d):
    x = exam.item_stats(_first_final(s, d), ["exam_id", "question_id"])
    return x.groupBy("exam_id").agg(F.min_by("question_id", F.struct("accuracy", "question_id")).alias("hardest"), F.min_by("question_id", F.struct(-F.col("accuracy"), "question_id")).alias("easiest"))


_DIST = "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT query_id, vec_id, CAST(label AS BIGINT) AS video_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 12) AS dist FROM embeddings, q), k AS (SELECT query_id, vec_id, video_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS n FROM x) WHERE n <= 30)"


def _nearest(s, d):
    rows = X.chunks(s, d)
    return vectors.nearest(vectors.build(rows), rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 30).drop("rank")


@query(f"{_DIST} SELECT query_id, vec_id, video_id, abs(round(dist, 6)) AS distance FROM k")
def topk_cosine(s, d):
    return _nearest(s, d).withColumn("distance", F.abs(F.round("distance", 6)))


@query(f"{_DIST} SELECT query_id, vec_id, video_id, abs(round(dist, 6)) AS distance FROM k WHERE dist <= 0.75")
def relevance_cut(s, d):
    return retrieval.relevant(_nearest(s, d), 0.75).withColumn("distance", F.abs(F.round("distance", 6)))


@query("SELECT vec_id, CAST(label AS BIGINT) AS video_id, position FROM embeddings JOIN (SELECT unnest([41, 7, 99, 3]) AS vec_id, unnest([0, 1, 2, 3]) AS position) USING (vec_id)")
def citation_order(s, d):
    return retrieval.restored(X.chunks(s, d), [41, 7, 99, 3]).select("vec_id", "video_id", "position").orderBy("position")


_PASSAGES = "p AS (SELECT label AS video_id, (vec_id * 7 % 1000) * 1.0 AS s0, (vec_id * 7 % 1000) + 30.0 AS s1, (vec_id % 13) / 13.0 AS distance FROM embeddings)"


@query(f"WITH {_PASSAGES}, a AS (SELECT *, max(s1) OVER (PARTITION BY video_id ORDER BY s0, s1, distance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), b AS (SELECT *, sum(CASE WHEN s0 <= reach + 20 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY s0, s1, distance ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT CAST(video_id AS BIGINT) AS video_id, CAST(greatest(min(s0) - 3, 0) AS DOUBLE) AS s0, CAST(max(s1) AS DOUBLE) AS s1, round(min(distance), 6) AS distance, count(*) AS n FROM b GROUP BY video_id, g")
def segment_merge(s, d):
    at = F.col("vec_id") * 7 % 1000
    p = X.chunks(s, d).select("video_id", at.cast("double").alias("start"), (at + 30.0).alias("end"), (F.col("vec_id") % 13 / 13.0).alias("distance"))
    return intervals.segments(p).select("video_id", F.col("start").alias("s0"), F.col("end").alias("s1"), F.round("distance", 6).alias("distance"), "n")


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, greatest(CAST(trunc(n_chars / 15) AS BIGINT), 1) AS dur FROM documents),
 n AS (SELECT doc_id, ws, dur, len(ws) AS total FROM w WHERE len(ws) > 0),
 r AS (SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS s, CASE WHEN total <= 120 THEN total ELSE coalesce(list_max(list_filter(range(95, 120), lambda i: regexp_matches(ws[i + 1], '[.،؟!؛?]$'))) + 1, 120) END AS e FROM n
  UNION ALL SELECT doc_id, k + 1, e - 25, CASE WHEN total <= e + 95 THEN total ELSE coalesce(list_max(list_filter(range(e + 70, e + 95), lambda i: regexp_matches(ws[i + 1], '[.،؟!؛?]$'))) + 1, e + 95) END FROM r JOIN n USING (doc_id) WHERE e < total),
 m AS (SELECT *, max(k) OVER (PARTITION BY doc_id) AS last, lead(e) OVER (PARTITION BY doc_id ORDER BY k) AS e2, lead(s) OVER (PARTITION BY doc_id ORDER BY k) AS s2 FROM r),
 j AS (SELECT doc_id, k, s, CASE WHEN k = last - 1 AND e2 - s2 < 40 THEN e2 ELSE e END AS e FROM m WHERE NOT (k = last AND k > 0 AND e - s < 40))
 SELECT doc_id AS block_id, k AS chunk, array_to_string(ws[s + 1 : e], ' ') AS text, CAST(round_even(CAST(dur AS DOUBLE) * s / total, 0) AS BIGINT) AS start_ts, greatest(CAST(round_even(CAST(dur AS DOUBLE) * e / total, 0) AS BIGINT), CAST(round_even(CAST(dur AS DOUBLE) * s / total, 0) AS BIGINT) + 1) AS end_ts FROM j JOIN n USING (doc_id)""")
def chunk_windows(s, d):
    blocks = table(s, d, "documents").select(F.col("doc_id").alias("block_id"), "text", F.lit(0).cast("bigint").alias("start_ts"), (F.col("n_chars") / 15).cast("bigint").alias("end_ts"))
    return retrieval.chunk_texts(blocks)


@query("SELECT doc_id, greatest(1, CAST(floor((strlen(coalesce(text, '')) + 1) / 2) AS BIGINT)) AS tokens FROM documents")
def token_estimates(s, d):
    return table(s, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')))) AS key, strlen(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS n FROM conversations WHERE role = 'user'")
def query_keys(s, d):
    return table(s, d, "conversations").filter("role = 'user'").select("conv_id", "turn", query_key(F.col("text")).alias("key"), F.octet_length(collapsed(F.col("text"))).cast("bigint").alias("n"))


@query("WITH k AS (SELECT lang, text, min(doc_id) AS vec_id FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2) SELECT d.doc_id, k.vec_id, k.vec_id IS NULL AS missing FROM documents d LEFT JOIN k ON d.lang = k.lang AND d.text = k.text")
def embedding_reuse(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("lang").alias("video_id"), "text")
    stored = docs.filter("doc_id % 3 = 0").select("video_id", "text", F.col("doc_id").alias("vec_id"), F.col("doc_id").alias("embedding"))
    return retrieval.reuse(docs, stored).select("doc_id", F.col("embedding").alias("vec_id"), "missing")


_TURNS = "t0 AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS pair FROM conversations WHERE role IN ('user','assistant')), tp AS (SELECT conv_id, CAST(pair AS BIGINT) AS pair, min(turn) FILTER (WHERE role = 'user') AS user_turn, min(turn) FILTER (WHERE role = 'assistant') AS assistant_turn, arg_min(text, turn) FILTER (WHERE role = 'user') AS q, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM t0 WHERE pair > 0 GROUP BY 1, 2), tt AS (SELECT *, greatest(1, (strlen(coalesce(q, '')) + 1) // 2) + 4 + CASE WHEN assistant_turn IS NULL THEN 0 ELSE greatest(1, (strlen(coalesce(a, '')) + 1) // 2) + 4 END AS tokens FROM tp)"


@query(f"WITH {_TURNS} SELECT conv_id, pair, user_turn, assistant_turn, CAST(tokens AS BIGINT) AS tokens FROM tt")
def turn_pairing(s, d):
    return memory.turns(table(s, d, "conversations")).select("conv_id", "pair", "user_turn", "assistant_turn", "tokens")


@query(f"WITH {_TURNS}, u AS (SELECT conv_id, pair, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pair DESC ROWS UNBOUNDED PRECEDING) AS used FROM tt) SELECT conv_id, pair, CAST(used AS BIGINT) AS used FROM u WHERE used <= 400")
def recent_turns(s, d):
    return memory.recent_turns(memory.turns(table(s, d, "conversations")), 400).select("conv_id", "pair", "used")


@query("WITH m AS (SELECT *, greatest(1, (strlen(coalesce(text, '')) + 1) // 2) AS tokens FROM conversations WHERE conv_id % 2 = 1 OR turn > conv_id % 3), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM m), p AS (SELECT conv_id, turn, tokens, sum(tokens + 4) OVER (PARTITION BY conv_id) AS total FROM o WHERE n > 4) SELECT conv_id, turn, CAST(tokens AS BIGINT) AS tokens FROM p WHERE total >= 300")
def summarise_prefix(s, d):
    messages = table(s, d, "conversations")
    marks = messages.filter("conv_id % 2 = 0").select("conv_id", (F.col("conv_id") % 3).alias("checkpoint"))
    return memory.to_summarise(messages, 300, checkpoints=marks).select("conv_id", "turn", "tokens")


@query("""WITH RECURSIVE p AS (SELECT conv_id AS key, turn AS rank, turn % 5 AS chunk_id, greatest(1, (strlen(coalesce(text, '')) + 1) // 2) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, turn % 5) AS n FROM conversations),
 f AS (SELECT key, n, tokens + 16 <= 400 AS take, CASE WHEN tokens + 16 <= 400 THEN 400 - tokens - 16 ELSE 400 END AS room, CASE WHEN tokens + 16 <= 400 THEN [chunk_id] ELSE CAST([] AS BIGINT[]) END AS seen FROM p WHERE n = 1
  UNION ALL SELECT p.key, p.n, NOT list_contains(seen, chunk_id) AND tokens + 16 <= room, CASE WHEN NOT list_contains(seen, chunk_id) AND tokens + 16 <= room THEN room - tokens - 16 ELSE room END, CASE WHEN NOT list_contains(seen, chunk_id) AND tokens + 16 <= room THEN list_append(seen, chunk_id) ELSE seen END FROM f JOIN p ON p.key = f.key AND p.n = f.n + 1)
 SELECT key, rank, chunk_id, CAST(tokens AS BIGINT) AS tokens FROM f JOIN p USING (key, n) WHERE take""")
def packed_passages(s, d):
    return memory.packed(table(s, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("rank"), (F.col("turn") % 5).alias("chunk_id"), token_estimate(F.col("text")).alias("tokens")), 400)


def _catalog(s, d) -> Target:
    return Target(table(s, d, "part"), "p_partkey", {"p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number"}, {"lessons": (table(s, d, "lineitem"), "l_partkey", {"l_linestatus": "text", "l_returnflag": "text", "l_linenumber": "number"})})


_PLAN = {"filters": [{"column": "p_type", "op": "contains", "value": "o"}, {"column": "p_size", "op": "gte", "value": "10"}, {"table": "lessons", "column": "l_linenumber", "op": "lte", "value": 2}, {"column": "secret", "op": "eq", "value": 1}], "limit": 90}
_HAS = "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber <= 2)"


@query(f"SELECT p_partkey, p_name, p_size FROM part WHERE p_type ILIKE '%o%' AND p_size >= 10 AND {_HAS} ORDER BY p_partkey LIMIT 50")
def catalog_search(s, d):
    return search(_PLAN, _catalog(s, d)).select("p_partkey", "p_name", "p_size")


@query(f"SELECT -1 AS position, count(*) AS n FROM part WHERE p_type ILIKE '%o%' AND p_size >= 10 AND {_HAS} UNION ALL SELECT 0, count(*) FROM part WHERE p_type ILIKE '%o%' UNION ALL SELECT 1, count(*) FROM part WHERE p_size >= 10 UNION ALL SELECT 2, count(*) FROM part WHERE {_HAS}")
def catalog_diagnosis(s, d):
    return diagnose(_PLAN, _catalog(s, d))


@query("SELECT s_suppkey, (SELECT kind || ':' || n FROM (SELECT 'region' AS kind, r_name AS n FROM region WHERE r_regionkey = s_nationkey % 10 UNION ALL SELECT 'nation', n_name FROM nation WHERE n_nationkey = s_nationkey) ORDER BY kind DESC LIMIT 1) AS level FROM supplier")
def lateral_level(s, d):
    regions = table(s, d, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("n"))
    nations = table(s, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))
    wanted = table(s, d, "supplier").select("s_suppkey", F.explode(F.array(F.struct(F.lit("region").alias("kind"), (F.col("s_nationkey") % 10).alias("k")), F.struct(F.lit("nation").alias("kind"), F.col("s_nationkey").alias("k")))).alias("w")).select("s_suppkey", "w.kind", "w.k")
    return wanted.join(regions.unionByName(nations), ["kind", "k"], "left").groupBy("s_suppkey").agg(F.max_by(F.concat_ws(":", "kind", "n"), F.when(F.col("n").isNotNull(), F.col("kind"))).alias("level"))


@query("SELECT 'region' AS kind, CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def levels_union(s, d):
    return table(s, d, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")).unionByName(table(s, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")))


@query("SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS parts FROM supplier")
def scalar_counts(s, d):
    counts = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_partkey").alias("parts"))
    return table(s, d, "supplier").select("s_suppkey").join(counts, "s_suppkey", "left").fillna(0)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND (o_totalprice IS NULL OR o_totalprice > 100000))")
def entitled_semi(s, d):
    grants = table(s, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "active")).filter(access.live(F.lit(100000.0), expires="o_totalprice"))
    return table(s, d, "customer").select("c_custkey").join(grants.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT student_id, count(*) AS videos FROM (SELECT o_custkey AS student_id, l_partkey AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' UNION SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 200000) GROUP BY 1")
def accessible_union(s, d):
    orders, lines = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("student_id"), "o_orderstatus", "o_totalprice"), table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("video_id"))
    n = lines.count()
    # an order that gives access twice is one: the lines are joined once
    granted = access.accessible([orders.filter("o_orderstatus = 'F'"), orders.filter("o_totalprice > 200000")], ["o_orderkey", "student_id"])
    rows = access.apart(granted, n, "o_orderkey").join(access.apart(lines, n, "o_orderkey"), "o_orderkey")
    return access.accessible([access.apart(rows.select("student_id", "video_id"), n, "student_id", "video_id")], ["student_id", "video_id"]).groupBy("student_id").agg(F.count(F.lit(1)).alias("videos"))


@query(f"WITH {X.EV}, need AS (SELECT DISTINCT resource_id % 2 AS course_id, resource_id FROM ev) SELECT student_id, course_id FROM (SELECT DISTINCT student_id, resource_id % 2 AS course_id FROM ev) s WHERE NOT EXISTS (SELECT 1 FROM need n WHERE n.course_id = s.course_id AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.student_id = s.student_id AND e.resource_id = n.resource_id AND e.event_type = 'seek'))")
def module_trigger(s, d):
    x = X.events(s, d).withColumn("course_id", F.col("resource_id") % 2)
    return access.completed_all(x.filter("event_type = 'seek'"), x, ["student_id"], ["course_id"], "resource_id")


@query(f"WITH {X.RS} SELECT student_id, exam_id FROM rs GROUP BY 1, 2 HAVING count(DISTINCT question_id % 4) = 4")
def quiz_trigger(s, d):
    x = X.responses(s, d).withColumn("question_id", F.col("question_id") % 4)
    return access.completed_all(x, x, ["student_id"], ["exam_id"], "question_id")


@query("SELECT s_suppkey, n_nationkey, s_nationkey = n_nationkey AS own FROM supplier CROSS JOIN nation")
def cross_access(s, d):
    # every user against every level is the result asked for; the levels are 25 rows by the schema
    return table(s, d, "supplier").crossJoin(F.broadcast(table(s, d, "nation"))).select("s_suppkey", "n_nationkey", (F.col("s_nationkey") == F.col("n_nationkey")).alias("own"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)")
def orphans_anti(s, d):
    return access.orphans(table(s, d, "lineitem"), table(s, d, "part").filter("p_size > 5"), {"l_partkey": "p_partkey"}).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {X.EV}, r AS (SELECT min(id) AS report_id, student_id, resource_id AS doctor_id FROM ev GROUP BY 2, 3), u AS (SELECT report_id, student_id AS user_id FROM r UNION SELECT report_id, doctor_id FROM r) SELECT report_id, user_id FROM u WHERE report_id % 2 <> 0 AND user_id IS NOT NULL")
def notification_fanout(s, d):
    reports = X.events(s, d).groupBy("student_id", F.col("resource_id").alias("doctor_id")).agg(F.min("id").alias("report_id"))
    return access.fan_out(reports, access.fan_out(reports.filter("report_id % 2 = 0"), s.createDataFrame([], "report_id bigint, user_id bigint")))


@query(f"WITH {X.EV} SELECT student_id AS user_id, count(*) FILTER (WHERE video_ts < 50) AS unread, count(*) AS total FROM ev GROUP BY 1")
def inbox_unread(s, d):
    return access.unread(X.events(s, d).select(F.col("student_id").alias("user_id"), F.when(F.col("video_ts") >= 50, F.col("at")).alias("read_at")))


@query("SELECT user_id, event_type, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events GROUP BY 1, 2")
def upsert_latest(s, d):
    x = table(s, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("version"), "value", "event_id")
    first = x.groupBy("user_id", "event_type").agg(F.min_by(F.struct("version", "value"), "version").alias("r")).select("user_id", "event_type", "r.version", "r.value")
    return access.upserted(first, x.drop("event_id"), ["user_id", "event_type"], "version").select("user_id", "event_type", "value")


@query("SELECT DISTINCT user_id, event_type FROM events a WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 0 AND b.user_id = a.user_id AND b.event_type = a.event_type)")
def insert_absent(s, d):
    x = table(s, d, "events").select("event_id", "user_id", "event_type")
    return access.insert_absent(x.filter("event_id % 2 = 1"), x.filter("event_id % 2 = 0"), ["user_id", "event_type"]).select("user_id", "event_type")


@query(f"WITH {X.EV} SELECT id, student_id FROM (SELECT *, row_number() OVER (PARTITION BY student_id, day ORDER BY tm, id) AS n FROM ev) WHERE n <= 2")
def quota_running(s, d):
    return access.within_quota(X.events(s, d), ["student_id", "day"], 2).select("id", "student_id")


@query("SELECT o_orderkey AS id, 'submitted' AS status, CAST(o_custkey % 4 + 1 AS BIGINT) AS attempt_count, CAST(NULL AS VARCHAR) AS remote_id, CASE WHEN o_custkey % 2 = 0 THEN '2023-01-01' ELSE '2024-05-05' END AS started FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_custkey % 4 < 1 + o_custkey % 5) ORDER BY o_orderdate, o_orderkey LIMIT 10")
def job_claim(s, d):
    queue = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), (F.col("o_custkey") % 4).alias("attempt_count"), (1 + F.col("o_custkey") % 5).alias("max_attempts"), F.lit("r").alias("remote_id"), F.when(F.col("o_custkey") % 2 == 0, F.to_timestamp(F.lit("2023-01-01"))).alias("started_at"))
    return access.claimable(queue, 10, "2024-05-05").select("id", "status", "attempt_count", "remote_id", F.date_format("started_at", "yyyy-MM-dd").alias("started"))


@query(f"WITH {X.RS}, r AS (SELECT exam_id AS q, sitting_id AS a, CASE WHEN question_id = 19 THEN 9 ELSE question_id % 2 END AS c, CASE WHEN bool_or(is_correct) THEN CASE WHEN count(*) > 1 THEN 0.5 ELSE 1.0 END ELSE 0.0 END AS v FROM rs GROUP BY exam_id, sitting_id, question_id), k AS (SELECT q, c, CASE WHEN q % 2 = 0 THEN c * 3 + 4 END AS marks FROM (SELECT unnest(range(5)) AS q), (SELECT unnest(range(2)) AS c)), j AS (SELECT r.q, a, count(*) AS n, count(DISTINCT k.c) AS have, count(*) FILTER (WHERE k.c IS NULL) AS strange, sum(v * marks) AS w, sum(v) AS p FROM r LEFT JOIN k ON r.q = k.q AND r.c = k.c GROUP BY 1, 2), x AS (SELECT *, CASE WHEN strange > 0 THEN 'unknown' WHEN have < 2 THEN 'missing' WHEN n <> 2 THEN 'repeated' END AS problem FROM j) SELECT a AS answer_id, problem IS NULL AS complete, problem, CAST(CASE WHEN problem IS NULL THEN round(least(CASE WHEN q % 2 = 0 THEN w ELSE p * 5 END, 10), 2) END AS DOUBLE) AS points FROM x")
def rubric_completeness(s, d):
    x = X.responses(s, d, access.apart).groupBy("exam_id", "sitting_id", "question_id").agg(F.bool_or("is_correct").alias("ok"), F.count(F.lit(1)).alias("n"))
    criterion = F.when(F.col("question_id") == 19, 9).otherwise(F.col("question_id") % 2)
    results = x.select(F.col("exam_id").alias("question_id"), criterion.alias("criterion_id"), F.col("sitting_id").alias("answer_id"), F.when(~F.col("ok"), "no").when(F.col("n") > 1, "partial").otherwise("yes").alias("status"))
    criteria = s.range(5).select(F.col("id").alias("question_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("criterion_id")).withColumn("marks", F.when(F.col("question_id") % 2 == 0, F.col("criterion_id") * 3 + 4))
    return access.rubric_scores(results, criteria).select("answer_id", "complete", "problem", "points")


@query("SELECT count(*) AS n, round(avg(abs(quality - toxic)), 6) AS mae, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS exact FROM labels")
def evaluation_metrics(s, d):
    return access.agreement(table(s, d, "labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("given"))).select("n", F.round("mae", 6).alias("mae"), F.round("exact", 6).alias("exact"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def string_agg_listing(s, d):
    return table(s, d, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(s, d):
    return table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT text, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) > 1")
def having_dupes(s, d):
    return table(s, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n > 1")


@query("SELECT page_id, coalesce(lower(regexp_extract(url, '(?i)^https://([^/?#@:]+)(?:[/?#]|$)', 1)) IN ('example.com', 'www.example.com', 'site0.example'), false) AS allowed, printf('%02d:%02d:%02d', page_id // 3600, page_id % 3600 // 60, page_id % 60) AS stamp, page_id AS back FROM pages")
def url_and_stamp(s, d):
    x = table(s, d, "pages").select("page_id", F.coalesce(host_allowed(F.col("url"), ["example.com", "www.example.com", "site0.example"]), F.lit(False)).alias("allowed"), stamp(F.col("page_id")).alias("stamp"))
    return x.withColumn("back", seconds(F.col("stamp")))


@query("WITH u AS (SELECT page_id, url || '?Token=x&keep=1&EXPIRES=5' AS u FROM pages), q AS (SELECT page_id, u, split_part(u, '?', 1) AS head, list_filter(string_split(substr(u, strpos(u, '?') + 1), '&'), lambda p: lower(split_part(p, '=', 1)) NOT IN ('token', 'expires', 'token_path')) AS kept FROM u) SELECT page_id, 'see \"' || head || '?' || CASE WHEN len(kept) > 0 THEN array_to_string(kept, '&') ELSE '…' END || '\" or http://a.b/c?…' AS url FROM q")
def redacted_urls(s, d):
    return table(s, d, "pages").select("page_id", redacted_url(F.concat(F.lit('see "'), "url", F.lit('?Token=x&keep=1&EXPIRES=5" or http://a.b/c?token_path=%2F'))).alias("url"))
