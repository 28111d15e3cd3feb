"""Queries of the weekly report on the driver's tables, with SQL for comparison; `queries` takes them in.

Events are those of the players; their views are quiz answers too, their purchases checkpoints, their sign-ups
assessments of retention. Resources are the parts that events name, courses the parity of a resource or question; every
customer is a member beside the students of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as X
from .functions import epoch, filled, rounded_exactly
from .operators import weekly
from .registry import query
from .sources import table

FIRST, ZONE = "2024-01-22", "Africa/Cairo"


def _week():
    return weekly.Week(FIRST, ZONE)


def _facts(s, d):
    return X.events(s, d).withColumnRenamed("resource_id", "resource")


def _tables(s, d):
    """members, resources, events, quiz, checkpoints, assignments, chats, retention."""
    facts = _facts(s, d)
    raw = table(s, d, "events").select("event_id", F.col("user_id").alias("student_id"), "event_type", "value", epoch(F.col("ts")).alias("at"), (F.get_json_object("props", "$.k").cast("bigint") % X.RESOURCES).alias("resource"), F.concat_ws(":", "user_id", F.col("ts").cast("date").cast("string")).alias("session_id"))
    named = facts.select("resource").distinct()
    resources = table(s, d, "part").join(named, F.col("p_partkey") == F.col("resource"), "left_semi").select((F.col("p_partkey") % 2).alias("course_id"), F.col("p_partkey").alias("resource"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice")).alias("duration"))
    members = facts.select("student_id", (F.col("resource") % 2).alias("course_id")).union(table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") % 2).cast("bigint"))).distinct()
    question = F.col("event_id") % X.QUESTIONS
    quiz = raw.filter("event_type = 'view'").select("student_id", (question % 2).alias("course_id"), F.when(question % 3 > 0, F.col("resource")).alias("resource"), question.alias("question_id"), F.when(question % 6 > 0, (question % 6).cast("string")).alias("topic"), (F.col("value") > 50).alias("is_correct"), "at", (question % 4).cast("string").alias("difficulty"))
    v = F.col("value")
    checkpoints = raw.filter("event_type = 'purchase'").select(
        "student_id", (F.col("resource") % 2).alias("course_id"), "resource", "session_id", F.col("event_id").alias("attempt_id"), (F.col("event_id") % 5).cast("string").alias("topic"), v.alias("place"), F.col("at").alias("shown_at"), F.when(v > 20, F.col("at") + v).alias("answered_at"),
        F.when(v > 20, v / 10).alias("response_s"), (F.col("event_id") % 3 * 10).alias("allowed_s"), (v > 40).alias("is_correct"), (v < 5).alias("skipped"), v.between(5, 20).alias("timed_out"), (F.col("event_id") % 2 + 1).alias("attempt_number"),
    )
    week = _week()
    assignments = resources.select("course_id", "resource", week.first.alias("week_start"), week.since.alias("available"), (week.since + (F.col("resource") + 1) * 86400.0).alias("due"), "duration", F.lit(True).alias("required"))
    chats = table(s, d, "conversations").filter("role = 'user'").select((F.col("conv_id") % 150).alias("student_id"), (F.col("conv_id") % 2).alias("course_id"), (F.col("conv_id") % 5).cast("string").alias("topic"), F.col("text").alias("content"), (F.col("turn") % 4 == 0).alias("grounded"), (week.since + F.col("conv_id") % 8 * 86400 + F.col("turn") * 60).alias("at"))
    kept = raw.filter("event_type = 'signup'").select("student_id", (F.col("resource") % 2).alias("course_id"), (F.col("event_id") % 4).cast("string").alias("topic"), "at", (F.col("value") > 30).alias("is_correct"))
    return members, resources, facts, quiz, checkpoints, assignments, chats, kept


_SINCE = "epoch_us(timezone('Africa/Cairo', TIMESTAMP '2024-01-22')) / 1e6"
# half-even on the exact value of the double
_R = "CAST(printf('%.1f', {}) AS DOUBLE)"


def _rate(part, whole):
    return f"CASE WHEN {whole} > 0 THEN CAST(printf('%.1f', 100.0::DOUBLE * ({part}) / ({whole})) AS DOUBLE) END"


# events of the six weeks, sittings cut at the edges of the weeks
_RP = X.EV.replace("ev AS (", "e0 AS (", 1) + f""",
 wk AS (SELECT {_SINCE} AS since),
 e1 AS (SELECT e0.*, CASE WHEN tm < since + 604800 THEN CASE WHEN tm >= since THEN 0 ELSE CAST(ceil((since - tm) / 604800) AS INT) END END AS back FROM e0, wk),
 ev AS (SELECT * REPLACE (session_id || '#' || back AS session_id) FROM e1 WHERE back <= 5)""" + X.RP[len(X.EV) :]
_BASE = _RP + f""",
 mem AS (SELECT DISTINCT user_id AS student_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % {X.RESOURCES} % 2 AS course_id FROM events UNION SELECT c_custkey, c_nationkey % 2 FROM customer),
 res AS (SELECT p_partkey AS resource_id, p_partkey % 2 AS course_id, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS duration FROM part WHERE p_partkey IN (SELECT resource_id FROM e0)),
 sit AS (SELECT student_id, resource_id, back, session_id, round_even(sum(elapsed), 1) AS watch, round_even(sum(away), 1) AS away, round_even(max(tm) - min(tm), 1) AS session FROM rp GROUP BY 1, 2, 3, 4),
 dy AS (SELECT student_id, resource_id % 2 AS course_id, back, count(DISTINCT CAST(timezone('Africa/Cairo', timezone('UTC', make_timestamp(CAST(round(tm * 1000000) AS BIGINT)))) AS DATE)) AS active_days FROM rp GROUP BY 1, 2, 3),
 c1 AS (SELECT student_id, resource_id, back, "start", "end", max("end") OVER (PARTITION BY student_id, resource_id, back ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rp WHERE "end" > "start"),
 c2 AS (SELECT *, sum(CASE WHEN "start" <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY student_id, resource_id, back ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM c1),
 c3 AS (SELECT student_id, resource_id, back, min("start") AS s, max("end") AS e FROM c2 GROUP BY student_id, resource_id, back, island),
 cov AS (SELECT student_id, resource_id, back, round_even(sum(e - s), 1) AS covered FROM c3 GROUP BY 1, 2, 3),
 ln AS (SELECT student_id, resource_id, back, count(*) AS sessions, sum(watch) AS watch, sum(away) AS away, sum(session) AS session FROM sit GROUP BY 1, 2, 3),
 li AS (SELECT ln.*, course_id, duration, coalesce(covered, 0) AS covered FROM ln JOIN res USING (resource_id) LEFT JOIN cov USING (student_id, resource_id, back)),
 qz AS (SELECT event_id % {X.QUESTIONS} AS question_id, user_id AS student_id, event_id % {X.QUESTIONS} % 2 AS course_id, value > 50 AS ok, epoch_us(ts) / 1e6 AS tm FROM events WHERE event_type = 'view'),
 qb AS (SELECT *, CASE WHEN tm < since + 604800 THEN CASE WHEN tm >= since THEN 0 ELSE CAST(ceil((since - tm) / 604800) AS INT) END END AS back FROM qz, wk SEMI JOIN mem ON mem.student_id = qz.student_id AND mem.course_id = qz.course_id),
 qs AS (SELECT student_id, course_id, back, count(*) AS questions, {_rate('count(*) FILTER (WHERE k)', 'count(*)')} AS quiz FROM (SELECT student_id, course_id, back, question_id, bool_or(ok) AS k FROM qb GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 cp AS (SELECT user_id AS student_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % {X.RESOURCES} AS resource_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % {X.RESOURCES} % 2 AS course_id, event_id, event_id % 5 AS topic, value AS v, epoch_us(ts) / 1e6 AS tm FROM events WHERE event_type = 'purchase'),
 cb AS (SELECT *, CASE WHEN tm < since + 604800 THEN CASE WHEN tm >= since THEN 0 ELSE CAST(ceil((since - tm) / 604800) AS INT) END END AS back FROM cp, wk),
 cs AS (SELECT student_id, course_id, back, count(*) AS shown, count(*) FILTER (WHERE v > 20) AS answered, {_rate('count(*) FILTER (WHERE v > 40)', 'count(*) FILTER (WHERE v > 20)')} AS checks, {_R.format('(median(v / 10) FILTER (WHERE v > 20))')} AS median_response, {_rate('count(*) FILTER (WHERE v < 5)', 'count(*)')} AS skip_rate FROM cb GROUP BY 1, 2, 3),
 mt AS (SELECT course_id, sum(duration) AS material FROM res WHERE duration > 0 GROUP BY 1),
 sn AS (SELECT student_id, course_id, back, sum(least(covered, duration)) FILTER (WHERE duration > 0) AS seen, CAST(sum(sessions) AS BIGINT) AS sessions FROM li GROUP BY 1, 2, 3),
 gr AS (SELECT student_id, course_id, CAST(back AS INT) AS back FROM mem, range(6) b(back)),
 m0 AS (SELECT gr.*, coalesce(active_days, 0) AS active_days, coalesce(sessions, 0) AS sessions, {_rate('coalesce(seen, 0)', 'material')} AS coverage, quiz AS quiz_accuracy, checks AS checkpoint_accuracy, coalesce(questions, 0) AS quiz_questions, coalesce(answered, 0) AS checkpoints_answered
  FROM gr LEFT JOIN mt USING (course_id) LEFT JOIN sn USING (student_id, course_id, back) LEFT JOIN dy USING (student_id, course_id, back) LEFT JOIN qs USING (student_id, course_id, back) LEFT JOIN cs USING (student_id, course_id, back)),
 ms AS (SELECT *, CASE WHEN quiz_accuracy IS NOT NULL OR checkpoint_accuracy IS NOT NULL THEN CAST(printf('%.1f', (coalesce(quiz_accuracy * 0.6e0, 0) + coalesce(checkpoint_accuracy * 0.35e0, 0) + coalesce(coverage * 0.05e0, 0)) / (CASE WHEN quiz_accuracy IS NULL THEN 0e0 ELSE 0.6e0 END + CASE WHEN checkpoint_accuracy IS NULL THEN 0e0 ELSE 0.35e0 END + CASE WHEN coverage IS NULL THEN 0e0 ELSE 0.05e0 END)) AS DOUBLE) END AS mastery FROM m0)"""


@query(f"WITH {_BASE} SELECT student_id, course_id, back, active_days, sessions, coverage, quiz_accuracy, checkpoint_accuracy, quiz_questions, checkpoints_answered, mastery FROM ms")
def weekly_metrics(s, d):
    members, resources, facts, quiz, checkpoints, *_ = _tables(s, d)
    week = _week()
    lines = weekly.week_lines(week, members, resources, facts, X.GAP)
    quiz, checkpoints = (t.join(members, weekly.KEYS, "left_semi") for t in (quiz, checkpoints))
    return weekly.week_metrics(week, members, resources, lines, quiz, checkpoints)


@query(f"""WITH {_BASE},
 t0 AS (SELECT student_id, course_id, max(coverage) FILTER (WHERE back = 0) AS c0, max(coverage) FILTER (WHERE back = 1) AS c1, {_R.format('median(coverage) FILTER (WHERE back >= 2)')} AS cm, max(active_days) FILTER (WHERE back = 0) AS a0, max(active_days) FILTER (WHERE back = 1) AS a1, {_R.format('median(active_days) FILTER (WHERE back >= 2)')} AS am, max(mastery) FILTER (WHERE back = 0) AS m0, max(mastery) FILTER (WHERE back = 1) AS m1, {_R.format('median(mastery) FILTER (WHERE back >= 2)')} AS mm FROM ms GROUP BY 1, 2)
 SELECT student_id, course_id, c1 AS coverage_before, c0 AS coverage_now, {_R.format('c0 - c1')} AS coverage_delta, cm AS coverage_baseline, a0 - a1 AS active_days_delta, am AS active_days_baseline, m0 AS mastery_now, {_R.format('m0 - m1')} AS mastery_delta, mm AS mastery_baseline FROM t0""")
def weekly_trends(s, d):
    x = weekly.trends(weekly_metrics(s, d))
    return x.select(*weekly.KEYS, F.col("trend.coverage.previous").alias("coverage_before"), F.col("trend.coverage.current").alias("coverage_now"), F.col("trend.coverage.delta").alias("coverage_delta"), F.col("baseline.coverage").alias("coverage_baseline"), F.col("trend.active_days.delta").alias("active_days_delta"), F.col("baseline.active_days").alias("active_days_baseline"), F.col("trend.mastery.current").alias("mastery_now"), F.col("trend.mastery.delta").alias("mastery_delta"), F.col("baseline.mastery").alias("mastery_baseline"))


@query(f"""WITH {_BASE},
 l0 AS (SELECT student_id, resource_id, back, s, e, lag(e, 1, 0) OVER (PARTITION BY student_id, resource_id, back ORDER BY s) AS p FROM c3),
 gp AS (SELECT student_id, resource_id, back, s - p AS len FROM l0 WHERE s - p >= 30 UNION ALL SELECT li.student_id, li.resource_id, li.back, duration - coalesce(m, 0) FROM li LEFT JOIN (SELECT student_id, resource_id, back, max(e) AS m FROM c3 GROUP BY 1, 2, 3) x ON x.student_id = li.student_id AND x.resource_id = li.resource_id AND x.back = li.back WHERE duration - coalesce(m, 0) >= 30),
 sk AS (SELECT student_id, resource_id, back, count(*) AS n, sum(len) AS len FROM gp GROUP BY 1, 2, 3),
 ed AS (SELECT student_id, resource_id, back, place, sum(change) AS change FROM (SELECT student_id, resource_id, back, "start" AS place, 1 AS change FROM c1 UNION ALL SELECT student_id, resource_id, back, "end", -1 FROM c1) GROUP BY 1, 2, 3, 4),
 dp AS (SELECT *, sum(change) OVER w AS depth, lead(place) OVER w AS nxt FROM ed WINDOW w AS (PARTITION BY student_id, resource_id, back ORDER BY place)),
 di AS (SELECT *, sum(CASE WHEN depth < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY student_id, resource_id, back ORDER BY place) AS g FROM dp),
 dd AS (SELECT student_id, resource_id, back, min(place) AS s, max(nxt) AS e FROM di WHERE depth >= 2 AND nxt IS NOT NULL GROUP BY student_id, resource_id, back, g HAVING max(nxt) - min(place) >= 30),
 rw AS (SELECT student_id, resource_id, back, sum(e - s) AS len FROM dd GROUP BY 1, 2, 3)
 SELECT student_id, course_id, resource_id AS resource, back, sessions, round(watch, 1) AS watch, round(covered, 0) AS covered, CASE WHEN duration > 0 THEN coalesce(n, 0) ELSE 0 END AS skipped, CASE WHEN duration > 0 THEN round(coalesce(sk.len, 0), 1) ELSE 0 END AS skipped_s, round(coalesce(rw.len, 0), 0) AS rewatched_s
 FROM li LEFT JOIN sk USING (student_id, resource_id, back) LEFT JOIN rw USING (student_id, resource_id, back)""")
def weekly_lines(s, d):
    members, resources, facts, *_ = _tables(s, d)
    x = weekly.week_lines(_week(), members, resources, facts, X.GAP).withColumn("_s", weekly.skipped(F.col("duration")))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v["end"] - v["start"])
    return x.select("student_id", "course_id", F.col("resource_id").alias("resource"), "back", "sessions", F.round("watch", 1).alias("watch"), F.round("covered", 0).alias("covered"), F.size("_s").alias("skipped"), F.round(add(F.col("_s")), 1).alias("skipped_s"), F.round(add(F.col("rewatched")), 0).alias("rewatched_s"))


def _reports(s, d):
    return weekly.weekly_reports(_week(), *_tables(s, d), max_gap=X.GAP)


@query(f"""WITH {_BASE},
 t0 AS (SELECT mem.student_id, mem.course_id, count(*) AS registered, count(li.student_id) AS opened, count(*) FILTER (WHERE coalesce(res.duration, 0) = 0) AS without_length, {_R.format('coalesce(sum(watch), 0)')} AS watch, {_R.format('coalesce(sum(away), 0)')} AS away, {_rate('coalesce(sum(least(coalesce(covered, 0), res.duration)) FILTER (WHERE res.duration > 0), 0)', 'sum(res.duration)')} AS coverage
  FROM mem JOIN res USING (course_id) LEFT JOIN (SELECT * FROM li WHERE back = 0) li ON li.student_id = mem.student_id AND li.resource_id = res.resource_id GROUP BY 1, 2),
 cq AS (SELECT user_id AS student_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % {X.RESOURCES} % 2 AS course_id, event_id % 4 AS topic, value > 30 AS ok, CAST(ts AS DATE) AS day FROM events, wk WHERE event_type = 'signup' AND epoch_us(ts) / 1e6 < since + 604800),
 ce AS (SELECT *, day - min(day) OVER (PARTITION BY student_id, course_id, topic) AS k FROM cq),
 rt AS (SELECT student_id, course_id, {_rate('count(*) FILTER (WHERE k = 0 AND ok)', 'count(*) FILTER (WHERE k = 0)')} AS immediate, {_rate('count(*) FILTER (WHERE k >= 3 AND ok)', 'count(*) FILTER (WHERE k >= 3)')} AS delayed, count(*) FILTER (WHERE k >= 3) AS delayed_items FROM ce GROUP BY 1, 2),
 rc AS (SELECT mem.student_id, mem.course_id, res.resource_id, res.duration AS d, CASE WHEN res.duration > 0 THEN round_even(100.0 * least(coalesce(covered, 0), res.duration) / res.duration, 1) END AS c FROM mem JOIN res USING (course_id) LEFT JOIN (SELECT * FROM li WHERE back = 0) li ON li.student_id = mem.student_id AND li.resource_id = res.resource_id),
 pg AS (SELECT student_id, course_id, {_R.format('100 * sum(coalesce(d, 1)) / sum(coalesce(d, 1))')} AS expected, {_R.format('100 * sum(coalesce(c, 0) / 100 * coalesce(d, 1)) / sum(coalesce(d, 1))')} AS actual, count(*) AS assigned FROM rc GROUP BY 1, 2),
 ct AS (SELECT conv_id % 150 AS student_id, conv_id % 2 AS course_id, count(*) AS questions, count(*) FILTER (WHERE turn % 4 = 0) AS grounded FROM conversations WHERE role = 'user' AND conv_id % 8 * 86400 + turn * 60 < 604800 GROUP BY 1, 2)
 SELECT t0.student_id, t0.course_id, registered, opened, without_length, watch, away, t0.coverage, active_days, quiz_accuracy AS accuracy, quiz_questions AS questions, coalesce(shown, 0) AS shown, coalesce(answered, 0) AS answered, checks AS checkpoint_accuracy, median_response, skip_rate, mastery,
  CASE WHEN mastery IS NULL THEN 'LOW' WHEN quiz_questions + coalesce(answered, 0) >= 8 AND quiz_questions > 0 AND coalesce(answered, 0) > 0 THEN 'HIGH' WHEN quiz_questions + coalesce(answered, 0) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  immediate, delayed, {_R.format('delayed - immediate')} AS retention_change, coalesce(delayed_items, 0) AS delayed_items, expected, actual, {_R.format('actual - expected')} AS gap, assigned, coalesce(ct.questions, 0) AS chat_questions, coalesce(grounded, 0) AS grounded, CASE WHEN actual - expected < -5 THEN 'catch_up' ELSE 'other' END AS first_action
 FROM t0 JOIN ms ON ms.student_id = t0.student_id AND ms.course_id = t0.course_id AND ms.back = 0 LEFT JOIN cs ON cs.student_id = t0.student_id AND cs.course_id = t0.course_id AND cs.back = 0
 LEFT JOIN rt ON rt.student_id = t0.student_id AND rt.course_id = t0.course_id LEFT JOIN pg ON pg.student_id = t0.student_id AND pg.course_id = t0.course_id LEFT JOIN ct ON ct.student_id = t0.student_id AND ct.course_id = t0.course_id""")
def weekly_report(s, d):
    c = F.col
    first = F.get("actions", F.lit(0))["action"]
    return _reports(s, d).select(
        *weekly.KEYS, "totals.registered", "totals.opened", "totals.without_length", "totals.watch", "totals.away", "totals.coverage", "totals.active_days", "totals.accuracy", "totals.questions", "checkpoints.shown", "checkpoints.answered", c("checkpoints.accuracy").alias("checkpoint_accuracy"), "checkpoints.median_response", "checkpoints.skip_rate",
        c("mastery.overall.score").alias("mastery"), c("mastery.overall.confidence").alias("confidence"), "retention.immediate", "retention.delayed", c("retention.change").alias("retention_change"), "retention.delayed_items", "progress.expected", "progress.actual", "progress.gap", "progress.assigned", c("chat.questions").alias("chat_questions"), "chat.grounded", F.when(first == "catch_up", first).otherwise("other").alias("first_action"),
    )


@query("SELECT l_orderkey, l_linenumber, round_even(l_discount * 100 * 2.5, 1) AS one, round_even(l_quantity / 8, 2) AS two FROM lineitem")
def exact_rounding(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", rounded_exactly(F.col("l_discount") * 100 * 2.5).alias("one"), rounded_exactly(F.col("l_quantity") / 8, 2).alias("two"))


@query("SELECT p_partkey, replace(replace('{name}: size {size} of {brand} {missing}', '{name}', p_name), '{size}', p_size::VARCHAR) AS sentence FROM part")
def filled_templates(s, d):
    x = table(s, d, "part")
    values = F.create_map(F.lit("name"), "p_name", F.lit("size"), F.col("p_size").cast("string"))
    return x.select("p_partkey", filled(F.lit("{name}: size {size} of {brand} {missing}"), values).alias("sentence"))
