"""Queries of the exam report's sections on the driver's tables, with SQL for comparison; `queries` takes them in.

Exams, sittings and responses are those of `queries_reports`; every question has four options, of which a response picks the
one of its supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import exam_report, quantiles, reports
from .queries_reports import XM, _exam, _pc
from .registry import query
from .sources import table
from .stored import stored


def _sections(s, d):
    cohort, sittings, responses, questions = _exam(s, d)
    responses = responses.withColumn("selected", F.array("option_id"))
    questions = questions.withColumn("place", F.col("question_id") + 1)
    listed = questions.select("exam_id", "question_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("option_id")).withColumns({"is_key": F.col("option_id") == F.col("question_id") % 4, "place": (F.col("option_id") + 1).cast("int")})
    return cohort, sittings, responses, questions, listed


def _scores(cohort, sittings, responses, questions):
    """exam_id, student_id and score, stored: what rests on scores alone needs nothing by topic."""
    finals = reports.exam_finals(cohort, responses, questions)
    return stored(reports.exam_scores(cohort, sittings, finals, questions).select(*exam_report.KEY, "score"), "scores")


_FX = (
    XM
    + f""",
 fx AS (SELECT exam_id, student_id, question_id, bool_or(ok) FILTER (WHERE up = 1) AS first_ok, bool_or(ok) FILTER (WHERE down = 1) AS final_ok, max(response_s) FILTER (WHERE up = 1) AS first_s, max(response_s) FILTER (WHERE down = 1) AS final_s, max(option_id) FILTER (WHERE down = 1) AS opt, count(*) AS tries, bool_or(missed) FILTER (WHERE down = 1) AS skipped FROM rk GROUP BY 1, 2, 3),
 zn AS (SELECT exam_id, count(*) AS n FROM qs GROUP BY 1),
 gc AS (SELECT exam_id, student_id, count(*) FILTER (WHERE final_ok) AS correct FROM fx GROUP BY 1, 2),
 sg AS (SELECT exam_id, student_id, bool_or(st = 'F') AS completed, arg_max(p, {{'a': st IN ('F', 'O'), 'b': sitting_id}}) AS p FROM si SEMI JOIN co USING (exam_id, student_id) GROUP BY 1, 2),
 sc AS (SELECT sg.exam_id, sg.student_id, completed, CASE WHEN correct IS NOT NULL THEN {_pc('correct', 'n')} ELSE {_pc('p', '600000')} END AS score FROM sg JOIN zn USING (exam_id) LEFT JOIN gc USING (exam_id, student_id)),
 lv AS (SELECT exam_id, student_id, score, CASE WHEN score > m THEN 'high' WHEN score < m THEN 'low' ELSE 'middle' END AS level FROM sc JOIN (SELECT exam_id, median(score) AS m FROM sc GROUP BY 1) USING (exam_id) WHERE score IS NOT NULL)"""
)
_OPT = (
    _FX
    + f""",
 hs AS (SELECT exam_id, count(*) FILTER (WHERE level = 'high') AS hn, count(*) FILTER (WHERE level = 'low') AS ln FROM lv GROUP BY 1),
 an AS (SELECT exam_id, question_id, count(final_ok) AS answers FROM fx GROUP BY 1, 2),
 pk AS (SELECT exam_id, question_id, opt AS option_id, count(*) AS picks, count(*) FILTER (WHERE level = 'high') AS h, count(*) FILTER (WHERE level = 'low') AS l FROM fx LEFT JOIN lv USING (exam_id, student_id) WHERE final_ok IS NOT NULL GROUP BY 1, 2, 3),
 op AS (SELECT exam_id, question_id, o AS option_id, coalesce(picks, 0) AS picks, {_pc('coalesce(picks, 0)', 'answers')} AS percent, {_pc('coalesce(h, 0)', 'hn')} AS high_percent, {_pc('coalesce(l, 0)', 'ln')} AS low_percent, hn, ln FROM qs CROSS JOIN range(4) r(o) JOIN an USING (exam_id, question_id) JOIN hs USING (exam_id) LEFT JOIN pk ON pk.exam_id = qs.exam_id AND pk.question_id = qs.question_id AND pk.option_id = r.o),
 oc AS (SELECT *, CASE WHEN option_id = question_id % 4 THEN 'correct' WHEN hn >= 5 AND ln >= 5 AND high_percent - low_percent >= 20 THEN 'suspicious' WHEN coalesce(percent, 0) >= 25 THEN 'strong_misconception' WHEN coalesce(percent, 0) < 5 THEN 'non_functioning' ELSE 'functioning' END AS class FROM op)"""
)
_STAT = "count(v) AS n, round_even(avg(v), 1) AS mean, round_even(quantile_cont(v, 0.25), 1) AS p25, round_even(quantile_cont(v, 0.5), 1) AS median, round_even(quantile_cont(v, 0.75), 1) AS p75"
_LONG = (
    _FX
    + """,
 lg AS (SELECT exam_id, 'response' AS kind, '' AS item, response_s AS v FROM rk UNION ALL SELECT exam_id, 'duration', '', p FROM si SEMI JOIN co USING (exam_id, student_id) WHERE st = 'F'
  UNION ALL SELECT exam_id, 'final', question_id::VARCHAR, final_s FROM fx WHERE final_ok IS NOT NULL UNION ALL SELECT exam_id, CASE WHEN final_ok THEN 'correct' ELSE 'incorrect' END, question_id::VARCHAR, final_s FROM fx WHERE final_ok IS NOT NULL
  UNION ALL SELECT exam_id, 'first', question_id::VARCHAR, first_s FROM fx WHERE first_ok IS NOT NULL UNION ALL SELECT exam_id, 'topic', (question_id % 6)::VARCHAR, final_s FROM fx WHERE final_ok IS NOT NULL)"""
)


@query(f"WITH {_FX} SELECT exam_id, student_id, level FROM lv")
def exam_median_split(s, d):
    cohort, sittings, responses, questions, _ = _sections(s, d)
    return exam_report.levels(_scores(cohort, sittings, responses, questions))


@query(f"WITH {_FX}, b AS (SELECT exam_id, least(CAST(floor(score / 20) AS INT), 4) AS b, count(*) AS n FROM sc WHERE score IS NOT NULL GROUP BY 1, 2) SELECT zn.exam_id, CAST(r.b * 20 AS BIGINT) AS low, CAST(r.b * 20 + 20 AS BIGINT) AS high, coalesce(b.n, 0) AS students FROM zn, range(5) r(b) LEFT JOIN b ON b.exam_id = zn.exam_id AND b.b = r.b")
def exam_score_distribution(s, d):
    cohort, sittings, responses, questions, _ = _sections(s, d)
    return exam_report.score_distribution(_scores(cohort, sittings, responses, questions))


@query(f"WITH {_LONG} SELECT exam_id, kind, item, n, round(mean, 0) AS mean, round(p25, 0) AS p25, round(median, 0) AS median, round(p75, 0) AS p75 FROM (SELECT exam_id, kind, item, {_STAT} FROM lg GROUP BY 1, 2, 3)")
def exam_times(s, d):
    cohort, sittings, responses, questions, _ = _sections(s, d)
    x = exam_report.times(exam_report.answers(responses, cohort, questions), responses, cohort, sittings, questions)
    return x.withColumns({c: F.round(c, 0) for c in ("mean", "p25", "median", "p75")})


@query(f"WITH {_OPT} SELECT exam_id, question_id, option_id, picks, percent, high_percent, low_percent, class FROM oc")
def exam_options(s, d):
    return exam_report.exam_reports(*_sections(s, d)).options.drop("place", "is_key")


_PRIORITY = (
    _OPT
    + f""",
 rs0 AS (SELECT *, sum(coalesce(CAST(final_ok AS INT), 0)) OVER (PARTITION BY exam_id, student_id) - coalesce(CAST(final_ok AS INT), 0) AS rest FROM fx),
 it AS (SELECT exam_id, question_id, count(*) AS shown, count(final_ok) AS answered, CAST(sum(tries) AS BIGINT) AS attempts, {_pc('count(*) FILTER (WHERE final_ok)', 'count(final_ok)')} AS accuracy, {_pc('count(*) FILTER (WHERE first_ok)', 'count(first_ok)')} AS first_accuracy, {_pc('count(*) FILTER (WHERE tries > 1)', 'count(*)')} AS retry_rate, {_pc('count(*) FILTER (WHERE skipped)', 'count(*)')} AS skip_rate, round_even(median(final_s) FILTER (WHERE final_ok IS NOT NULL), 1) AS median_response, round(corr(CAST(final_ok AS INT), rest) FILTER (WHERE final_ok IS NOT NULL), 3) AS r FROM rs0 GROUP BY 1, 2),
 ex AS (SELECT exam_id, round_even(quantile_cont(response_s, 0.75), 1) AS p75 FROM rk GROUP BY 1),
 od AS (SELECT exam_id, question_id, bool_or(class = 'strong_misconception') AS m, bool_or(class = 'suspicious') AS s FROM oc GROUP BY 1, 2),
 dq AS (SELECT *, CASE WHEN answered < 10 THEN 'insufficient_data' WHEN r IS NULL OR isnan(r) THEN 'insufficient_variance' WHEN r < 0 THEN 'negative' WHEN r >= 0.2 THEN 'good' ELSE 'weak' END AS discrimination FROM it),
 pr AS (SELECT *, least(coalesce((100 - accuracy) * 0.35, 0) + CASE discrimination WHEN 'negative' THEN 25 WHEN 'weak' THEN 12 ELSE 0 END + CASE WHEN m THEN 15 ELSE 0 END + CASE WHEN s THEN 10 ELSE 0 END + coalesce(retry_rate * 0.15, 0) + coalesce(skip_rate * 0.15, 0) + CASE WHEN median_response > p75 THEN 10 ELSE 0 END, 100) AS priority FROM dq JOIN od USING (exam_id, question_id) JOIN ex USING (exam_id))"""
)


@query(f"WITH {_PRIORITY} SELECT exam_id, question_id, shown, answered, attempts, accuracy, first_accuracy, CASE WHEN accuracy >= 80 THEN 'easy' WHEN accuracy >= 50 THEN 'moderate' WHEN accuracy IS NOT NULL THEN 'difficult' END AS difficulty, discrimination, median_response, round(CAST(printf('%.1f', priority) AS DOUBLE), 0) AS priority, CASE WHEN CAST(printf('%.1f', priority) AS DOUBLE) >= 50 THEN 'HIGH' WHEN CAST(printf('%.1f', priority) AS DOUBLE) >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS category FROM pr")
def exam_priorities(s, d):
    x = exam_report.exam_reports(*_sections(s, d)).questions
    return x.select("exam_id", "question_id", "shown", "answered", "attempts", "accuracy", "first_accuracy", "difficulty", "discrimination", "median_response", F.round("priority", 0).alias("priority"), "category")


@query(f"""WITH {_PRIORITY}, tr AS (SELECT exam_id, (question_id % 6)::VARCHAR AS topic, {_pc('count(*) FILTER (WHERE final_ok)', 'count(final_ok)')} AS accuracy, sum(tries) AS attempts, count(DISTINCT question_id) AS questions FROM fx GROUP BY 1, 2),
 ta AS (SELECT exam_id, arg_min(topic, {{'a': accuracy, 'b': topic}}) AS topic FROM tr WHERE questions >= 2 AND attempts >= 10 AND accuracy < 60 GROUP BY 1),
 tp AS (SELECT exam_id, arg_max(question_id + 1, {{'a': CAST(printf('%.1f', priority) AS DOUBLE), 'b': -question_id}}) AS place, max(CAST(printf('%.1f', priority) AS DOUBLE)) AS top FROM pr GROUP BY 1),
 ab AS (SELECT exam_id, count(*) FILTER (WHERE NOT completed) AS missing FROM sg GROUP BY 1),
 al AS (SELECT exam_id, 0 AS s, 'review_question' AS action, place::VARCHAR AS subject FROM tp WHERE top >= 50 UNION ALL SELECT exam_id, 1, 'reteach_topic', topic FROM ta UNION ALL SELECT exam_id, 3, 'contact_incomplete', NULL FROM ab WHERE missing > 0)
 SELECT exam_id, action, subject FROM al""")
def exam_actions(s, d):
    return exam_report.exam_reports(*_sections(s, d)).actions.filter("action NOT IN ('follow_up_students', 'keep_sequence')").select("exam_id", "action", "subject")


@query("SELECT l_returnflag AS kind, l_linestatus AS status, count(*) AS n, round(avg(l_extendedprice), 0) AS mean, round(quantile_cont(l_extendedprice, 0.25), 0) AS p25, round(quantile_cont(l_extendedprice, 0.5), 0) AS median, round(quantile_cont(l_extendedprice, 0.9), 0) AS p90 FROM lineitem GROUP BY 1, 2")
def distributed_quantiles(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("value"))
    x = quantiles.quantiles(rows, ["kind", "status"], [0.25, 0.5, 0.9])
    return x.select("kind", "status", "n", F.round("mean", 0).alias("mean"), *[F.round(F.col("quantiles")[i], 0).alias(c) for i, c in enumerate(("p25", "median", "p90"))])
