"""The exam report against the published scenario of twelve students, and its quantiles against brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import exam_report, quantiles, reports
from lectern.stored import stored

RESPONSE = "exam_id int, student_id int, question_id int, sitting_id int, attempt_number int, response_id int, is_correct boolean, answered boolean, response_s double, skipped boolean, timed_out boolean, selected array<int>"
T, N = True, False
PATTERNS = [(T, T, N, N), (T, T, N, N), (T, T, N, N), (T, T, N, N), (T, T, N, T), (T, T, T, T), (T, T, T, T), (T, N, T, T), (T, N, T, N), (N, N, T, None)]


def tables(spark):
    """Ten of twelve start, nine submit; four first take the wrong option of question 2; the last runs out of time on 4. A
    second exam has no sitting at all."""
    responses, n = [], 0
    for s, pattern in enumerate(PATTERNS):
        for q, final in enumerate(pattern):
            retry = q == 1 and s < 4
            tries = [(N, 8.0 + 4 * q), (T, 18.0)] if retry else [(final, 8.0 + 4 * q)]
            for k, (ok, seconds) in enumerate(tries):
                n += 1
                answered = ok is not None
                responses.append((1, s, q, s, k + 1, n, ok, answered, seconds if answered else None, False, not answered, [2 if ok else 1] if answered else None))
    sittings = [(1, s, s, 1, "submitted" if s < 9 else "in_progress", 120.0 * s, 120.0 * s + 600 + 60 * s if s < 9 else None, None, 4.0, float(sum(x is True for x in PATTERNS[s])) if s < 9 else None) for s in range(10)]
    questions = [(e, q, ["anatomy", "bones"][q // 2], q + 1) for e in (1, 2) for q in range(4)]
    options = [(e, q, o, o == 2, o) for e in (1, 2) for q in range(4) for o in (1, 2, 3)]
    make = spark.createDataFrame
    return (
        make([(e, s) for e in (1, 2) for s in range(12)], "exam_id int, student_id int"),
        make(sittings, "exam_id int, student_id int, sitting_id int, attempt_number int, status string, started_at double, submitted_at double, score double, max_score double, awarded_points double"),
        make(responses, RESPONSE),
        make(questions, "exam_id int, question_id int, topic string, place int"),
        make(options, "exam_id int, question_id int, option_id int, is_key boolean, place int"),
    )


@pytest.fixture(scope="module")
def report(spark):
    return exam_report.exam_reports(*tables(spark))


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_summary(report):
    found = by(report.summary, "exam_id")
    r = found[(1,)]
    assert (r.cohort, r.started, r.completed, r.participation, r.completion, r.abandonment, r.attempts) == (12, 10, 9, 83.3, 90.0, 10.0, 44)
    assert (r.first_accuracy, r.accuracy, r.gain) == (round(100 * 21 / 39, 1), round(100 * 25 / 39, 1), 10.3)
    assert (r.easy, r.moderate, r.difficult, r.hardest, r.easiest) == (1, 2, 1, 3, 0)
    assert tuple(r.duration) == (9, 840.0, 720.0, 840.0, 960.0)
    times = [8] * 10 + [12] * 10 + [18] * 4 + [16] * 10 + [20] * 9
    assert tuple(r.response) == (43, round(statistics.mean(times), 1), *(round(float(np.percentile(times, p)), 1) for p in (25, 50, 75)))
    empty = found[(2,)]
    assert (empty.cohort, empty.started, empty.participation, empty.completion, empty.accuracy, empty.hardest, empty.duration) == (12, 0, 0.0, None, None, None, None)


def test_scores_and_split(report):
    scores = {s: 100 * sum(x is True for x in p) / 4 for s, p in enumerate(PATTERNS)}
    roster = {k[1]: r for k, r in by(report.roster, "exam_id", "student_id").items() if k[0] == 1}
    assert {s: r.score for s, r in roster.items() if r.score is not None} == scores
    bins = [(r.low, r.high, r.students) for r in sorted(report.distribution.filter("exam_id = 1").collect(), key=lambda r: r.low)]
    assert bins == [(lo, lo + 20, sum(lo <= x < lo + 20 or x == 100 and lo == 80 for x in scores.values())) for lo in range(0, 100, 20)]
    split = {r.student_id: r.level for r in exam_report.levels(report.roster).collect()}
    m = statistics.median(scores.values())
    assert split == {s: "high" if x > m else "low" if x < m else "middle" for s, x in scores.items()}
    assert {r.support for r in roster.values()} >= {"STRONG_PERFORMANCE", "NEEDS_SUPPORT", "INCOMPLETE_OR_INSUFFICIENT"}
    assert max(len(r.weak_topics) for r in roster.values()) <= 2


def test_options(report):
    found = by(report.options.filter("exam_id = 1"), "question_id", "option_id")
    assert len(found) == 12
    for q in range(4):
        answered = [p[q] for p in PATTERNS if p[q] is not None]
        assert found[q, 2].picks == sum(answered) and found[q, 2]["class"] == "correct"
        assert found[q, 1].percent == round(100 * (len(answered) - sum(answered)) / len(answered), 1)
        assert (found[q, 3].picks, found[q, 3].percent, found[q, 3]["class"]) == (0, 0.0, "non_functioning")
    assert found[2, 1]["class"] == "strong_misconception"
    high = [s for s, p in enumerate(PATTERNS) if sum(x is True for x in p) > 2]
    assert found[0, 2].high_percent == 100.0 and found[1, 1].high_percent == round(100 * sum(PATTERNS[s][1] is False for s in high) / len(high), 1)
    assert all(r.percent is None and r["class"] in ("correct", "non_functioning") for r in report.options.filter("exam_id = 2").collect())


def test_questions(report):
    found = by(report.questions, "exam_id", "question_id")
    assert [found[1, q].answered for q in range(4)] == [10, 10, 10, 9] and [found[1, q].correct for q in range(4)] == [9, 7, 5, 4]
    q2 = found[1, 1]
    assert (q2.accuracy, q2.first_accuracy, q2.gain, q2.retry_rate, q2.attempts_per_student, q2.median_response, q2.first_median) == (70.0, 30.0, 40.0, 40.0, 1.4, 12.0, 12.0)
    assert (q2.correct_median, q2.incorrect_median) == (18.0, 12.0)
    assert found[1, 3].skip_rate == 10.0 and found[1, 3].discrimination == "insufficient_data" and found[1, 3].discrimination_value is None
    assert found[1, 2].discrimination == "negative" and found[1, 2].difficulty == "moderate"
    x = np.array([[bool(v) for v in p] for p in PATTERNS], dtype=float)
    rest = (x.sum(axis=1) - x[:, 2]) / 3
    assert found[1, 2].discrimination_value == pytest.approx(np.corrcoef(x[:, 2], rest)[0, 1], abs=6e-4)
    score = (100 - 50.0) * 0.35 + 25 + 15
    assert found[1, 2].priority == round(score, 1) and found[1, 2].category == "HIGH"
    assert found[1, 2].reasons == "negative discrimination; review recommended, 50.0% selected distractor 1"
    assert found[2, 0].shown == 0 and found[2, 0].accuracy is None and found[2, 0].priority == 0.0 and found[2, 0].category == "LOW"


def test_topics_clusters_actions(report):
    topics = by(report.topics, "exam_id", "topic")
    assert all(topics[1, t].questions == 2 and topics[1, t].conclusive for t in ("anatomy", "bones"))
    assert topics[1, "bones"].weak and not topics[1, "anatomy"].weak and topics[1, "bones"].place == 1 and topics[1, "bones"].median_response == 16.0
    assert not topics[2, "bones"].conclusive and topics[2, "bones"].median_response is None
    clusters = {r.topic: (r.questions, r.dominant, r.missed) for r in report.clusters.filter("exam_id = 1").collect()}
    assert clusters == {"anatomy": (2, 1, 1), "bones": (2, 2, 2)}
    acts = [(r.action, r.subject, r["count"]) for r in report.actions.filter("exam_id = 1").orderBy("position").collect()]
    need = sum(r.support == "NEEDS_SUPPORT" for r in report.roster.filter("exam_id = 1").collect())
    assert acts == [("review_question", "3", None), ("reteach_topic", "bones", None), ("follow_up_students", None, need), ("contact_incomplete", None, 1)]
    assert [r.action for r in report.actions.filter("exam_id = 2").collect()] == ["keep_sequence"]


def test_empty_tables(spark):
    empty = exam_report.exam_reports(*(x.limit(0) for x in tables(spark)))
    for name in ("summary", "distribution", "times", "options", "questions", "topics", "roster", "clusters", "actions"):
        assert getattr(empty, name).collect() == [], name


@pytest.mark.parametrize(("bins", "small"), [(4, 3), (16, 1), (512, 2048)])
def test_quantiles_against_numpy(spark, bins, small):
    rng = random.Random(bins)
    groups = {
        "one": [5.0], "two": [1.0, 2.0], "equal": [7.5] * 500, "ties": [float(rng.randint(0, 3)) for _ in range(400)],
        "plain": [rng.uniform(-5, 5) for _ in range(700)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-12, 12) for _ in range(500)], "near": [1e15 + i % 9 for i in range(300)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("plain", None), ("plain", float("nan")), ("gone", None)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.k: r for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, value double"), ["k"], probs, bins, small).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs) and got[k].mean == pytest.approx(statistics.fmean(vs), rel=1e-9, abs=1e-3)
        assert got[k].quantiles == pytest.approx(np.quantile(vs, probs).tolist(), rel=1e-9), k


def test_quantiles_hold_no_group(spark):
    # a group of 200,000 values is never one array: what is brought together is a bin of few
    rows = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 200_003).cast("double").alias("value"))
    (r,) = quantiles.quantiles(rows, ["k"], [0.5], bins=64, small=100).collect()
    values = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert r.quantiles == [(values[99_999] + values[100_000]) / 2]


def test_equal_values_are_counted_before_they_are_stored(spark, monkeypatch):
    sizes = {}

    def noted(df, name):
        out = stored(df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(quantiles, "stored", noted)
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") % 3).cast("double").alias("value"))
    assert sorted((r.k, r.n, r.mean, r.quantiles) for r in quantiles.quantiles(rows, ["k"], [0.5]).collect()) == [(0, 1500, 1.0, [1.0]), (1, 1500, 1.0, [1.0])]
    assert sizes["values"] == 6


def test_sections_share_one_table_of_answers(spark, monkeypatch):
    monkeypatch.setattr(reports, "final_answers", None)  # the responses are put in order by exam_report.answers alone
    cohort = spark.createDataFrame([(1, 1), (1, 2)], "exam_id int, student_id int")
    sittings = spark.createDataFrame([], "exam_id int, student_id int, sitting_id int, attempt_number int, status string, started_at double, submitted_at double, score double, max_score double, awarded_points double")
    shape = "exam_id int, student_id int, question_id int, sitting_id int, attempt_number int, response_id int, is_correct boolean, answered boolean, response_s double, skipped boolean, timed_out boolean, selected array<int>"
    responses = spark.createDataFrame([(1, 1, 1, 1, 1, 1, True, True, 3.0, False, False, [1]), (1, 1, 1, 1, 2, 2, False, True, 3.0, False, False, [1]), (1, 9, 1, 2, 1, 3, True, True, 3.0, False, False, [1])], shape)
    asked = spark.createDataFrame([(1, 1, "t", 1)], "exam_id int, question_id int, topic string, place int")
    listed = spark.createDataFrame([(1, 1, 1, True, 1)], "exam_id int, question_id int, option_id int, is_key boolean, place int")
    (r,) = exam_report.exam_reports(cohort, sittings, responses, asked, listed).summary.collect()
    assert (r.cohort, r.attempts, r.from_outsiders, r.accuracy) == (2, 2, 1, 0.0)
