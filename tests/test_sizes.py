"""What a task holds does not grow with the tables."""

import numpy as np
from pyspark.sql import functions as F

from lectern import fixtures as X
from lectern import queries
from lectern.operators import access, vectors

FOLDER = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(100)
    assert access.apart(rows, 5 * access.ROWS, "id").rdd.getNumPartitions() == 5
    assert access.apart(rows, 0, "id").rdd.getNumPartitions() == 1
    want = {q: sorted(map(str, queries.QUERIES[q](spark, FOLDER).collect())) for q in ("rubric_completeness", "accessible_union")}
    monkeypatch.setattr(access, "ROWS", 200)
    n = -(-X.responses(spark, FOLDER).count() // 200)
    assert n > 8 and X.responses(spark, FOLDER, access.apart).rdd.getNumPartitions() == n
    for q, found in want.items():
        assert sorted(map(str, queries.QUERIES[q](spark, FOLDER).collect())) == found


def test_questions_are_sent_once_for_a_bundle(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 8))
    v[300:330] = v[300]
    rows = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, video_id bigint, embedding array<double>")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 12)
    want = sorted((i, int(j), r + 1) for i in range(0, 900, 20) for r, j in enumerate(np.lexsort((np.arange(900), d[i]))[:5]))
    for size in (64 * 100, vectors.BUNDLE_BYTES):
        monkeypatch.setattr(vectors, "BUNDLE_BYTES", size)
        index = vectors.build(rows, block=20)
        bundles = vectors._bundles(index)
        planned = vectors._planned(index, asked, 5, asked.select("query_id", F.lit(None).cast("double").alias("reach")))
        # every cell is within reach: one row for each question and bundle, whatever the cells and blocks
        assert planned.count() == 45 * (int(bundles.last.max()) + 1) <= 45 * -(-900 // bundles.rows)
        assert sorted((r.query_id, r.vec_id, r["rank"]) for r in vectors.nearest(index, asked, 5).collect()) == want
