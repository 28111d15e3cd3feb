import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import lm, toxicity


@pytest.mark.parametrize("most,owner_bytes,flush", [(lm.TABLE, lm.OWNER_BYTES, lm.packed.FLUSH), (40, 500, 900)])
def test_lm_scores(spark, most, owner_bytes, flush):
    rng = np.random.default_rng(2)
    chain = {f"a{i}": [f"a{(3 * i + k) % 60}" for k in range(3)] for i in range(60)}
    rows = []
    for i in range(400):
        w = ["a1"]
        for _ in range(int(rng.integers(1, 80))):
            w.append(rng.choice(chain[w[-1]]))
        rows.append((i, " ".join(w).upper() if i % 2 else "\n".join(w), "x"))
    rows += [(500, None, None), (501, "", None), (502, "never seen words", None), (502, "never seen words", None), (None, "a1 a2", None), (600, "a1 a3 a9 " * 60_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(3)
    got = lm.score(df, most=most, owner_bytes=owner_bytes, flush=flush).collect()
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tokens = lambda t: (t or "").lower().split() + ["</end>"]
    counts = Counter(x for d, t, _ in rows if not out(d) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = {(d, len(tokens(t))): sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)) for d, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == out(r.doc_id) and r.train_tokens == n
        assert r.base_score == pytest.approx(base[r.doc_id, r.n_tokens], rel=1e-9)
    known = {d: sum(x in counts for x in tokens(t)) for d, t, _ in rows}
    assert all(r.n_known == known[r.doc_id] for r in got)
    held = [r for r in got if r.held_out and r.doc_id != 600]
    # the chain is learnt: log10(3) a token is the best there is, unigrams take log10(60)
    best = sum(math.log10(3) * r.n_tokens for r in held)
    if most == lm.TABLE:
        assert -sum(r.score for r in held) < 1.25 * best < -0.6 * sum(r.base_score for r in held)
    else:
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score(df.limit(0)).count() == 0
    untrained = lm.score(df.filter("doc_id = 502"))
    assert {(r.n_known, r.train_tokens) for r in untrained.collect()} <= {(0, 0), (4, 8)}


def test_lm_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    features = [rng.integers(0, k, 4000) for k in (3, 2, 2)]
    shares = rng.dirichlet(np.ones(3)), np.concatenate([rng.dirichlet(np.ones(lm.SIDE)) for _ in range(3)])
    place = rng.integers(0, 3 * lm.SIDE, 4000)
    # held-out occurrences of every place after one context of all three features
    ask = [np.full(3 * lm.SIDE, f[0]) for f in features]
    logp = lm.learnt([np.concatenate([f, a]) for f, a in zip(features, ask)], np.concatenate([place, np.arange(3 * lm.SIDE)]), np.concatenate([np.ones(4000), np.zeros(3 * lm.SIDE)]), shares)
    assert (10.0 ** logp[4000:]).sum() == pytest.approx(1, rel=1e-6)


def test_lm_weights_are_at_the_penalised_maximum():
    rng = np.random.default_rng(7)
    seen = rng.integers(0, 30, 12).astype(float)
    start, group = np.array([0, 5]), np.repeat([0, 1], [5, 7])
    prior = np.concatenate([rng.dirichlet(np.ones(6))[:5], rng.dirichlet(np.ones(8))[:7]])

    def value(w):
        p = lm.normalised(prior, w, start, group)
        return float((seen * np.log(p)).sum() - lm.PULL / 2 * (w * w).sum())

    w = lm.fitted(prior, seen, start, group, rounds=60)
    assert all(value(w) >= value(w + rng.normal(0, 1e-2, 12) * (seen > 0)) - 1e-9 for _ in range(200))
    assert (w[seen == 0] == 0).all() and value(lm.fitted(prior, seen, start, group)) > value(np.zeros(12))


def test_gradients_of_the_network():
    net = toxicity.Network.fresh(3)
    rng = np.random.default_rng(0)
    for k in ("word", "char"):
        net.weights[k] = rng.normal(0, 0.3, net.weights[k].shape).astype(np.float32)
    x = toxicity.windowed(toxicity._words(["some words here", "other toxic wörds and more", ""]))
    y, weight = np.array([0.0, 1.0, 0.0], np.float32), np.array([1.0, 2.0, 1.0], np.float32)

    def loss():
        z = net.logits(x).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / 3)

    taken = {}
    net._step = lambda name, rows, g, rate: taken.__setitem__(name, (rows, g))
    net.train(x, y, weight, 0.1)
    for name in ("Wf", "Ub", "bf", "a", "o", "word"):
        rows, g = taken[name]
        w = net.weights[name]
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        place = (rows[at[0]], *at[1:]) if not isinstance(rows, slice) else at
        old = w[place]
        w[place] = old + 1e-2
        up = loss()
        w[place] = old - 1e-2
        down = loss()
        w[place] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.05, abs=1e-4), name


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    plain = [f"p{i}ain" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        w = rng.choice(plain, int(rng.integers(1, 200))).tolist()
        bad = i % 5 == 0
        for _ in range(4 * bad):
            w.insert(int(rng.integers(0, len(w) + 1)), str(rng.choice(["worthless", "Stupid", "idiotic", "hateful"])))
        rows.append((i, " ".join(w), "en", 0.5))
        if i % 4:
            labels.append((i, int(bad)))
    rows += [(900, None, None, None), (901, "", None, None), (902, "stupid " * 30_000, None, None), (0, rows[0][1], "de", None), (None, "fine", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double").repartition(3)
    lab = spark.createDataFrame(labels + [(1, None), (5, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(df, lab, toxicity.Plan(epochs=4)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.9
    assert {r.doc_id: r.predicted for r in got}[902] == 1
    kept = toxicity.drop_toxic(df, lab, toxicity.Plan(epochs=4))
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    assert all(r.score == 0.0 for r in toxicity.toxicity(df.limit(3), lab.limit(0)).collect())
    assert toxicity.toxicity(df.limit(0), lab).count() == 0
