"""Mixing, source divergence and importance resampling against brute force in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import divergence, importance, mixing
from lectern.llm.running import running

SCHEMA = "doc_id bigint, text string, lang string, source string, size bigint, target double, hash string, row int, rank int, n int, term string, `_part` int"
WORDS = "the of and To in a is that FOR it é naïve Über x1 42 don't 東京 straße".split()
EXTRA = (7, 1.5, "h", 3, 4, 5, "t", 6)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{rng.integers(6)}"
        out.append((i, " ".join(rng.choice(WORDS, rng.integers(0, 60))), ["en", "de", None][i % 3 if i % 7 else 2], source))
    out += [(500, None, "en", None), (501, "", None, None), (502, " \t\n\x0b", "xx", "empty"), (None, "no id here", "en", "s1"), (None, "another without an id", "en", None)]
    out += [(503, "same row again", "en", "s2")] * 9 + [(503, "same id other text and longer", "en", "s2")] * 3
    out.append((504, ("long " * 3000 + "Z" * 700_000 + " ") * 2, "en", "big"))
    return out


def brute_targets(sizes):
    """Rounds of sharing, in fractions."""
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: [5, 2, 1][i % 3] for i, n in enumerate(names)}
    budget, fixed = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        left = budget - sum(fixed.values())
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 2 * sizes[n]]
        if not over:
            return {n: float(fixed.get(n, share.get(n))) for n in names}
        fixed |= {n: Fraction(2 * sizes[n]) for n in over}


def test_mixing(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, _, s in rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    target = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2, s
    again = mixing.mix(frame(spark, rows[::-1]).repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)


def test_mixing_of_equal_rows_and_few_sources(spark):
    # a third of all rows are one row: its copies are told apart, so the source still comes near its target
    rows = [(1, "a b c d", "en", "x")] * 3000 + [(i, "w " * (i % 9), "en", "yz"[i % 2]) for i in range(10, 6000)]
    got = mixing.mix(frame(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 4.5 for s in target)
    plain = mixing.thresholds.__globals__["BROADCAST_ROWS"]
    try:
        mixing.thresholds.__globals__["BROADCAST_ROWS"] = 0
        joined = mixing.mix(frame(spark, rows)).collect()
    finally:
        mixing.thresholds.__globals__["BROADCAST_ROWS"] = plain
    assert Counter(tuple(r) for r in joined) == Counter(tuple(r) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", "a", "b"), (2, "", "a", "c")]])
def test_mixing_without_words(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all((r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0) for r in got)


def test_mixing_is_native(spark, rows):
    plan = mixing.mix(frame(spark, rows[:50]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


def test_running_totals(spark):
    x = spark.createDataFrame([(i * 7 % 100, i) for i in range(1000)], "k int, v int")
    got = running(x, [F.col("k"), F.col("v")], {"upto": F.col("v"), "nth": F.lit(1)}, parts=7).orderBy("nth").collect()
    want, total = sorted((r.k, r.v) for r in got), 0
    for n, (r, (k, v)) in enumerate(zip(got, want, strict=True), 1):
        total += v
        assert (r.k, r.v, r.nth, r.upto) == (k, v, n, total)
    assert running(x.limit(0), [F.col("k")], {"nth": F.lit(1)}).count() == 0


def test_xxh64_and_groups():
    rng = np.random.default_rng(2)
    for n in range(32):
        rows = rng.integers(0, 256, (50, n), dtype=np.uint8)
        assert divergence.xxh64(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]
    texts = [b"a", b"bb", b"a", b"", b"x" * 40, b"bb", b"x" * 40, b"x" * 41, b"c"]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    end = np.cumsum([len(t) for t in texts])
    group, words = divergence.grouped(buf, end - [len(t) for t in texts], end)
    assert [words[g] for g in group] == texts and len(set(words)) == len(words)


def test_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence, "xxh64", lambda rows: np.zeros(len(rows), dtype=np.uint64))
    texts = [b"ab", b"cd", b"ab", b"ef", b"cd"]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    group, words = divergence.grouped(buf, np.arange(5) * 2, np.arange(5) * 2 + 2)
    assert [words[g] for g in group] == texts and len(set(words)) == 3


def brute_audit(rows, least, top=50):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text)))
        groups[lang].add(source)
        docs[lang].update(found.keys())
        n[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= least)
        v = len(kept)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * v) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", words, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("least", [2, 30, 10_000])
def test_audit(spark, rows, least, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_ROWS", 20)
    monkeypatch.setattr(divergence, "PIECE_WORDS", 40)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 1000)
    got = divergence.audit(frame(spark, rows), least).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(tuple(r) for r in got) == brute_audit(rows, least)


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    assert divergence.audit(frame(spark, [(1, None, None, None)])).collect() == []
    got = divergence.audit(frame(spark, [(1, None, None, "a"), (2, "1 2", "", None)])).collect()
    assert sorted((r.source, r.item, r.value, r["rank"]) for r in got) == [("", "a", 0, 1), ("a", "", 0, 1)]


def test_shares_are_exact():
    rng = np.random.default_rng(4)
    n = rng.integers(0, 10**13, 500)
    total = n + rng.integers(1, 10**15, 500)
    v = rng.integers(1, 10**9, 500)
    assert divergence.share(n, total, v).tolist() == [1 + 10**9 * (a + 5) // (b + 5 * c) for a, b, c in zip(n.tolist(), total.tolist(), v.tolist(), strict=True)]


def test_long_texts_count_one_document():
    text = " ".join(["alpha beta"] * 200_000 + ["omega"])
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "source": ["a", "a"], "text": [text, "alpha"]})
    got = Counter()
    for b in divergence._tallied(iter([batch])):
        for r in b.to_pylist():
            got[r["term"], "n"] += r["n"]
            got[r["term"], "docs"] += r["docs"]
    assert got == {("alpha", "n"): 200_001, ("alpha", "docs"): 2, ("beta", "n"): 200_000, ("beta", "docs"): 1, ("omega", "n"): 1, ("omega", "docs"): 1}


def test_crc32():
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [0, 1, 2, 3, 47, 48, 49, 200, 5, 5, 9]]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    end = np.cumsum([len(t) for t in texts])
    assert importance.crc32(buf, end - [len(t) for t in texts], end).tolist() == [zlib.crc32(t) for t in texts]


def runs(text, lowest, highest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(words[i : i + k]) for k in range(lowest, highest + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, buckets=10_000, lowest=1, highest=1, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, runs(r[1], lowest, highest)))
    for x in target:
        t.update(map(bucket, runs(x, lowest, highest)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text, *_ in rows:
        found = runs(text, lowest, highest)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= sum(max(0, least - k + 1) for k in range(lowest, highest + 1))), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for n, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = n + 1
    return Counter(tuple(r) for r in out)


@pytest.mark.parametrize(("lowest", "highest", "percent"), [(1, 1, 10), (1, 3, 50), (1, 1, 100), (1, 1, 0)])
def test_resampling(spark, rows, lowest, highest, percent):
    target = ["The naïve of 42", None, "", "Über to " * 30]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resample(frame(spark, rows), goal, percent=percent, lowest=lowest, highest=highest).collect()
    assert Counter(tuple(r) for r in got) == brute_resample(rows, target, lowest=lowest, highest=highest, percent=percent)


def test_resampling_of_nothing(spark):
    goal = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), goal).collect() == []
    (r,) = importance.resample(frame(spark, [(None, None, None, None)]), goal).collect()
    assert (r.doc_id, r.n_features, r.weight, r["rank"]) == (None, 0, 0, None)


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_ROWS", 40)
    rows = [(i, "a b c", "en", "s") for i in range(1000)]
    blocks = importance.matrix(frame(spark, rows).repartition(2)).collect()
    assert sum(len(b.doc_id) for b in blocks) == 1000 and max(len(b.doc_id) for b in blocks) < 40 + 64
    assert all(len(b.pointer) == len(b.doc_id) + 1 and b.pointer[-1] == len(b.bucket) == len(b.n) for b in blocks)
