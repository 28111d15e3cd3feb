import hashlib

import numpy as np
import pytest

from lectern.llm import packed, repeats, substring_dedup, suffix_dedup, textops

SCHEMA = "doc_id bigint, text string, row_key string, at string"


def brute(rows, length):
    first = {}
    words = {i: (t or "").encode().split() for i, (_, t, *_) in enumerate(rows)}
    rank = [(1 << 63) - 1 if d is None else d for d, *_ in rows]
    for i, w in words.items():
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, rank[i]), rank[i])
    out = []
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < rank[i]:
                gone.update(range(s, s + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((rows[i][0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{i}" for i in range(300)] + ["É\xa0x", "Ü"])
    make = lambda n: rng.choice(vocabulary, n).tolist()
    passages = [make(n) for n in (50, 51, 60, 74, 120, 49, 200)]
    found = []
    for i in range(150):
        words = make(rng.integers(0, 200))
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(len(passages))]
            a = rng.integers(0, 10)
            at = rng.integers(0, len(words) + 1)
            words[at:at] = p[a:]
        found.append((i, " ".join(words), None, "x"))
    found += [(200 + i, found[i][1], None, None) for i in range(6)] + [(3, found[3][1], "k", None), (None, found[4][1], None, None)]
    return [*found, (300, None, None, None), (301, "", None, None), (302, "ab " * 400, None, None), (303, " \n".join(["line one two"] * 90), None, None)]


def got_of(df):
    got = df.collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)


@pytest.mark.parametrize("owner_bytes,flush", [(packed.OWNER_BYTES, packed.FLUSH), (1 << 8, 300)])
def test_substring_against_brute_force(spark, rows, owner_bytes, flush):
    # the same plan, forced to very many owners and to flushes of a few texts
    got = got_of(substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), owner_bytes=owner_bytes, flush=flush))
    assert got == brute(rows, 50)
    assert sum(r[2] > 0 for r in got) > 40


def test_suffix_against_brute_force(spark, rows):
    assert got_of(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows, 50)


OPERATORS = pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup])


@OPERATORS
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@OPERATORS
def test_words_of_equal_hashes_are_told_apart(spark, operator):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    import pyarrow as pa

    ((_, _, w),) = list(textops.slices(pa.array([f"{one} {two}"])))
    assert len(set(w.hashes().tolist())) == 1 and one != two
    common = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*common, one]), None, None), (2, " ".join([*common, two]), None, None), (3, " ".join([*common, two]), None, None)]
    assert got_of(operator(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 50)


@OPERATORS
def test_long_texts_in_chunks(spark, operator, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: rng.choice([f"v{i}" for i in range(5000)], n).tolist()
    shared = word(300)
    long = word(150_000)
    for at in (10, 74_000, 149_000):
        long[at:at] = shared
    rows = [(1, " ".join(word(40) + shared), None, None), (2, " ".join(long), None, None), (3, " ".join(long[70_000:90_000]), None, None), (4, "x" * 1_500_000 + " " + " ".join(shared), None, None)]
    assert got_of(operator(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 50)


def test_chunks_hold_each_run_once():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(2000))
    seen = []
    for _, _, w, base in textops.chunks(pa.array(["short one", text, None, "z" * 3000]), 4, 500):
        for i in range(len(w.start) - 4):
            seen.append((base + i, bytes(w.buf[w.start[i] : w.end[i + 4]]).decode()))
    assert seen == [(i, " ".join(f"w{k}" for k in range(i, i + 5))) for i in range(1996)]


@pytest.mark.parametrize("remembered", [0, 3, 1 << 19])
def test_what_a_task_remembers_changes_nothing(spark, rows, remembered):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    hits = substring_dedup.anchors(df)
    got = {(r.ord, r.row_key): set(r.starts) for r in repeats.repeated(df, hits, remembered=remembered).collect()}
    assert got == {(r.ord, r.row_key): set(r.starts) for r in repeats.repeated(df, hits, remembered=50).collect()} and got


@OPERATORS
def test_many_equal_rows_make_no_longer_arrays(spark, operator, monkeypatch):
    rng = np.random.default_rng(6)
    words = " ".join(rng.choice([f"q{i}" for i in range(900)], 300))
    other = "start " + words
    longest = {}
    for copies in (5, 400):
        rows = [(1, words, None, None)] * copies + [(2, other, None, None)] * copies
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        hits = substring_dedup.anchors(df) if operator is substring_dedup.substring_dedup else suffix_dedup.matches(df)
        longest[copies] = max(len(r["at"]) for r in repeats.by_text(hits).collect())
        starts = repeats.repeated(df, hits).collect()
        assert [(r.ord, len(r.starts)) for r in starts] == [(2, 251)]
    # pairs of a place and what it has in common on the left, at most
    assert longest[400] <= longest[5] + 300
    assert got_of(operator(df)) == brute(rows, 50)
