import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lectern.llm import exact_dedup, simhash, textops, token_count

SCHEMA = "doc_id bigint, text string, lang string, key string, fp bigint"
WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    found = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 90))), "en", "k", 7) for i in range(60)]
    for i in range(60, 100):
        words = found[i % 20][1].split()
        words[rng.integers(len(words))] = "changed"
        found.append((i, " ".join(words), None, None, None))
    found += [(100, None, None, None, None), (101, "", "x", None, None), (102, " \t\n", None, None, None), (103, "a  b\x0bc", None, None, None), (104, "a b c", None, None, None), (104, "a b c", None, None, None)]
    found += [(None, "a b c", None, None, None), (None, "alone", None, None, None), (105, "É" + "x" * 5000 + " y" * 5000, None, None, None)]
    return found


def test_words_and_windows():
    import pyarrow as pa

    column = pa.array(["  a bb\tc ", None, "", "a bb c a bb c", "x\xa0y \x85z"])
    ((_, _, w),) = list(textops.slices(column))
    assert [bytes(w.buf[i:j]).decode() for i, j in zip(w.start, w.end)] == "a bb c a bb c a bb c".split() + ["x\xa0y", "\x85z"]
    assert w.first.tolist() == [0, 3, 3, 3, 9, 11]
    at, h = w.windows(w.hashes(), 3)
    assert at.tolist() == [0, 3, 4, 5, 6] and h[0] == h[1] == h[4] and len(set(h.tolist())) == 3
    assert (w.hashes(lower=True) == w.hashes()).all()


def test_exact_dedup(spark, rows):
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), capacity=8).collect()
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {sha(t): (min((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and len({r.text_sha256 for r in kept}) == len(groups)
    assert len({r.bucket for r in got}) > 8 and {r.link for r in got} == {0}
    assert {r.doc_id for r in exact_dedup.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()} == {r.doc_id for r in kept}


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    buckets = exact_dedup.directory(keys, 80)
    assert sum(2.0**-d for d, _ in buckets) == 1
    sizes = exact_dedup.dealt(keys, buckets).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 80 and sum(r["count"] for r in sizes) == 5000
    assert len(buckets) > 64 and max(d for d, _ in buckets) > min(d for d, _ in buckets)
    # split in several counts, and left overfull at the deepest level
    hard = spark.range(300).selectExpr("id AS key").unionByName(keys)
    split = exact_dedup.directory(hard, 100, 13)
    assert sum(2.0**-d for d, _ in split) == 1 and (13, 0) in split
    assert exact_dedup.dealt(hard, split).groupBy("bucket").count().agg({"count": "max"}).first()[0] == 300


def test_collisions_are_chained_by_bytes(spark):
    import pyarrow as pa

    rows = [(0, 5, "a", 9, 1), (0, 5, "b", 3, 2), (0, 5, "a", 7, 1), (0, 6, "a", 1, 1), (1, 9, "", 2, 4)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["bucket", "key", "body", "ord", "n"]) for part in (rows[:2], rows[2:])]
    got = [tuple(r.values()) for b in exact_dedup._chained(iter(batches)) for r in b.to_pylist()]
    assert got == [(0, 5, 0, "a", 7, 2), (0, 5, 1, "b", 3, 2), (0, 6, 0, "a", 1, 1), (1, 9, 0, "", 2, 4)]


def test_what_a_task_holds_changes_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sets = [sorted(map(str, exact_dedup.exact_dedup(df, held=h).drop("bucket", "link").collect())) for h in (0, 1 << 20)]
    assert sets[0] == sets[1]


def test_columns_of_clashing_names_stay(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "_ORD", "key": "_sha", "fp": "_nth"})
    got = exact_dedup.keep_first(df)
    assert got.columns == df.columns and got.count() == exact_dedup.exact_dedup(df).filter("kept").count()
    near = simhash.keep_one(df)
    assert near.columns == df.columns and near.count() <= got.count()


def test_token_counts_equal_the_library(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_count.default_path())
    odd = ["", "  a  b <|endoftext|> c\n d", " x", "x ", "a<|endoftext|>b", "it's  'll we've\n\nyes   no\x1c d", "a　 b", "12 34  5\t6", "né 日本語 \U0001f600 \U0001f600!", "a " + "longword" * 40 + " b " + "longword" * 40 + " c"]
    texts = [t for _, t, *_ in rows] + odd
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r for r in token_count.token_counts(df, batch_bytes=700, limit=20).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 20)


def brute_components(rows, radius):
    prints = []
    for _, t, *_ in rows:
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        least[find(i)].append(d)
    return prints, [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("radius", [3, 6])
def test_simhash(spark, rows, radius):
    prints, roots = brute_components(rows, radius)
    got = simhash.near_groups(spark.createDataFrame(rows, SCHEMA), radius=radius).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((d, f"{p:016x}", c) for (d, *_), p, c in zip(rows, prints, roots)), key=str)


def test_crowded_cells_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in rng.integers(0, 64, 2):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")

    def parts(links):
        label = {x: x for x in fps}
        find = lambda x: x if label[x] == x else find(label[x])
        for a, b in links:
            label[find(a)] = find(b)
        groups = defaultdict(set)
        for x in fps:
            groups[find(x)].add(x)
        return {frozenset(g) for g in groups.values()}

    want = parts((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3)
    for crowd in (4096, 5):
        got = simhash.fingerprint_links(df, crowd=crowd).collect()
        assert parts((r.a % (1 << 64), r.b % (1 << 64)) for r in got) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == token_count.token_counts(empty).count() == simhash.near_groups(empty).count() == 0
