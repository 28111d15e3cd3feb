from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, root bigint"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def kept_by_brute_force(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        groups[find(i)].append(d)
    return sorted(min(g) for g in groups.values())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    found = []
    for i in range(150):
        text = list(rng.choice(words, int(rng.integers(100, 600))))
        found.append((len(found), " ".join(text), "en", 1))
        for _ in range(int(rng.integers(0, 4))):
            # copies of copies, of similarity 0.6 to 1
            text = list(text)
            for _ in range(int(rng.integers(1, max(2, len(text) // 22)))):
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
            found.append((len(found), " ".join(text).upper(), "en", None))
    line = " ".join(words[:40])
    found += [(len(found) + i, line + " " + " ".join(rng.choice(words, 60)), None, None) for i in range(60)]
    found += [(len(found), None, None, None), (len(found) + 1, " \t", None, None), (len(found) + 2, "a b", None, None), (len(found) + 3, "A  b", None, None), (len(found) + 4, "b a", None, None)]
    return found


def test_stage_equals_brute_force_jaccard(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = simhash.keep_one(docs)
    want = kept_by_brute_force(rows)
    assert len(rows) - len(want) > 60
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_rows_without_ids_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(8)]
    near = lambda t: t + " end"
    rows = [(None, t, "x", None) for t in texts[:4]]
    # copies of a row with an id, and of one another; an id with unrelated texts; equal rows
    rows += [(5, texts[4], None, None), (None, near(texts[4]), None, None), (None, near(texts[0]), None, None)]
    rows += [(6, texts[5], None, None), (6, texts[6], None, None), (7, near(texts[6]), None, None), (3, near(texts[5]), None, None), (8, texts[7], None, 1), (8, texts[7], None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert len(kept) == 8
    first = [x for x in kept if x[1] in (texts[0], near(texts[0]))]
    assert len(first) == 1 and first[0][0] is None
    want = [(None, t) for t in texts[1:4]] + [(5, texts[4]), (6, texts[6]), (3, near(texts[5])), (8, texts[7])]
    assert sorted((x for x in kept if x not in first), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [1, 7, 400])
def test_blocks_of_a_cell_lose_no_link(spark, block):
    import numpy as np

    from lectern.llm import near_dedup

    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 40, 40)
    sets = []
    for _ in range(60):
        kept = base[rng.random(40) < 0.92]
        sets.append(sorted({int(x) for x in np.concatenate([kept, rng.integers(0, 1 << 40, int(rng.integers(0, 5)))])}))
    alike = lambda x, y: 5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y))
    cells = [(c, i, i) for c in (1, 2) for i in range(60) if c == 1 or i % 2]
    left = spark.createDataFrame([(c, i, r, 0, 0, 0, 0) for c, i, r in cells], "cell bigint, row_key bigint, root bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    stored = spark.createDataFrame(list(enumerate(sets)), "row_key bigint, shingles array<bigint>")

    def parts(links):
        label = list(range(60))

        def find(i):
            while label[i] != i:
                i = label[i]
            return i

        for a, b in links:
            label[find(a)] = find(b)
        return [find(i) == find(j) for i in range(60) for j in range(60)]

    got = near_dedup.crossed(left, stored, block).collect()
    want = [(i, j) for i in range(60) for j in range(i) if alike(sets[i], sets[j])]
    assert parts((r.a, r.b) for r in got) == parts(want) and want


def test_overlaps():
    import numpy as np

    from lectern.llm import near_dedup

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, int(n))) for n in rng.integers(1, 50, 30)]
    assert near_dedup.overlaps(sets, 7).tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]


def test_fingerprints_are_the_simhash_of_the_set():
    from lectern.llm import near_dedup

    rng = np.random.default_rng(2)
    runs = [rng.integers(0, 1 << 63, int(n)).astype(np.uint64) for n in (1, 2, 9, 254, 255, 256, 700)]
    # repeats count once
    runs.append(np.concatenate([runs[2], runs[2][:5]]))
    got = near_dedup.fingerprints(np.concatenate(runs), np.cumsum([0, *map(len, runs)]))
    for run, own in zip(runs, got):
        own_set = np.unique(run)
        for k in range(near_dedup.WIDE):
            x = near_dedup.mix(own_set ^ near_dedup._SALT[k])
            assert int(own[k]) == sum(1 << b for b in range(64) if 2 * int(((x >> np.uint64(b)) & np.uint64(1)).sum()) > len(own_set))
    assert (got[2] == got[-1]).all()


def test_pivots_discard_no_close_pair():
    from lectern.llm import near_dedup

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (12, 2)).astype(np.uint64)
    sketch = base[rng.integers(0, 12, 400)]
    for _ in range(30):
        sketch[np.arange(400), rng.integers(0, 2, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    cell, root = np.sort(rng.integers(0, 9, 400)), rng.integers(0, 30, 400)
    want = [any(cell[i] == cell[j] and root[i] != root[j] and int(np.bitwise_count(sketch[i] ^ sketch[j]).sum()) <= near_dedup.FAR for j in range(400)) for i in range(400)]
    assert near_dedup.meeting(cell, root, sketch).tolist() == want and 0 < sum(want) < 400


@pytest.mark.parametrize("crowd", [3, 4096])
def test_candidates_of_simhash_lose_no_link(spark, rows, crowd):
    from lectern.llm import near_dedup

    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = near_dedup.similar_groups(docs, crowd).groupBy("root").agg({"ord": "min"}).collect()
    assert sorted(r[1] for r in got) == kept_by_brute_force(rows)


def test_a_set_goes_only_where_its_pair_is_first_met(spark, monkeypatch):
    from lectern.llm import near_dedup

    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(60):
        # pairs of similarity 0.87, pairs of 0.74, and pairs of 0.39 whose sketches are often close
        text = list(rng.choice(words, 300))
        tail = list(rng.choice(words, (20, 45, 130)[i % 3]))
        rows += [(2 * i, " ".join(text), None, None), (2 * i + 1, " ".join(text[: -len(tail)] + tail), None, None)]
    found, saved = {}, near_dedup.saved

    def watched(df, name, *more, **named):
        out = saved(df, name, *more, **named)
        found[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "saved", watched)
    got = near_dedup.similar_groups(spark.createDataFrame(rows, SCHEMA)).groupBy("root").agg({"ord": "min"}).collect()
    assert sorted(r[1] for r in got) == kept_by_brute_force(rows)
    # the pairs of 0.87 were linked before, those of 0.74 come once each
    assert len(got) == 100 and found["close"] == 40


def test_first_table_of_a_pair():
    from lectern.llm import near_dedup

    rng = np.random.default_rng(6)
    places = near_dedup.tables(300)
    x = rng.integers(0, 1 << 63, (50, near_dedup.WIDE)).astype(np.uint64)
    y = x.copy()
    for i in range(50):
        for bit in rng.permutation(64 * near_dedup.WIDE)[: 12 * i]:
            y[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    unlike = np.unpackbits((x ^ y).view(np.uint8), axis=1, bitorder="little")
    want = [next((t for t, p in enumerate(places) if not unlike[i, p].any()), len(places)) for i in range(50)]
    assert near_dedup._first_table(x, y, places).tolist() == want and want[0] == 0 and 0 < max(want)
