import math
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import decontaminate as D
from lectern.llm.textops import PUNCTUATION, slices

WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "And"] * 60


def words(t):
    return [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(8)
    make = lambda n: rng.choice(WORDS, n).tolist()
    items = [(i, " ".join(make(n)[:-6]) + ". " + " ".join(make(6)) + ".") for i, n in enumerate([12, 20, 30, 45, 64, 90, 150])]
    items += [(20, items[0][1]), (21, None), (22, " ... "), (None, " ".join(make(25)))]
    docs = []
    for i in range(120):
        w = make(int(rng.integers(0, 400)))
        if i % 3 == 0:
            own = (items[i % 7][1]).split()
            if i % 2:  # a paraphrase: some words of it are others
                for k in rng.integers(0, len(own), max(1, len(own) // 8)):
                    own[k] = "changed"
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = own
        docs.append((i, " ".join(w), "x"))
    docs += [(200, None, None), (201, "", None), (202, items[3][1].upper().replace(" ", " - "), "x"), (202, items[3][1], "x"), (None, items[1][1], None), (203, "word " * 9000 + items[2][1], None)]
    return docs, items


def brute(docs, items):
    """(doc_id, item_id) by TF-IDF cosines of all windows and passages and plain subsequences."""
    pieces = [[words(t)[i : i + 32] for i in range(0, max(1, len(words(t))), 32)] for _, t, *_ in docs]
    n = sum(map(len, pieces))
    df = Counter(w for p in pieces for x in p for w in set(x))
    idf = lambda w: max(math.log((1 + n) / (1 + df[w])), 1e-3)
    known = {w for _, t in items for w in words(t)}

    def share(a, b):
        row = [0.0] * (len(b) + 1)
        for x in a:
            fresh = row[:]
            for j, y in enumerate(b):
                fresh[j + 1] = max(fresh[j], row[j + 1], row[j] + idf(x) if x == y else 0)
            row = fresh
        return row[-1] / sum(map(idf, a))

    out, pairs = set(), set()
    for (d, t, *_), ps in zip(docs, pieces):
        body = words(t)
        for k in range(max(1, len(ps) - 1)):
            window = Counter(w for x in ps[k : k + 2] for w in x if w in known)
            norm = math.sqrt(sum((c * idf(w)) ** 2 for w, c in window.items()))
            for item, text in items:
                own = words(text)
                if not own or not norm:
                    continue
                last = [words(p) for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip())]
                last = [p for p in last if p]
                answer = last[-1][-64:] if len(last) > 1 else own[-max(1, min(64, len(own) // 3)) :]
                for s in sorted({min(s, max(0, len(own) - 64)) for s in range(0, len(own), 64)}):
                    p = own[s : s + 64]
                    q = Counter(p)
                    cos = sum(c * idf(w) * window[w] * idf(w) for w, c in q.items()) / norm / math.sqrt(sum((c * idf(w)) ** 2 for w, c in q.items()))
                    if cos < D.COSINE:
                        continue
                    pairs.add((d, t, 32 * k, item, s))
                    at = 32 * k
                    x = share(p, body[max(0, at - len(p)) : at + 64 + len(p)])
                    far = body[max(0, at - s - 64) : max(0, at - s + len(own) + 128)]
                    if x >= D.STRONG or x >= D.WEAK and share(answer, far) >= D.STRONG:
                        out.add((d, item))
    return out, pairs


def frames(spark, tables):
    docs, items = tables
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string")


def test_against_brute_force(spark, tables):
    docs, items = frames(spark, tables)
    want, pairs = brute(*tables)
    ((m,),) = D.matchers(docs, items)
    assert m.basis.shape[1] == len(m.items) // 2  # fewer directions than passages: cosines are not those of the words
    found = set()
    import pyarrow as pa

    for d, t, *_ in tables[0]:
        for _, _, w in slices(pa.array([t]), gaps=PUNCTUATION):
            for _, begin, k, _ in zip(*m.candidates(w, w.hashes(lower=True))):
                found.add((d, t, int(begin), m.items[k].item_id, m.items[k].place))
    assert len(found & pairs) >= 0.99 * len(pairs) and len(pairs) > 50
    got = D.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 40
    kept = D.decontaminate(docs, items)
    leaked = {d for d, _ in want}
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, *_ in tables[0] if d not in leaked)


def test_several_blocks_find_the_same(spark, tables):
    docs, items = frames(spark, tables)
    want, _ = brute(*tables)
    for size, together in ((5, 1), (5, 3), (3, 2)):
        assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items, size, together).collect()} == want
    kept = D.decontaminate(docs, items, 5, 2)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, *_ in tables[0] if d not in {d for d, _ in want})


def test_empty_tables(spark, tables):
    docs, items = frames(spark, tables)
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_repeated_and_empty_items_make_one_block(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards mix jars of potent quartz brew"
    rows = [(1, item)] * 600 + [(2, None), (3, ""), (None, " \t")]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"before {item} after", "x"), (2, "nothing of the kind is said in this one", "y"), (3, None, None)], "doc_id bigint, text string, item_id string")
    from lectern.llm import decontaminate

    groups = list(decontaminate.matchers(docs, benchmark))
    assert [len(m.items) for g in groups for m in g] == [1]
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()] == [(1, 1)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, benchmark).collect()) == [2, 3]
