"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters, digits and non-ASCII bytes, A-Z as a-z. Items of the benchmark are cut into passages of at most
WINDOW words (the last one ends with the item), dealt to blocks of at most SIZE passages. A block's features are its own
words; their inverse document frequencies come from counts over all documents, in pieces of STRIDE words. A randomised SVD
of the block's TF-IDF passages, whose products with the matrix are sums over Spark partitions, gives its leading directions:
half as many as passages, RANK at most. Every window of a document (two neighbouring pieces) and each passage is folded into
them, and a pair is a candidate whose cosine there, both lengths being those of the folded vectors, is LATENT or more. What
lies outside the leading directions doesn't count, so such cosines are larger than those of the words and find more.
Windows in which common words alone cannot reach a cosine of COSINE with any passage are passed over by a bound.

A candidate is checked by the longest common subsequence of the passage's words and those around the window, each word
weighing its inverse document frequency: a share of STRONG is a leak; a share of WEAK is one (a paraphrase) if the answer,
which is the item's last sentence or, of a single sentence, its last third, is there too with a share of STRONG.

Documents aren't shuffled: of what grows with the corpus, only counts of the benchmark's words are. TOGETHER blocks share
one counting and one search of the documents; their tables, which are broadcast, are bounded by TOGETHER * SIZE * WINDOW
words times RANK directions (128 MB). A larger benchmark takes more passes.

Null texts count as empty and are clean; items without words match nothing; items of equal texts are all reported; rows of
one doc_id are reported together; an empty table of documents or items gives no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, small_batches, texts
from .textops import PUNCTUATION, Words, mix, signed, slices, split

WINDOW, STRIDE = 64, 32
SIZE, RANK, TOGETHER = 512, 256, 4
LATENT, COSINE, STRONG, WEAK, COMMON = 0.5, 0.35, 0.8, 0.5, 1 / 64
SLICE = 1 << 18
_SENTENCES = re.compile(r"(?<=[.?!])\s+|\n+")


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return split(raw, np.array([0, len(raw)]), PUNCTUATION).hashes(lower=True) if len(raw) else np.empty(0, np.uint64)


def answer(text: str) -> np.ndarray:
    """Hashes of the words of the last sentence, or of the last third of a single one; at most the last WINDOW."""
    parts = [h for h in map(_hashes, _SENTENCES.split(text.strip())) if len(h)]
    if not parts:
        return np.empty(0, np.uint64)
    return parts[-1][-WINDOW:] if len(parts) > 1 else parts[0][-max(1, min(WINDOW, len(parts[0]) // 3)) :]


def passages(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, place (of the first word), total (words of the item), words and answer (hashes) of each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                h = _hashes(text)
                for s in sorted({min(s, max(0, len(h) - window)) for s in range(0, len(h), window)}):
                    rows.append((item, s, len(h), signed(h[s : s + window]).tolist(), signed(answer(text)).tolist()))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "place", "total", "words", "answer"])

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return items.mapInArrow(run, "item_id bigint, place int, total int, words array<bigint>, answer array<bigint>")


@dataclass
class Vocabulary:
    """A block's words: their hashes in order, weights, and which of them are common."""

    hashes: np.ndarray
    weight: np.ndarray
    common: np.ndarray

    def __post_init__(self) -> None:
        # a slot for the leading bits of a hash says where among the sorted hashes those bits begin
        self.bits = max(8, int(len(self.hashes) * 4).bit_length())
        self.slots = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h of known words, their numbers)."""
        if not len(self.hashes) or not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = self.slots[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        left, found = np.arange(len(h)), []
        while len(left):
            at = np.minimum(at, len(self.hashes) - 1)
            known = self.hashes[at]
            hit = known == h[left]
            found.append((left[hit], at[hit]))
            on = (known < h[left]) & (at + 1 < len(self.hashes))
            left, at = left[on], at[on] + 1
        place = np.concatenate([f[0] for f in found])
        order = np.argsort(place, kind="stable")
        return place[order], np.concatenate([f[1] for f in found])[order].astype(np.int64)


def pieces(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece of each word, first piece of each text and of none, word at which each piece begins): STRIDE words each."""
    sizes = np.diff(w.first)
    n = np.maximum(1, -(-sizes // STRIDE))
    first = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(first[:-1], sizes) + w.position() // STRIDE
    doc = np.repeat(np.arange(len(sizes)), n)
    begin = w.first[doc] + (np.arange(first[-1]) - first[doc]) * STRIDE
    return of, first, begin


def word_numbers(rows: list) -> np.ndarray:
    """The distinct words of passages, sorted."""
    flat = [np.array(r.words, dtype=np.int64) for r in rows] + [np.array(r.answer, dtype=np.int64) for r in rows]
    return np.unique(np.concatenate(flat).view(np.uint64)) if flat else np.empty(0, np.uint64)


def weighed(docs: DataFrame, hashes: np.ndarray) -> Vocabulary:
    """Weights log((1 + N) / (1 + n)) of words that n of the N pieces of all documents have."""
    bare = docs.sparkSession.sparkContext.broadcast(Vocabulary(hashes, np.ones(len(hashes)), np.zeros(len(hashes), bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bare.value
        n = np.zeros(len(own.hashes) + 1, dtype=np.int64)
        for b in batches:
            for _, _, w in slices(b.column("text"), SLICE, PUNCTUATION):
                of, first, _ = pieces(w)
                place, number = own.find(w.hashes(lower=True))
                key = np.sort(of[place] * len(own.hashes) + number)
                fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
                n[:-1] += np.bincount(key[fresh] % max(1, len(own.hashes)), minlength=len(own.hashes))
                n[-1] += first[-1]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["number", "n"])

    total = np.zeros(len(hashes) + 1)
    for r in texts(docs).select("text").mapInArrow(run, "number int, n bigint").groupBy("number").agg(F.sum("n").alias("n")).collect():
        total[r.number] = r.n
    share = (1 + total[:-1]) / (1 + total[-1])
    return Vocabulary(hashes, np.maximum(-np.log(share), 1e-3), share > COMMON)


def part_of(words: Vocabulary, hashes: np.ndarray) -> Vocabulary:
    """The words with the given hashes, all of them in `words`."""
    at = np.searchsorted(words.hashes, hashes)
    return Vocabulary(hashes, words.weight[at], words.common[at])


def basis(block: DataFrame, words: Vocabulary, rank: int, passes: int = 2, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (words, rank at most) of the unit TF-IDF rows of a block, by a randomised SVD: the
    product of the matrix with its transpose and some more directions than wanted is summed over partitions, and made
    orthogonal on the driver."""
    spark = block.sparkSession
    known, part = spark.sparkContext.broadcast(words), 512
    size = len(words.hashes)

    def product(directions: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(directions.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, own, to = np.zeros((size, directions.shape[1])), known.value, shared.value
            for b in batches:
                for x in b.column("words").to_pylist():
                    number, v = vector(own, np.array(x, dtype=np.int64).view(np.uint64))
                    out[number] += v[:, None] * (v @ to[number])
            for i in range(0, size, part):
                if out[i : i + part].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out[i : i + part].tobytes()], pa.binary())], names=["at", "sums"])

        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(np.frombuffer(x.as_buffer()) for b in batches for x in b.column("sums"))
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "sums"])

        z = np.zeros((size, directions.shape[1]))
        for r in block.select("words").mapInArrow(run, "at int, sums binary").groupBy("at").applyInArrow(add, "at int, sums binary").toLocalIterator():
            got = np.frombuffer(r.sums).reshape(-1, directions.shape[1])
            z[r["at"] : r["at"] + len(got)] = got
        shared.destroy()
        return z

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(rank + 16, size))))[0]
    for _ in range(passes):
        q = np.linalg.qr(product(q))[0]
    values, turn = np.linalg.eigh(q.T @ product(q))
    keep = values > 1e-9 * max(values.max(), 1e-30)
    return (q @ turn[:, keep][:, ::-1][:, :rank]).astype(np.float32)


def vector(words: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and unit-length TF-IDF values of a passage's words."""
    number, n = np.unique(words.find(h)[1], return_counts=True)
    v = n * words.weight[number]
    return number, (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def common_share(item: np.ndarray, gains: np.ndarray, text: np.ndarray) -> float:
    """The share of the item's words, weighed by gains, in the best common subsequence with text."""
    row = np.zeros(len(text) + 1)
    for x, g in zip(item, gains):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + g * (text == x)))
    return float(row[-1] / max(gains.sum(), 1e-12))


@dataclass
class Matcher:
    """All that a task needs to check texts against one block of passages."""

    words: Vocabulary
    basis: np.ndarray
    items: list
    cosine: float = LATENT
    plain: float = COSINE

    def __post_init__(self) -> None:
        self.latent = np.zeros((len(self.items), self.basis.shape[1]), np.float32)
        self.common = 0.0
        self.own, self.gain, self.reply, self.reply_gain = [], [], [], []
        for k, r in enumerate(self.items):
            number, v = vector(self.words, np.array(r.words, dtype=np.int64).view(np.uint64))
            folded = v @ self.basis[number]
            self.latent[k] = folded / max(np.linalg.norm(folded), 1e-12)
            self.common = max(self.common, float(np.linalg.norm(v[self.words.common[number]])))
            for hashes, own, gain in ((r.words, self.own, self.gain), (r.answer, self.reply, self.reply_gain)):
                h = np.array(hashes, dtype=np.int64).view(np.uint64)
                own.append(h)
                gain.append(self.words.weight[self.words.find(h)[1]])

    def candidates(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, passage, latent cosine) of windows with a latent cosine of at least the threshold."""
        of, first, begin = pieces(w)
        place, number = self.words.find(h)
        at, n = of[place], int(first[-1])
        key, times = np.unique(at * len(self.words.hashes) + number, return_counts=True)
        at, number = key // max(1, len(self.words.hashes)), key % max(1, len(self.words.hashes))
        value = (times * self.words.weight[number]).astype(np.float32)
        usual = np.where(self.words.common[number], value, 0)
        # a word of two neighbouring pieces counts with its sum in their window: that adds twice the product to the square
        after = np.minimum(np.searchsorted(key, key + len(self.words.hashes)), max(0, len(key) - 1))
        again = np.where(key[after] == key + len(self.words.hashes), value[after], 0)
        square, frequent = np.bincount(at, value * value, n), np.bincount(at, usual * usual, n)
        cross, cross_frequent = np.bincount(at, 2 * value * again, n), np.bincount(at, 2 * usual * again, n)
        doc = np.repeat(np.arange(w.n_docs), np.diff(first))
        joined = np.r_[doc[1:] == doc[:-1], False] if n else np.empty(0, bool)
        lone = np.r_[True, doc[1:] != doc[:-1]] & ~joined if n else joined
        window = np.flatnonzero(joined | lone)
        pair = lambda x, y: x[window] + np.where(joined[window], x[np.minimum(window + 1, n - 1)] + y[window], 0)
        whole, usual = pair(square, cross), pair(frequent, cross_frequent)
        # Cauchy's inequality on common and on other words: no passage has a larger share of common words than self.common
        on = (whole > 0) & (self.common * np.sqrt(usual) + np.sqrt(np.maximum(whole - usual, 0)) >= self.plain * np.sqrt(whole) * (1 - 1e-6))
        window = window[on]
        if not len(window):
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.float32),)
        need = np.zeros(n + 1, bool)
        need[window] = True
        need[window + 1] |= joined[window]
        used = need[:n][at]
        at, number, value = at[used], number[used], value[used]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rows = np.full(n + 1, -1)
        rows[at[starts]] = np.arange(len(starts))
        folded = np.zeros((len(starts) + 1, self.basis.shape[1]), np.float32)
        for i in range(0, len(starts), 1024):
            a, b = starts[i], starts[i + 1024] if i + 1024 < len(starts) else len(at)
            folded[i : min(i + 1024, len(starts))] = np.add.reduceat(self.basis[number[a:b]] * value[a:b, None], starts[i : i + 1024] - a, axis=0)
        found = []
        for i in range(0, len(window), 1024):
            some = window[i : i + 1024]
            # the last row of folded is zero: a window of one piece, or a piece without known words
            v = folded[rows[some]] + folded[np.where(joined[some], rows[some + 1], -1)]
            cos = (v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]) @ self.latent.T
            x, item = np.nonzero(cos >= self.cosine)
            found.append((x + i, item, cos[x, item]))
        x, item, cos = (np.concatenate(c) for c in zip(*found))
        return doc[window[x]], begin[window[x]], item, cos

    def plausible(self, w: Words, h: np.ndarray, doc: np.ndarray, begin: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the pieces around a candidate's window have words that weigh WEAK of its passage, in whatever order: no
        text without them passes the check. Looked up for all candidates of a passage at once."""
        on = np.zeros(len(doc), bool)
        if not len(doc):
            return on
        of, first, _ = pieces(w)
        place, number = self.words.find(h)
        reach = -(-WINDOW // STRIDE)
        n = int(first[-1]) + 3 * reach
        here = np.zeros((n, len(self.words.hashes)), bool)
        here[of[place] + reach, number] = True
        piece = first[doc] + (begin - w.first[doc]) // STRIDE
        order = np.argsort(item, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            k = item[some[0]]
            own = self.words.find(self.own[k])[1]
            held = here[:, own]
            near = held[piece[some]]
            for d in range(1, 3 * reach):
                near |= held[piece[some] + d]
            on[some] = near @ self.gain[k] >= WEAK * self.gain[k].sum() * (1 - 1e-9)
        return on

    def hits(self, w: Words, h: np.ndarray) -> dict[tuple[int, int], tuple[float, float, bool]]:
        """(text, item_id): the cosine of the window that shows it, the shared part and whether the answer is there."""
        out: dict[tuple[int, int], tuple[float, float, bool]] = {}
        doc, begin, item, cos = self.candidates(w, h)
        on = self.plausible(w, h, doc, begin, item)
        doc, begin, item, cos = doc[on], begin[on], item[on], cos[on]
        for k in np.lexsort((begin, -cos, item, doc)):
            r, d, s = self.items[item[k]], int(doc[k]), int(begin[k])
            if (d, r.item_id) in out:
                continue
            n = len(r.words)
            near = h[max(w.first[d], s - n) : min(w.first[d + 1], s + WINDOW + n)]
            gain = self.gain[item[k]]
            if gain[np.isin(self.own[item[k]], near)].sum() < WEAK * gain.sum():
                continue
            share = common_share(self.own[item[k]], gain, near)
            if share < WEAK:
                continue
            far = h[max(w.first[d], s - r.place - WINDOW) : min(w.first[d + 1], s - r.place + r.total + 2 * WINDOW)]
            replied = common_share(self.reply[item[k]], self.reply_gain[item[k]], far) >= STRONG
            if share >= STRONG or replied:
                out[d, r.item_id] = float(cos[k]), share, replied
        return out


def matchers(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, together: int = TOGETHER) -> Iterator[list[Matcher]]:
    """For each pass over the documents, a matcher for each of its blocks, at most `together` blocks of `size` passages."""
    # equal rows of the benchmark are one passage, or they would all be dealt to one block
    cut = saved(passages(benchmark).dropDuplicates(["item_id", "place", "words"]), "passages")
    total = cut.count()
    blocks = -(-total // size)
    while blocks:
        dealt = cut.withColumn("block", F.lit(0) if blocks == 1 else F.pmod(F.xxhash64("item_id", "place", "words"), F.lit(blocks)))
        if blocks == 1 or dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= size or blocks >= total:
            break
        blocks += -(-blocks // 8)
    for k in range(0, blocks, together):
        own = [dealt.filter(F.col("block") == b) for b in range(k, min(k + together, blocks))]
        rows = [sorted(b.collect(), key=lambda r: (r.item_id is None, r.item_id, r.place)) for b in own]
        if any(rows):
            words = weighed(docs, word_numbers(sum(rows, [])))
            some = [(b, r, part_of(words, word_numbers(r))) for b, r in zip(own, rows) if r]
            yield [Matcher(w, basis(b, w, max(1, min(RANK, len(r) // 2))), r) for b, r, w in some]


SCHEMA = "doc_id bigint, item_id bigint, cosine double, shared double, answered boolean"


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, together: int = TOGETHER) -> DataFrame:
    """doc_id, item_id, cosine (latent), shared and answered of each document and item that it holds."""
    found = None
    for m in matchers(docs, benchmark, size, together):
        shared = docs.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, rows = b.column("doc_id").to_pylist(), []
                for i, _, w in slices(b.column("text"), SLICE, PUNCTUATION):
                    h = w.hashes(lower=True)
                    rows += [(ids[i + d], item, *x) for own in shared.value for (d, item), x in own.hits(w, h).items()]
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))], names=["doc_id", "item_id", "cosine", "shared", "answered"])

        part = texts(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("shared").alias("shared"), F.max("answered").alias("answered"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, together: int = TOGETHER) -> DataFrame:
    """docs without the rows that hold an item, columns unchanged."""
    small_batches(docs.sparkSession)
    out = docs
    for m in matchers(docs, benchmark, size, together):
        shared = docs.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for i, _, w in slices(b.column("text"), SLICE, PUNCTUATION):
                    h = w.hashes(lower=True)
                    for own in shared.value:
                        clean[[i + d for d, _ in own.hits(w, h)]] = False
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
