"""Divergence of sources within their language, over words found by a byte-level tokenizer.

Words are runs of the bytes that a table of 256 entries marks, in the concatenated UTF-8 buffer of a column: letters of
ASCII, with A-Z lower-cased, and every byte from 0x80 on, so a cut never falls inside a character. Slices are grouped by
their XXH64, computed for all slices of a length at once, and every slice is compared with its group's first slice byte
for byte; slices that differ in spite of equal hashes are told apart by their bytes. Each task adds up occurrences and
documents by language, source and word for a bounded piece of the texts at a time; Spark sums them.

The words in at least `least` documents of their language stay. They are dealt to shards, and a shard holds its counts as
a CSR matrix, sources by words. With smoothing a word that a source lacks still has a share, one figure for the source;
so the distance of two sources over the shard is taken from the stored entries alone: by reduceat over the rows of the
matrix, and for the words that only the other has by running sums over its sorted shares. A shard gives the partial
distances of its pairs and its own best words of each source, which are summed and ranked by Spark. All arithmetic is in
whole numbers.

Cases: null text, language and source count as ''; a group (language, source) without words occurs with shares of zero
counts; a language without kept words has distances of 0 and no words; equal rows count as often as they occur; an empty
table gives no rows; extra columns are not read. A text longer than a piece comes in pieces, its documents counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, small_batches
from .textops import chunks

LEAST, TOP, SMOOTH = 30, 50, 5
#: Rows of a shard, at least; bytes of text and distinct words that a task adds up before it hands them on.
SHARD_ROWS, PIECE_BYTES, PIECE_WORDS = 20_000, 48 << 20, 1_000_000
#: A table of groups with more rows than this is joined by a shuffle.
BROADCAST_ROWS = 100_000
GAPS = np.ones(256, dtype=bool)
GAPS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32

# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each row of a matrix of bytes, under 32 columns."""
    n, size = rows.shape
    h = np.full(n, (seed + int(_P5) + size) & (1 << 64) - 1, dtype=np.uint64)
    at = 0
    while at + 8 <= size:
        lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0]
        h = _turned(h ^ (_turned(lane * _P2, 31) * _P1), 27) * _P1 + _P4
        at += 8
    if at + 4 <= size:
        lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
        h = _turned(h ^ (lane * _P1), 23) * _P2 + _P3
        at += 4
    for k in range(at, size):
        h = _turned(h ^ (rows[:, k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def grouped(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of the group of equal slices for each slice of buf, and the bytes of each group."""
    from xxhash import xxh64_intdigest

    size = end - start
    group = np.empty(len(start), dtype=np.int64)
    words: list[bytes] = []
    order = np.argsort(size, kind="stable")
    bounds = np.flatnonzero(np.diff(size[order], prepend=-1))
    for i, j in zip(bounds, np.append(bounds[1:], len(order)), strict=False):
        at, width = order[i:j], int(size[order[i]])
        if width >= 32:
            # few: each alone, and its bytes are the key
            known: dict[tuple[int, bytes], int] = {}
            for k in at:
                word = buf[start[k] : end[k]].tobytes()
                key = (xxh64_intdigest(word), word)
                if key not in known:
                    known[key] = len(words)
                    words.append(word)
                group[k] = known[key]
            continue
        rows = buf[start[at][:, None] + np.arange(width)]
        _, first, inverse = np.unique(xxh64(rows), return_index=True, return_inverse=True)
        odd = np.flatnonzero((rows != rows[first[inverse]]).any(axis=1))
        group[at] = inverse + len(words)
        words += [r.tobytes() for r in rows[first]]
        extra: dict[bytes, int] = {}
        for k in odd:
            word = rows[k].tobytes()
            if word not in extra:
                extra[word] = len(words)
                words.append(word)
            group[at[k]] = extra[word]
    return group, words


class Tally:
    """Occurrences and documents of words by place (a language and source), bounded by `full`."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.places: dict[tuple[str, str], int] = {}
        self.words: dict[bytes, int] = {}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = self.held = 0

    def add(self, place: np.ndarray, doc: np.ndarray, word: np.ndarray, fresh: bool = True) -> None:
        """Words (numbers) at places; doc tells the texts apart. fresh: they count as documents of their words."""
        key = place << 32 | word
        keys, n = np.unique(key, return_counts=True)
        docs = np.zeros(len(keys), dtype=np.int64)
        if fresh and len(key):
            order = np.lexsort((doc, key))
            k, d = key[order], doc[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            docs = np.add.reduceat(new.astype(np.int64), np.flatnonzero(np.diff(k, prepend=k[0] - 1)))
        self.keys.append(keys)
        self.counts.append(np.stack([n, docs]))
        self.held += len(keys)
        if self.held > 4 * PIECE_WORDS:
            self._merge()

    def _merge(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.concatenate(self.counts, axis=1)
        total = np.zeros((2, len(keys)), dtype=np.int64)
        np.add.at(total[0], at, counts[0])
        np.add.at(total[1], at, counts[1])
        self.keys, self.counts, self.held = [keys], [total], len(keys)

    def full(self) -> bool:
        return self.bytes > PIECE_BYTES or len(self.words) > PIECE_WORDS or self.held > 3 * PIECE_WORDS

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self._merge()
            keys, (n, docs) = self.keys[0], self.counts[0]
            place, word = pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)
            langs, sources = (pa.array([p[i] for p in self.places], pa.string()) for i in (0, 1))
            words = pa.array(list(self.words), pa.binary()).cast(pa.string())
            for i in range(0, len(keys), 20_000):
                p, w = place.slice(i, 20_000), word.slice(i, 20_000)
                yield pa.RecordBatch.from_arrays([langs.take(p), sources.take(p), words.take(w), pa.array(n[i : i + 20_000]), pa.array(docs[i : i + 20_000])], names=["lang", "source", "term", "n", "docs"])
        self.clear()


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for b in batches:
        langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
        seen: set[int] = set()  # words that the pieces of the text at hand have had
        for row, _, w, base in chunks(b.column("text"), 0, gaps=GAPS):
            if tally.full():
                # a text that goes on keeps its words: its documents were counted with the piece before
                held = [k for k, v in tally.words.items() if v in seen] if base else []
                yield from tally.rows()
                seen = {tally.words.setdefault(k, len(tally.words)) for k in held}
            n = w.n_docs
            place = np.array([tally.places.setdefault((langs[row + i], sources[row + i]), len(tally.places)) for i in range(n)], dtype=np.int64)
            group, words = grouped(_LOW[w.buf], w.start, w.end)
            known = np.array([tally.words.setdefault(x, len(tally.words)) for x in words], dtype=np.int64)
            doc, word = w.doc(), known[group] if len(group) else group
            tally.bytes += len(w.buf)
            if base == 0 and w.ends:
                tally.add(place[doc], doc, word)
                continue
            if base == 0:
                seen = set()
            new = np.array([x not in seen for x in known.tolist()], dtype=bool)
            new = new[group] if len(group) else np.zeros(0, dtype=bool)
            tally.add(place[doc][new], doc[new], word[new])
            tally.add(place[doc][~new], doc[~new], word[~new], fresh=False)
            seen.update(known.tolist())
    yield from tally.rows()


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term and n (occurrences) of the words in at least `least` documents of their language; written once."""
    small_batches(docs.sparkSession)
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    found = docs.select(*columns).mapInArrow(_tallied, "lang string, source string, term string, n bigint, docs bigint")
    # one shuffle: what follows is grouped by these two, or by these and the source
    dealt = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = dealt.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).filter(F.col("docs") >= least)
    return saved(kept.select("lang", "source", "term", "n"), "term-counts")


def groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, total (N of the group), all_total (N of the language), terms (V), rows (of the language's counts) and g (a
    number within the language) of each group that occurs."""
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    terms = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    joined = occurring.join(totals, ["lang", "source"], "left").fillna(0, ["total", "rows"])
    lang = Window.partitionBy("lang")  # a row for each source
    joined = joined.withColumns({"all_total": F.sum("total").over(lang), "rows": F.sum("rows").over(lang), "g": F.row_number().over(lang.orderBy("source")), "groups": F.count(F.lit(1)).over(lang)})
    return saved(joined.join(terms, "lang", "left").fillna(0, ["terms"]), "groups")


def share(n: np.ndarray, total: np.ndarray, terms: np.ndarray, smooth: int = SMOOTH) -> np.ndarray:
    """1 + floor(10**9 * (n + smooth) / (total + smooth * terms)), by long division in three steps of a thousand: exact up to
    totals of 9 * 10**15."""
    below = np.asarray(total + smooth * terms, dtype=np.int64)
    whole, rest = np.divmod(np.asarray(n, dtype=np.int64) + smooth, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def sorted_distance(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each x of `to`, the sum of |v - x| over values, which are sorted."""
    before = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(values, to)
    return to * at - before[at] + (before[-1] - before[at]) - to * (len(values) - at)


def shard_result(g: np.ndarray, column: np.ndarray, n: np.ndarray, info: tuple[np.ndarray, ...], width: int, top: int = TOP, smooth: int = SMOOTH):
    """Partial distances and best words of a shard.

    g, column, n: entries, sorted by g; info: number, total, total of the language and V of every group. Gives a, b, value
    (pairs of groups, a before b) and group, column, value (words, at most `top` of a group, ties of the last one too)."""
    numbers, totals, all_totals, terms = info
    row = np.searchsorted(numbers, g)
    p = share(n, totals[row], terms[row], smooth)
    none = share(np.zeros(len(numbers), dtype=np.int64), totals, terms, smooth)
    together = np.zeros(width, dtype=np.int64)
    np.add.at(together, column, n)
    q = share(together[column], all_totals[row], terms[row], smooth)
    first = np.searchsorted(row, np.arange(len(numbers) + 1))
    filled = np.flatnonzero(np.diff(first))  # reduceat has no empty runs
    a_of, b_of, values = [], [], []
    for a in range(len(numbers) - 1):
        i, j = first[a], first[a + 1]
        dense = np.full(width, none[a], dtype=np.int64)
        dense[column[i:j]] = p[i:j]
        # every word, as if the others had none; then what their entries change
        others = np.arange(a + 1, len(numbers))
        distance = sorted_distance(np.sort(p[i:j]), none) + (width - (j - i)) * np.abs(none - none[a])
        rest = filled[filled > a]
        if len(rest):
            mine = dense[column[first[rest[0]] :]]
            entries = slice(first[rest[0]], len(p))
            change = np.abs(p[entries] - mine) - np.abs(none[row[entries]] - mine)
            distance[rest] += np.add.reduceat(change, first[rest] - first[rest[0]])
        a_of.append(np.full(len(others), numbers[a]))
        b_of.append(numbers[others])
        values.append(distance[others])
    above = np.flatnonzero(p > q)
    best = []
    for a in filled:
        at = above[(above >= first[a]) & (above < first[a + 1])]
        f = p[at] - q[at]
        if len(at) > top:
            at = at[f >= np.partition(f, len(f) - top)[len(f) - top]]
        best.append(at)
    at = np.concatenate(best) if best else np.zeros(0, dtype=np.int64)
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return (flat(a_of), flat(b_of), flat(values)), (g[at], column[at], p[at] - q[at])


_SHARD = "lang string, a int, b int, term string, value bigint"


def _shard(table: pa.Table) -> pa.Table:
    """A shard's groups (rows without a term) and counts."""
    heads = table.filter(pc.is_null(table["term"])).sort_by("g")
    rows = table.filter(pc.is_valid(table["term"])).sort_by("g")
    lang = heads["lang"][0].as_py()
    codes = rows["term"].combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    info = tuple(heads[c].to_numpy().astype(np.int64) for c in ("g", "total", "all_total", "terms"))
    (a, b, value), (g, column, f) = shard_result(rows["g"].to_numpy().astype(np.int64), codes.indices.to_numpy().astype(np.int64), rows["n"].to_numpy(), info, len(codes.dictionary))
    n = len(a) + len(g)
    return pa.table([pa.array([lang] * n, pa.string()), pa.array(np.concatenate([a, g]), pa.int32()), pa.array(np.concatenate([b, np.zeros(len(g), dtype=np.int64)]), pa.int32()), pa.concat_arrays([pa.nulls(len(a), pa.string()), codes.dictionary.take(pa.array(column)).cast(pa.string())]), pa.array(np.concatenate([value, f]), pa.int64())], names=["lang", "a", "b", "term", "value"])


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    counts = term_counts(docs, least)
    known = groups(docs, counts)
    few = known.count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda x: x)
    shards = F.ceil(F.col("rows") / F.greatest(F.lit(SHARD_ROWS), F.col("groups") * F.col("groups"))).cast("int")
    known = known.withColumn("shards", shards)
    info = ["lang", "g", "total", "all_total", "terms"]
    entries = counts.join(hint(known.select(*info, "source", "shards")), ["lang", "source"])
    entries = entries.select(*info, "term", "n", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    heads = known.filter("shards > 0").select(*info, F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    found = saved(entries.unionByName(heads).groupBy("lang", "shard").applyInArrow(_shard, _SHARD), "shards")
    names = known.select("lang", F.col("g").alias("a"), "source")
    others = known.select("lang", F.col("g").alias("b"), F.col("source").alias("item"))
    # a row for each pair of sources of a language, as the result has
    sums = found.filter("term IS NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = hint(names).join(hint(others), "lang").filter("a != b").join(both, ["lang", "a", "b"], "left").fillna(0, ["value"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = found.filter("term IS NOT NULL").join(hint(names), ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
