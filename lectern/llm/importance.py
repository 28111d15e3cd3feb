"""Importance resampling towards a target distribution, over a stored matrix of documents by buckets.

Features are runs of `lowest` to `highest` consecutive words (letters and digits of ASCII, lower-cased, and every byte from
0x80 on), hashed by the CRC-32 of their bytes into buckets. The counts are stored once, as CSR blocks: a row of the table
holds the row pointers, bucket numbers and counts of some hundred documents. Column sums of the blocks give the
distribution of the documents; with that of the target they give a gain for each bucket; the product of the blocks with
the vector of gains gives each document's weight. The sums and gains are as many numbers as buckets; nothing else is
gathered. A Gumbel number of the id's hash turns weights into scores of a draw without replacement. A histogram of scores
names the score at which the draw ends, and only documents from there on are ranked, by ranges of the order.

Cases: a null text has no features and weight 0; a null id is hashed as the empty text and ranks last among ties; equal ids
are drawn in the order of features and weight, and equal rows in any order, which the result doesn't show; an empty
table gives no rows, an empty target has counts of 0; extra columns are not read. Long texts come in pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import running
from .shared import LAST, saved, texts
from .textops import Words, chunks

BUCKETS, LOWEST, HIGHEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 1, 20, 10, "2024"
#: Documents and entries of a block, at most (but for one document's own).
BLOCK_ROWS, BLOCK_ENTRIES = 512, 1 << 17
GAPS = np.ones(256, dtype=bool)
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
BLOCK = "doc_id array<bigint>, known array<boolean>, pointer array<int>, bucket array<int>, n array<int>"


def _table() -> np.ndarray:
    """Of CRC-32, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _table()


def crc32(buf: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int = 48) -> np.ndarray:
    """CRC-32 of each slice of buf: a byte of all of them at a time, longest first; longer ones than `longest` alone."""
    out = np.empty(len(start), dtype=np.uint32)
    size = end - start
    for k in np.flatnonzero(size > longest):
        out[k] = zlib.crc32(buf[start[k] : end[k]])
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= longest]
    at, left = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    active = np.searchsorted(-left, -np.arange(1, longest + 1), side="right")  # how many have that many bytes
    for k, n in enumerate(active):
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ buf[at[:n] + k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out[order] = ~crc
    return out


def features(w: Words, buckets: int, lowest: int = LOWEST, highest: int = HIGHEST, seen: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of the texts of w, but for runs of the first `seen` words alone."""
    buf, size = _LOW[w.buf], w.end - w.start
    if highest > 1:
        # words set apart by one space each, so that a run of words is a slice
        to = np.cumsum(size + 1)
        spaced = np.full(int(to[-1]) if len(to) else 0, 0x20, dtype=np.uint8)
        start, end = to - size - 1, to - 1
        if len(to):
            spaced[np.repeat(start - w.start, size) + _inside(w.start, size)] = buf[_inside(w.start, size)]
        buf = spaced
    else:
        start, end = w.start, w.end
    doc, left = w.doc(), np.repeat(w.first[1:], np.diff(w.first))
    docs, found = [], []
    for k in range(lowest, highest + 1):
        at = np.flatnonzero(np.arange(len(start)) + k <= left)
        at = at[at + k > seen] if seen else at
        docs.append(doc[at])
        found.append(crc32(buf, start[at], end[at + k - 1]) % np.uint32(buckets))
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def _inside(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of slices, one after the other."""
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(int(size.sum()))


def matrix(docs: DataFrame, buckets: int = BUCKETS, lowest: int = LOWEST, highest: int = HIGHEST, text: str = "text", name: str = "matrix") -> DataFrame:
    """The CSR blocks of docs, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[list] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = held = 0

        def block():
            pointer = np.concatenate([[0], np.cumsum(np.concatenate([p[0] for p in parts]))])
            columns = [sum(ids, []), None, pointer, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])]
            columns[1] = [x is not None for x in columns[0]]
            columns[0] = [x or 0 for x in columns[0]]
            kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "known", "pointer", "bucket", "n"])

        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            whole = None
            for row, to, w, _ in chunks(b.column("text"), highest - 1, gaps=GAPS):
                if to == row + 1 and (whole is not None or not w.ends):
                    # a piece of a long text: its counts are added up; the words that it repeats have been counted
                    seen = 0 if whole is None else highest - 1
                    whole = np.zeros(buckets, dtype=np.int64) if whole is None else whole
                    _, bucket = features(w, buckets, lowest, highest, seen)
                    whole += np.bincount(bucket, minlength=buckets)
                    if not w.ends:
                        continue
                    at = np.flatnonzero(whole)
                    found, whole = (np.array([len(at)]), at, whole[at]), None
                    parts.append(found)
                    ids.append(doc_ids[row:to])
                    rows, held = rows + 1, held + len(at)
                else:
                    doc, bucket = features(w, buckets, lowest, highest)
                    keys, n = np.unique(doc * buckets + bucket, return_counts=True)
                    sizes = np.bincount(keys // buckets, minlength=to - row)
                    first = np.concatenate([[0], np.cumsum(sizes)])
                    for i in range(0, to - row, 64):
                        j = min(i + 64, to - row)
                        parts.append((sizes[i:j], keys[first[i] : first[j]] % buckets, n[first[i] : first[j]]))
                        ids.append(doc_ids[row + i : row + j])
                        rows, held = rows + j - i, held + int(first[j] - first[i])
                        if rows >= BLOCK_ROWS or held >= BLOCK_ENTRIES:
                            yield block()
                            ids, parts, rows, held = [], [], 0, 0
                if rows >= BLOCK_ROWS or held >= BLOCK_ENTRIES:
                    yield block()
                    ids, parts, rows, held = [], [], 0, 0
        if rows:
            yield block()

    given = texts(docs.withColumn("text", F.col(text)) if text != "text" else docs).select("doc_id", "text")
    return saved(given.mapInArrow(run, BLOCK), name)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """The count of each bucket over all blocks: every task adds up its own, Spark adds up the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            np.add.at(total, _flat(b.column("bucket")), _flat(b.column("n")).astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    # a row for each bucket at most
    for r in blocks.select("bucket", "n").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, in doubles by the C library's logarithm."""
    buckets = len(source)
    all_source, all_target = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features and weight (floored mean gain) of each row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, known, pointer, bucket, n = (b.column(c).slice(k, 1) for c in ("doc_id", "known", "pointer", "bucket", "n"))
                pointer, n = _flat(pointer), _flat(n).astype(np.int64)
                padded = np.concatenate([n, [0]])
                product = np.concatenate([n * gain[_flat(bucket)], [0]])
                empty = np.diff(pointer) == 0
                counts, totals = (np.where(empty, 0, np.add.reduceat(x, pointer[:-1])) for x in (padded, product))
                weight = np.floor_divide(totals, np.maximum(counts, 1))
                doc_id = pa.array(_flat(ids), pa.int64(), mask=~_flat(known).astype(bool))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint")


def scored(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """rows with score: the weight and a Gumbel number of the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, lowest: int = LOWEST, highest: int = HIGHEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1 in the order of the draw, null where not drawn) of each row of docs.

    target: a table with `text`. `least` is the number of words of the documents that are drawn from, `percent` of them are."""
    blocks = matrix(docs, buckets, lowest, highest)
    goal = matrix(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), buckets, lowest, highest, name="target")
    gain = gains(column_sums(blocks, buckets), column_sums(goal, buckets))
    rows = saved(scored(weights(blocks, gain), seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    # of n words there are n + (n - 1) + ... runs, so a document of `least` words has as many features
    enough = sum(max(0, least - k + 1) for k in range(lowest, highest + 1))
    from_ = rows.filter(F.col("n_features") >= enough)
    k = from_.count() * percent // 100
    # whole numbers of a narrow range: as many rows as scores, not documents
    by_score = from_.groupBy("score").count()
    above = F.sum("count").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    last = by_score.withColumn("above", above).filter(F.col("above") < k).agg(F.min("score")).first()[0] if k else None
    drawn = (F.col("n_features") >= enough) & (F.col("score") >= F.lit(last).cast("bigint"))
    is_drawn = F.coalesce(drawn, F.lit(False))
    order = [F.desc("score"), F.asc("_ord"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    ranked = running(rows.filter(is_drawn).withColumn("_ord", F.coalesce("doc_id", F.lit(LAST))), order, {"rank": F.lit(1)})
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(F.col("rank") <= k, F.col("rank").cast("bigint")).alias("rank"))
    return ranked.unionByName(rows.filter(~is_drawn).select(*columns, F.lit(None).cast("bigint").alias("rank")))
