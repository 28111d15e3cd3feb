"""SimHash near-duplicates through tables of distances to pivots.

A fingerprint has 64 bits; a bit is one if it is set in over half of the 64-bit hashes of the text's word shingles,
repeats included. Fingerprints link when at most `radius` bits differ. Candidates meet in cells: the bits are dealt to
radius + 1 bands, of which two linked fingerprints share at least one, so a cell is a band with its value. In a cell the
fingerprints stand beside a table of their distances to PIVOTS reference fingerprints, sorted by the first distance. By
the triangle inequality no distance of a linked pair differs by more than the radius: pairs beyond that are discarded,
and the survivors are verified by their own Hamming distance. Equal fingerprints were merged before, whatever their
number. A cell emits a spanning forest of its links, never all pairs; larger components come from `components`.

A cell with more than `crowd` fingerprints is dealt again by bands of the other bits, which again keeps every link.

Null texts count as empty (fingerprint zero, linked like any other); null ids rank last and give a null component only
if no other id is reachable; equal rows are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .exact_dedup import unused
from .near_dedup import similar_groups
from .shared import LAST, row_key, saved, texts
from .textops import mix

SHINGLE, RADIUS, PIVOTS, CROWD, SEED = 3, 3, 16, 4096, 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64))


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return []
    body = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(body, SEED)]
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[size:]] + [len(body)]
    return [xxh64_intdigest(body[i:j], SEED) for i, j in zip(starts, ends, strict=False)]


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each run first[i]:first[i+1] of hashes: counts of byte values give the counts of bits."""
    n = len(first) - 1
    sizes = np.diff(first)
    owner = np.repeat(np.arange(n), sizes) * 256
    out = np.zeros((n, 8), dtype=np.uint8)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        counts = np.bincount(owner + octets[:, k], minlength=n * 256).reshape(n, 256)
        out[:, k] = np.packbits(counts @ _BITS * 2 > sizes[:, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ord and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = [shingle_hashes(t, shingle) for t in part.column("text").to_pylist()]
                first = np.cumsum([0, *map(len, found)])
                flat = np.fromiter((x for f in found for x in f), dtype=np.uint64, count=first[-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ord"), pa.array(majority(flat, first).view(np.int64))], names=["doc_id", "ord", "fp"])

    return texts(docs).select("doc_id", "ord", "text").mapInArrow(run, "doc_id bigint, ord bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _survivors(fp: np.ndarray, cell: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows of one cell; rows sorted by cell, then by the first distance of the table."""
    n = len(fp)
    live = np.arange(n)
    for step in range(1, n):
        live = live[live + step < n]
        near = live + step
        # the rows are sorted: once the first distance is out of reach it stays so, and the row is done
        on = (cell[live] == cell[near]) & (table[near, 0] - table[live, 0] <= radius)
        live = live[on]
        if not len(live):
            return
        a, b = live, live + step
        for k in range(1, table.shape[1]):
            ok = np.abs(table[a, k] - table[b, k]) <= radius
            a, b = a[ok], b[ok]
            if not len(a):
                break
        if len(a):
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            if ok.any():
                yield a[ok], b[ok]


def cell_links(fp: np.ndarray, cell: np.ndarray, radius: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within cells; equal cells are next to each other."""
    table = np.bitwise_count(fp[:, None] ^ marks[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], cell))
    fp, cell, table = fp[order], cell[order], table[order]
    a, b, held, most = [], [], 0, 1 << 20
    for x, y in _survivors(fp, cell, table, radius):
        a.append(fp[x])
        b.append(fp[y])
        held += len(x)
        if held > most:
            p, q = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [p], [q], len(p)
            most = max(most, 2 * held)
    if not held:
        return fp[:0], fp[:0]
    return forest(np.concatenate(a), np.concatenate(b))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect what fingerprints (fp, distinct) within radius of each other connect."""
    marks = pivots()
    level = distinct.select("fp", F.lit(0).cast("bigint").alias("fixed"), F.lit("").alias("path"))
    found = None
    for deep in range(3):
        # bands of level 0 take every (radius + 1)th bit, those of the next levels split what a band leaves free
        masks = [_signed(sum(1 << b for b in range(64) if b // (radius + 1) ** deep % (radius + 1) == k)) for k in range(radius + 1)]
        cells = level.withColumn("m", F.explode(F.array(*map(F.lit, masks)))).withColumn("mask", F.col("m").bitwiseAND(F.bitwise_not("fixed")))
        cells = cells.select("fp", (F.col("fixed").bitwiseOR(F.col("mask"))).alias("fixed"), F.concat_ws(".", "path", F.col("m").cast("string")).alias("path"))
        cells = cells.withColumn("value", F.col("fp").bitwiseAND(F.col("fixed"))).withColumn("cell", F.xxhash64("path", "value"))
        last = deep == 2
        crowded = None
        if not last:
            # a distinct fingerprint has radius + 1 rows: cells over the limit are few, and the join is on their own count
            sizes = cells.groupBy("cell").count().filter(F.col("count") > crowd).select("cell").checkpoint()
            if sizes.limit(1).count():
                crowded = cells.join(sizes, "cell", "left_semi").select("fp", "fixed", "path")
                cells = cells.join(sizes, "cell", "left_anti")

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_fp, keep_cell = np.empty(0, np.uint64), np.empty(0, np.int64)
            for b in batches:
                fp = np.concatenate([keep_fp, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
                cell = np.concatenate([keep_cell, b.column("cell").to_numpy(zero_copy_only=False)])
                whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
                keep_fp, keep_cell = fp[whole:], cell[whole:]
                x, y = cell_links(fp[:whole], cell[:whole], radius, marks)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])
            x, y = cell_links(keep_fp, keep_cell, radius, marks)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        links = cells.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(link, "a bigint, b bigint")
        found = links if found is None else found.unionByName(links)
        if crowded is None:
            return found
        level = crowded
    return found


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable over links) of each row."""
    prints = saved(fingerprints(docs, shingle), "fingerprints")
    distinct = saved(prints.groupBy("fp").agg(F.min("ord").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_print = rooted.join(least, "root").select("fp", "component")
    out = prints.join(by_print, "fp")
    component = F.when(F.col("component") == LAST, F.lit(None).cast("bigint")).otherwise(F.col("component"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of similar texts, the first by doc_id (null last) and row_key, columns unchanged."""
    # a stage takes longer shingles and a similarity, not the bits of near_groups; an id doesn't tell rows apart, a row_key does
    least = similar_groups(docs).groupBy("root").agg(F.min(F.struct("ord", "row_key")).alias("least"))
    order, key = (unused(docs, c) for c in ("_ord", "_key"))
    keep = least.select(F.col("least.ord").alias(order), F.col("least.row_key").alias(key))
    doc_id = F.col("doc_id").cast("bigint")
    marked = docs.withColumn(order, F.coalesce(doc_id, F.lit(LAST))).withColumn(key, row_key(doc_id, F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return marked.join(keep, [order, key], "left_semi").dropDuplicates([order, key]).drop(order, key)
