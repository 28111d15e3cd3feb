"""Exact dedup on an extendible-hash index kept on shared files.

Texts are equal when identical after each run of 0x20 and 0x09-0x0D became one space. The key of a text is a 64-bit hash
of the normalised text. A directory maps the leading bits of a key to a bucket: it starts with one bucket, a bucket with
more than `capacity` keys is split by the next bit, and the directory doubles when a bucket as deep as itself is split. It
has at most 2**DEEPEST slots (16 MB, broadcast); buckets of that depth are left overfull.

Texts are dealt by the directory to the tasks that own their buckets (ranges of keys). An owner goes through its keys in
order: texts that collide in a key are chained, each told from the entries of the chain by comparing the bytes. The index,
a table of the entries (bucket, key, place in the chain, digest of the text, keep_id, group_size), lies in the shared
folder; each row of the documents then finds its bucket through the directory and its entry in the bucket.

Copies that a task reads are combined before they are sent (it remembers up to HELD bytes of distinct texts), so a text
that a third of the rows share is sent once for each HELD bytes of other texts.

Nulls count as empty texts; a null doc_id never wins over another and groups of null ids alone keep a null keep_id; equal
rows (same id and text) are all returned and just one of them is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LAST, saved, texts

#: Keys in a bucket before it is split, key bits that one count of keys looks at, and the deepest directory.
CAPACITY, STEP, DEEPEST, HELD = 1 << 12, 10, 20, 16 << 20


def normal(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("bigint")


def directory(keys: DataFrame, capacity: int = CAPACITY, deepest: int = DEEPEST) -> list[tuple[int, int]]:
    """(local depth, leading bits) of each bucket, in the order of the keys. Of the rows with a key only counts of prefixes
    come to the driver: at most 2**STEP for each bucket that is still overfull, and one more for each bucket there is."""
    done, open_ = [], [(0, 0)]
    while open_:
        at = open_[0][0]
        depth = min(at + STEP, deepest)
        inside = keys
        if at:
            some = keys.sparkSession.createDataFrame([(p,) for _, p in open_], "prefix bigint")
            inside = keys.join(F.broadcast(some), _prefix(F.col("key"), at) == F.col("prefix"), "left_semi")
        counts = {r[0]: r[1] for r in inside.groupBy(_prefix(F.col("key"), depth)).count().collect()}
        # counts of all shorter prefixes
        levels = {depth: counts}
        for d in range(depth - 1, at - 1, -1):
            levels[d] = {}
            for p, n in levels[d + 1].items():
                levels[d][p >> 1] = levels[d].get(p >> 1, 0) + n
        again, stack = [], list(open_)
        while stack:
            d, p = stack.pop()
            if levels[d].get(p, 0) <= capacity or d == deepest:
                done.append((d, p))
            elif d == depth:
                again.append((d, p))
            else:
                stack += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        open_ = sorted(again)
    return sorted(done, key=lambda x: x[1] << (64 - x[0]))


def slots(spark, buckets: list[tuple[int, int]]) -> tuple[DataFrame, int]:
    """The directory as a table (slot, bucket), a row for each prefix of the global depth, and that depth."""
    depth = max(d for d, _ in buckets)
    table = pa.table({"bucket": pa.array(range(len(buckets)), pa.int32()), "slot": pa.array([p << (depth - d) for d, p in buckets], pa.int64()), "width": pa.array([1 << (depth - d) for d, _ in buckets], pa.int64())})
    rows = spark.createDataFrame(table)
    return rows.select("bucket", F.explode(F.sequence("slot", F.col("slot") + F.col("width") - 1)).alias("slot")), depth


def dealt(rows: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """rows with their key's bucket, looked up in the directory."""
    table, depth = slots(rows.sparkSession, buckets)
    return rows.withColumn("slot", _prefix(F.col("key"), depth)).join(F.broadcast(table), "slot").drop("slot")


def _combined(rows: DataFrame, held: int) -> DataFrame:
    """bucket, key, body, ord (the least) and n of the texts, copies that a task reads put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], list] = {}
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([v[0] for v in seen.values()], pa.int32()), pa.array([k for k, _ in seen], pa.int64()), pa.array([t for _, t in seen], pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[2] for v in seen.values()], pa.int64())], names=["bucket", "key", "body", "ord", "n"])

        for b in batches:
            for bucket, key, body, order in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "body", "ord")), strict=True):
                entry = seen.get((key, body))
                if entry is None:
                    seen[key, body] = [bucket, order, 1]
                    size += len(body) + 100
                else:
                    entry[1] = min(entry[1], order)
                    entry[2] += 1
            if size > held:
                yield out()
                seen.clear()
                size = 0
        if seen:
            yield out()

    return rows.select("bucket", "key", "body", "ord").mapInArrow(run, "bucket int, key bigint, body string, ord bigint, n bigint")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the texts of an owner, which come in the order of their keys."""
    chain: list[list] = []  # entries of the key at hand: body, least ord, rows
    last: tuple[int, int] | None = None
    made: list[tuple] = []
    names = ["bucket", "key", "link", "body", "ord", "n"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    for b in batches:
        for bucket, key, body, order, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "body", "ord", "n")), strict=True):
            if (bucket, key) != last:
                made += [(*last, i, *e) for i, e in enumerate(chain)] if last else []
                chain, last = [], (bucket, key)
            entry = next((e for e in chain if e[0] == body), None)
            if entry is None:
                chain.append([body, order, n])
            else:
                entry[1] = min(entry[1], order)
                entry[2] += n
        if made:
            yield out()
            made = []
    made += [(*last, i, *e) for i, e in enumerate(chain)] if last else []
    if made:
        yield out()


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", "ord", normal(F.col("text")).alias("body")).withColumn("key", F.xxhash64("body"))


def index(docs: DataFrame, capacity: int = CAPACITY, held: int = HELD) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The index and its directory. Rows: bucket, key, link, text_sha256, keep_id, group_size; one for each distinct text."""
    rows = _keyed(docs)
    # copies within a task count once: the sketch of a split needn't know how often a key occurs
    buckets = directory(saved(rows.groupBy("key").count(), "keys"), capacity)
    owned = _combined(dealt(rows, buckets), held).repartition("bucket").sortWithinPartitions("bucket", "key")
    entries = owned.mapInArrow(_chained, "bucket int, key bigint, link int, body string, ord bigint, n bigint")
    keep = F.when(F.col("ord") != LAST, F.col("ord"))
    return saved(entries.select("bucket", "key", "link", F.sha2("body", 256).alias("text_sha256"), keep.alias("keep_id"), F.col("n").alias("group_size")), "index"), buckets


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, held: int = HELD) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket and link (place in the chain of the key) for each row of docs."""
    found, buckets = index(docs, capacity, held)
    rows = dealt(_keyed(docs).select("doc_id", "key", F.sha2("body", 256).alias("text_sha256")), buckets)
    rows = rows.groupBy("doc_id", "bucket", "key", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(found, ["bucket", "key", "text_sha256"], "left")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256", "bucket", "link")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_first(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs without later copies, columns unchanged."""
    out = exact_dedup(docs, capacity).filter("kept")
    order, sha = (unused(docs, c) for c in ("_ord", "_sha"))
    keep = out.select(F.coalesce("doc_id", F.lit(LAST)).alias(order), F.col("text_sha256").alias(sha))
    # the texts are dealt out once: the duplicates of a row are in the task that joins it
    marked = docs.withColumn(order, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))).withColumn(sha, F.sha2(normal(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))
    return marked.join(keep, [order, sha], "left_semi").dropDuplicates([order, sha]).drop(order, sha)
