"""Substring dedup by fixed-block anchors.

Every document is indexed by its non-overlapping blocks of `length` / 2 words; of any `length` words at least one block
lies inside. Every rolling window of the size of a block probes the index. Blocks and probes meet in the task that owns a
range of their hashes; a block that is found at another place as well is an anchor, and each place of it is a hit, on
both sides. Around the hits windows of `length` words are compared as wholes, and joined windows are the maximal exact
repeats. A word is removed if a window over it also starts in a document with a smaller doc_id, judged on the input.

The plan is the same at every size: the hashes of blocks and probes (32 bits within an owner, whose share doesn't grow)
are shuffled once, and hash collisions only add hits, as the windows are told apart by their words.

Null texts have no words; null ids rank last, and rows of one id never remove each other's words; equal rows give equal
results; texts of fewer words than a window are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import packed
from .repeats import LENGTH, cut, repeated
from .shared import saved, texts
from .textops import chunks

_SENT = "owner int, flush bigint, probes binary, places binary, blocks binary, texts binary"
_LOW = np.uint64(0xFFFFFFFF)


def _probes(docs: DataFrame, size: int, owners: int, flush: int) -> DataFrame:
    """Rows for the owners (hashes of rolling windows, their places in the flush, hashes of blocks) and the flushes' lists
    of texts: ord, row_key, first window and the place of that window in the text."""

    def sent(items, lists, number):
        h, block = items
        owner, low = packed.owner_of(h, owners), (h & _LOW).astype(np.uint32)
        rows = [(o, number, packed.planes(low[at]), packed.places(at), low[at[block[at]]].tobytes(), None) for o, at in packed.dealt(owner, owners)]
        first, order, key, base = lists
        rows.append((number % owners, number, None, None, None, np.stack([first, order, key, base]).astype(np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["owner", "flush", "probes", "places", "blocks", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = packed.Flush(), TaskContext.get().partitionId() << 32
        for b in batches:
            order, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "row_key"))
            for i, j, w, base in chunks(b.column("text"), size - 1):
                at, h = w.windows(w.hashes(), size)
                if not len(at):
                    continue
                doc = np.searchsorted(w.first, at, side="right") - 1
                # all windows of a text stand in a row, so its first one tells the place of each
                some, first = np.unique(doc, return_index=True)
                held.add((h, (at - w.first[doc] + base) % size == 0), first, (order[i + some], key[i + some], np.full(len(some), base)))
                if held.size >= flush:
                    yield sent(*held.taken(), number)
                    number += 1
        if held.size:
            yield sent(*held.taken(), number)

    return texts(docs).select("ord", "row_key", "text").mapInArrow(run, _SENT)


def _owned(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one owner: the places of hits in each flush; lists of texts pass through."""
    flush, probes, place, blocks = [], [], [], []
    for b in batches:
        for f, p, at, k, t in zip(b.column("flush").to_pylist(), *(b.column(c) for c in ("probes", "places", "blocks", "texts"))):
            if t.is_valid:
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([None], pa.binary()), pa.array([t.as_py()], pa.binary())], names=["flush", "hits", "texts"])
            else:
                flush.append(f)
                probes.append(packed.numbers(p.as_buffer(), 4))
                place.append(packed.placed(at.as_buffer()))
                blocks.append(np.frombuffer(k.as_buffer(), dtype=np.uint32))
    if not probes:
        return
    index = np.unique(np.concatenate(blocks))
    if not len(index):
        return
    inside = []
    for p in probes:
        near = index[np.minimum(np.searchsorted(index, p), len(index) - 1)]
        inside.append(np.flatnonzero(near == p))
    hashes = np.concatenate([p[x] for p, x in zip(probes, inside)])
    number = np.searchsorted(index, hashes)
    anchor = np.bincount(number, minlength=len(index)) > 1
    for f, p, at, x in zip(flush, probes, place, inside):
        hit = x[anchor[np.searchsorted(index, p[x])]]
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([packed.places(at[hit])], pa.binary()), pa.array([None], pa.binary())], names=["flush", "hits", "texts"])


def anchors(docs: DataFrame, length: int = LENGTH, owner_bytes: int = packed.OWNER_BYTES, flush: int = packed.FLUSH) -> DataFrame:
    """Hits: ord, row_key, at (places of anchors) and back (length - block words before them a window may start)."""
    size = length // 2
    owners = packed.n_owners(docs, owner_bytes)
    answers = saved(_probes(docs, size, owners, flush).groupBy("owner").applyInArrow(_owned, "flush bigint, hits binary, texts binary"), "anchors")

    def told(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, hits = None, []
        for b in batches:
            for h, t in zip(b.column("hits"), b.column("texts")):
                if t.is_valid:
                    lists = np.frombuffer(t.as_buffer(), dtype=np.int64).reshape(4, -1)
                else:
                    hits.append(packed.placed(h.as_buffer()))
        if not hits:
            return
        first, order, row_key, base = lists
        place = np.sort(np.concatenate(hits))
        text = packed.text_of(first, place)
        some, cuts = np.unique(text, return_index=True)
        at = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(place)).astype(np.int32)), pa.array((base[text] + place - first[text]).astype(np.int32)))
        back = pa.ListArray.from_arrays(at.offsets, pa.array(np.full(len(place), length - size, dtype=np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(order[some]), pa.array(row_key[some]), at, back], names=["ord", "row_key", "at", "back"])

    return answers.groupBy("flush").applyInArrow(told, "ord bigint, row_key bigint, at array<int>, back array<int>")


def substring_dedup(docs: DataFrame, length: int = LENGTH, owner_bytes: int = packed.OWNER_BYTES, flush: int = packed.FLUSH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans and kept_text of each row of docs."""
    hits = anchors(docs, length, owner_bytes, flush)
    return cut(docs, repeated(docs, hits, length), length)
