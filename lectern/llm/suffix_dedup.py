"""Repeated passages by sparse suffix arrays.

Of the suffixes of a text (from each word on) those are retained that start at a minimiser: the least of the hashes of
`gram` words among `span` neighbours. The choice depends on the words alone, so every window of `length` words retains
one of its first `span` suffixes, the same one wherever the window stands.

A suffix is written as codes of one byte a word: its first `length - span + 1` words, then the `span - 1` words before it,
nearest first. The suffixes of all documents are sorted by these codes, so those that begin alike are neighbours, and among
them those with the longest common left context. Each is compared with both neighbours: a suffix whose first words equal
a neighbour's is a match, extended to the left as far as the contexts agree (a neighbour in the sorted order agrees at
least as far as any other suffix) and to the right as far as whole windows of `length` words agree, told apart by their
words. Joined windows are the maximal repeats. Equal codes of unequal words only add work.

The sort deals out ranges of (codes, document, place), so suffixes that a third of the rows share spread over tasks; the
first and last of each task, whose neighbour may be elsewhere, count as matches extended as far as their context goes.
A word is removed if a window over it also starts in a document with a smaller doc_id.

Null texts have no words; null ids rank last; rows of one id never remove each other's words; equal rows give equal
results; texts of fewer words than a window are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import LENGTH, cut, repeated
from .shared import saved, texts
from .textops import Words, chunks

GRAM, SPAN = 8, 25


def minimisers(w: Words, hashes: np.ndarray, gram: int = GRAM, span: int = SPAN) -> np.ndarray:
    """Index of the words at which a retained suffix starts."""
    at, h = w.windows(hashes, gram)
    if len(at) < span:
        return at[:0]
    least = np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1) + np.arange(len(h) - span + 1)
    inside = at[span - 1 :] - at[: len(at) - span + 1] == span - 1
    return at[np.unique(least[inside])]


def suffixes(w: Words, length: int, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, codes of the words on the right and then of those on the left) of the retained suffixes
    that are long enough. A missing word on the left has code zero."""
    hashes = w.hashes()
    right = length - span + 1
    at = minimisers(w, hashes, gram, span)
    doc = np.searchsorted(w.first, at, side="right") - 1
    on = at + right <= w.first[doc + 1]
    at, doc = at[on], doc[on]
    if not len(at):
        return at, np.empty((0, length), np.uint8)
    codes = (hashes >> np.uint64(56)).astype(np.uint8)
    left = np.minimum(at - w.first[doc], span - 1)
    back = at[:, None] - 1 - np.arange(span - 1)[None, :]
    before = np.where(np.arange(span - 1)[None, :] < left[:, None], codes[np.maximum(back, 0)], 0)
    return at, np.concatenate([codes[at[:, None] + np.arange(right)[None, :]], before], axis=1).astype(np.uint8)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first columns two rows have in common."""
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def matches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """Hits: ord, row_key, at (starts of suffixes that match a neighbour of the sorted array) and back (words to the left
    that they have in common with it)."""
    right, width = length - span + 1, length

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "row_key"))
            # a chunk repeats so many words of the one before it that no window of words around a suffix is lost
            for i, _, w, base in chunks(b.column("text"), length + span + gram):
                at, codes = suffixes(w, length, gram, span)
                doc = np.searchsorted(w.first, at, side="right") - 1
                data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * width).astype(np.int32)), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([data, pa.array(order[i + doc]), pa.array(key[i + doc]), pa.array((at - w.first[doc] + base).astype(np.int32))], names=["codes", "ord", "row_key", "at"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rest = np.empty((0, width), np.uint8), [np.empty(0, np.int64)] * 2 + [np.empty(0, np.int32)]
        best = np.empty(0, np.int64)

        def out(n):
            nonlocal held, rest, best
            on = np.flatnonzero(best[:n] >= right)
            order, key, at = (c[:n][on] for c in rest)
            back = (best[:n][on] - right).astype(np.int32)
            # one row for each suffix, in lists for the sake of the join
            ones = pa.array(np.arange(len(on) + 1, dtype=np.int32))
            made = pa.RecordBatch.from_arrays([pa.array(order), pa.array(key), pa.ListArray.from_arrays(ones, pa.array(at)), pa.ListArray.from_arrays(ones, pa.array(back))], names=["ord", "row_key", "at", "back"])
            held, rest, best = held[n:], [c[n:] for c in rest], best[n:]
            return made

        started = False
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("codes").cast(pa.binary())
            fresh = np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint8).reshape(-1, width)
            new = np.zeros(len(fresh), dtype=np.int64)
            if not started:
                new[0] = width  # the neighbour is in another task
            codes = np.concatenate([held, fresh])
            best = np.concatenate([best, new])
            beside = common(codes[1:], codes[:-1])
            best[1:] = np.maximum(best[1:], beside)
            best[:-1] = np.maximum(best[:-1], beside)
            held, started = codes, True
            rest = [np.concatenate([c, b.column(x).to_numpy(zero_copy_only=False)]) for c, x in zip(rest, ("ord", "row_key", "at"))]
            yield out(len(held) - 1)
        if started:
            best[-1] = width
            yield out(1)

    array = texts(docs).select("ord", "row_key", "text").mapInArrow(retain, "codes binary, ord bigint, row_key bigint, at int")
    keys = ("codes", "ord", "at")
    return array.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "ord bigint, row_key bigint, at array<int>, back array<int>")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans and kept_text of each row of docs."""
    return cut(docs, repeated(docs, saved(matches(docs, length), "matches"), length), length)
