"""Words and hashes of whole Arrow text columns, as flat numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Null texts count as empty. All functions work on slices
of a batch of about half a megabyte, so memory doesn't grow with the batch; with `slices` a single longer text makes one
slice, with `chunks` it comes in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes between words where punctuation counts as white space: all of ASCII but letters and digits.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


@dataclass
class Words:
    """Words of some texts: byte ranges in buf, and first[i]:first[i+1] are the words of text i. ends: whether the last text
    ends here (a chunk of a longer one needn't)."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    ends: bool = True

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def position(self) -> np.ndarray:
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z count as a-z."""
        up, down = _BYTES.get(len(self.buf) + 1)
        total = np.empty(len(self.buf) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((_LOWER if lower else _TABLE)[self.buf] * up[: len(self.buf)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every n consecutive words of one text."""
        if len(hashes) < n:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        up, down = _WORDS.get(len(hashes) + 1)
        total = np.empty(len(hashes) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        left = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(len(hashes)) + n <= left)
        return at, mix((total[at + n] - total[at]) * down[at])


def texts_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> Words:
    solid = ~gaps[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offsets] = True
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = solid
    start = np.flatnonzero(solid & (~before[:-1] | cut[:-1]))
    after = np.zeros(len(buf) + 1, dtype=bool)
    after[: len(buf)] = solid
    end = np.flatnonzero(solid & (~after[1:] | cut[1:])) + 1
    return Words(buf, offsets, start, end, np.searchsorted(start, offsets))


def slices(column: pa.Array, size: int = SLICE_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of slices of the column of about size bytes."""
    buf, offsets = texts_buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, to, split(buf[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], gaps)
        row = to


def chunks(column: pa.Array, overlap: int, size: int = SLICE_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words, int]]:
    """As slices, with the place of the first word in its text: a text over 2 * size bytes comes in chunks of about size
    bytes, cut between words, each of which begins with the last `overlap` words of the one before it. So of a text's
    runs of overlap + 1 words each lies in just one chunk."""
    buf, offsets = texts_buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        if offsets[row + 1] - offsets[row] <= 2 * size:
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
            yield row, to, split(buf[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], gaps), 0
            row = to
            continue
        text, at, base, step = buf[offsets[row] : offsets[row + 1]], 0, 0, size
        while True:
            end = min(at + step, len(text))
            while end < len(text):
                # on to the next gap, so that no word is cut
                found = np.flatnonzero(gaps[text[end : end + 4096]])
                end = end + int(found[0]) if len(found) else min(end + 4096, len(text))
                if len(found):
                    break
            w = split(text[at:end], np.array([0, end - at]), gaps)
            if end < len(text) and len(w.start) <= overlap:
                step *= 2
                continue
            w.ends = end == len(text)
            yield row, row + 1, w, base
            if end == len(text):
                break
            on = len(w.start) - overlap
            base, at, step = base + on, at + int(w.start[on]) if overlap else end, size
        row += 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
