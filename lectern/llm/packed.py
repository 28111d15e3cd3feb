"""Items of texts (a hash each, and what goes with it) sent to the tasks that own a range of the hashes, and back.

A row for each item would cost several times the item. So a task gathers the items of many texts to a flush of about
FLUSH items and sends each owner one row: the items' columns as bytes, in the order of the texts. The rest of a flush, the
list of its texts, travels as one row of its own beside them. An owner's answer names a flush and places in it; `answers`
brings the answers of a flush together with its list. Owners are as many as the bytes of text divided by OWNER_BYTES (at
least LEAST_OWNERS), so what an owner holds doesn't grow with the input.

A flush is told by the task's partition and a number, so a task that is run again must read the same rows in the same
order, as it does from a stored table. A row holds FLUSH / owners items: from about 2**18 owners on (4 TB of text), raise
OWNER_BYTES with the executors' memory (an owner takes about 30 times its items), lest rows hold few items each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH, OWNER_BYTES, LEAST_OWNERS = 1 << 21, 16 << 20, 8


def n_owners(docs: DataFrame, owner_bytes: int = OWNER_BYTES) -> int:
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(1 << 24, max(LEAST_OWNERS, n_bytes // owner_bytes))


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    return (((hashes >> np.uint64(40)) * np.uint64(owners)) >> np.uint64(24)).astype(np.int32)


def planes(x: np.ndarray, width: int | None = None) -> bytes:
    """The low `width` bytes of numbers, all first bytes, then all second ones: bytes that vary little lie together."""
    octets = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)
    return octets[:, : width or x.dtype.itemsize].T.tobytes()


def numbers(data, width: int, dtype=np.uint32) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], np.dtype(dtype).itemsize), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.view(dtype)[:, 0]


def places(order: np.ndarray) -> bytes:
    """Ascending places in a flush, as steps."""
    return planes(np.diff(order, prepend=0).astype(np.uint32))


def placed(data) -> np.ndarray:
    return np.cumsum(numbers(data, 4).astype(np.int64))


@dataclass
class Flush:
    """What a task has gathered: columns of the items, and for each text (or chunk of one) its first item and own values."""

    held: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    size: int = 0

    def add(self, items: tuple, first: np.ndarray, own: tuple) -> None:
        """items: columns of equal length; first: of each text, its first item; own: columns with a value for each text."""
        self.held.append(items)
        self.texts.append((first + self.size, *own))
        self.size += len(items[0])

    def taken(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        items, texts = [np.concatenate(c) for c in zip(*self.held)], [np.concatenate(c) for c in zip(*self.texts)]
        self.held, self.texts, self.size = [], [], 0
        return items, texts


def dealt(owner: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, places of its items in ascending order)."""
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(owners + 1))
    for o in np.flatnonzero(np.diff(cuts)):
        yield int(o), order[cuts[o] : cuts[o + 1]]


def text_of(first: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of places in a flush, the number of the text that they belong to."""
    return np.searchsorted(first, place, side="right") - 1
