"""Token counts by a public tokenizer, as Arrow functions that return lengths only.

Rows are gathered to batches of about `batch_bytes` of text, whatever their number. Texts are cut at safe boundaries (a
space between two characters that aren't white space: no token of the byte-level pattern reaches over it, and no special
token holds one), and each distinct piece of a batch is encoded once; pieces seen before are looked up in a table of at
most `table_size` entries, emptied when full, which keeps no piece over LONGEST characters. So a text of any length adds
pieces, not one long call; only a run without any such space is encoded in one.

Null texts count as empty and have no tokens. Equal rows and extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import texts

BATCH_BYTES, TABLE_SIZE, LONGEST, LIMIT = 1 << 20, 400_000, 48, 1024
_LOOSE = re.compile(r"\s\s|\A\s|\s\Z")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str) -> list[str]:
    """The text cut before safe spaces, which are left out: all but the first piece begin with a space in the text."""
    return _SAFE.split(text) if _LOOSE.search(text) else text.split(" ")


class Counter:
    def __init__(self, path: str, table_size: int = TABLE_SIZE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.table: dict[str, int] = {}
        self.table_size = table_size

    def lengths(self, strings: list[str]) -> list[int]:
        """Tokens of each string, encoded alone: one call for all, and the string that each token comes from."""
        if not strings:
            return []
        owners = self.tokenizer.encode(strings, is_pretokenized=True, add_special_tokens=False).word_ids
        return np.bincount(np.array(owners, dtype=np.int64), minlength=len(strings)).tolist()

    def count(self, batch: list[str]) -> list[int]:
        cut = [pieces(t) for t in batch]
        total = self.lengths([c[0] for c in cut])
        table = self.table
        fresh = {p for c in cut for p in c[1:]} - table.keys()
        long = [p for p in fresh if len(p) > LONGEST]
        fresh.difference_update(long)
        if len(table) + len(fresh) > self.table_size:
            table.clear()
            fresh = {p for c in cut for p in c[1:] if len(p) <= LONGEST}
        short = list(fresh)
        table.update(zip(short, self.lengths([" " + p for p in short]), strict=True))
        if not long:
            return [n + sum(map(table.__getitem__, c[1:])) for n, c in zip(total, cut, strict=True)]
        extra = dict(zip(long, self.lengths([" " + p for p in long]), strict=True))
        return [n + sum(extra[p] if len(p) > LONGEST else table[p] for p in c[1:]) for n, c in zip(total, cut, strict=True)]


def by_bytes(values: list[str], sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(values):
        yield first, len(values)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of each row of docs."""
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path)
        for b in batches:
            values = b.column("text").to_pylist()
            sizes = pc.binary_length(b.column("text")).to_pylist()
            tokens: list[int] = []
            for i, j in by_bytes(values, sizes, batch_bytes):
                tokens += counter.count(values[i:j])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).select("doc_id", "text").mapInArrow(count, SCHEMA)
