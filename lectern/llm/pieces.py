"""SentencePiece encoding and decoding with a public vocabulary, by an Aho-Corasick automaton and one Viterbi pass.

The automaton holds every piece. It reads a text once; at each position its output links give all pieces that end there,
and each relaxes the best score of the position. The encoding is the segmentation of the greatest sum of piece scores
(of equal sums the one whose last differing piece is longer). A character without a piece of its own is spelled by byte
pieces at a cost below that of any piece. Text is read as in the vocabulary: one space is put before a text that isn't
empty, and spaces are written as U+2581 in pieces; a U+2581 of the text itself is spelled in bytes. So decoding gives
back every text exactly.

No piece reaches from other characters over to a following space, so the best segmentation of a text is that of its
units (spaces and what follows them up to the next); a unit met before is looked up in a table of at most TABLE entries,
emptied when full. Units over LONGEST characters aren't kept, so the table is bounded in bytes.

Null texts count as empty and have no pieces; equal rows give equal results; extra columns don't matter; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

TABLE, LONGEST, MARK = 300_000, 48, "▁"
SCHEMA = "doc_id bigint, n_pieces bigint, ids array<int>, ids_sha256 string, round_trip boolean"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str, table: int = TABLE):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.bytes: list[int] = [-1] * 256
        self.spelled: list[bytes] = [b""] * size
        pieces, scores = [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value], self.spelled[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace(MARK, " ")
                self.automaton.add_word(piece, (len(piece), model.get_score(i), i))
                self.spelled[i] = piece.encode()
                pieces.append(piece)
                scores.append(model.get_score(i))
        self.automaton.make_automaton()
        if min(self.bytes) < 0:
            raise ValueError("the vocabulary has no byte pieces, so not every text can be encoded")
        self.single = {p for p in pieces if len(p) == 1}
        self.cost = min(scores) - 10
        # a unit ends before a space that follows another character, if no piece reaches over that place
        inner = any(re.search(r"[^ ] ", p) for p in pieces)
        lines = any("\n" in p and len(p) > 1 for p in pieces)
        self.units = re.compile(r"(?s).+" if inner else r" +[^ ]*|[^ ]+" if lines else r" +[^ \n]*|[^ \n]+|\n").findall
        self.table: dict[str, bytes] = {}
        self.most = table
        self.mark = self.pack([self.bytes[b] for b in MARK.encode()])

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype=np.int32).tobytes()

    def best(self, unit: str) -> list[int]:
        n = len(unit)
        score = [0.0] + [-1e300] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        lone = [] if self.single.issuperset(unit) else [i + 1 for i, c in enumerate(unit) if c not in self.single]
        upto = 0
        for end, (length, gain, i) in self.automaton.iter(unit):
            end += 1
            while upto < len(lone) and lone[upto] < end:
                self._spell(score, back, lone[upto])
                upto += 1
            now = score[end - length] + gain
            if now > score[end]:
                score[end] = now
                back[end] = (length, i)
        for end in lone[upto:]:
            self._spell(score, back, end)
        out: list[int] = []
        while n:
            length, i = back[n]
            if i < 0:
                out += [self.bytes[b] for b in reversed(unit[n - 1].encode())]
            else:
                out.append(i)
            n -= length
        return out[::-1]

    def _spell(self, score: list[float], back: list[tuple[int, int]], end: int) -> None:
        now = score[end - 1] + self.cost
        if now > score[end]:
            score[end] = now
            back[end] = (1, -1)

    def _encode(self, text: str) -> bytes:
        table = self.table
        units = self.units(text)
        missing = set(units).difference(table)
        long = {u: self.pack(self.best(u)) for u in missing if len(u) > LONGEST}
        missing.difference_update(long)
        if missing:
            if len(table) + len(missing) > self.most:
                table.clear()
                missing = {u for u in units if len(u) <= LONGEST}
            for u in missing:
                table[u] = self.pack(self.best(u))
        if long:
            return b"".join(long[u] if len(u) > LONGEST else table[u] for u in units)
        return b"".join(map(table.__getitem__, units))

    def encode(self, text: str) -> np.ndarray:
        """Ids of the pieces of a text."""
        if not text:
            return np.empty(0, dtype=np.int32)
        return np.frombuffer(self.mark.join(self._encode(p) for p in (" " + text).split(MARK)), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text that has these ids."""
        return b"".join(map(self.spelled.__getitem__, ids))[1:].decode(errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, ids_sha256 (of the ids as 32-bit little-endian) and round_trip (the ids decode to the text)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                values = part.column("text").to_pylist()
                ids = [own.encode(t) for t in values]
                sizes = [len(x) for x in ids]
                same = [own.decode(x.tolist()) == t for x, t in zip(ids, values, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate(ids)))
                sha = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(sha), pa.array(same)], names=["doc_id", "n_pieces", "ids", "ids_sha256", "round_trip"])

    return texts(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def with_ids(docs: DataFrame, path: str | None = None, column: str = "piece_ids") -> DataFrame:
    """docs with one more column of ids; a column of that name is replaced."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        own = codec(path)
        return text.fillna("").map(own.encode)

    return docs.withColumn(column, ids(F.col("text").cast("string")))


def decode(encoded: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """encoded with one more column, decoded_text; null ids give an empty text."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = codec(path)
        return ids.map(lambda x: "" if x is None else own.decode(x))

    return encoded.withColumn("decoded_text", text(column))
