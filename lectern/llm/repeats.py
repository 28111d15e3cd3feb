"""Passages that several documents share: what the two substring operators have in common.

A window is `length` consecutive words of one document. An operator finds places that may lie in repeated windows (its
hits: of each document the words `at`, and how many words `back` from there a window may start). `repeated` brings the
hits to their texts and tells windows apart by 96 bits of a cryptographic hash (BLAKE2b) of the words themselves, joined
by one space; so no pair of different windows is taken for equal (with 10**13 windows, by a chance of one in a thousand).

A task remembers the least document in which it met a window: a window met again in a greater one is decided there and
then, and of all others one row for each task and document goes on. So a window that a third of all rows share costs a
row for each task. `cut` takes the words of repeated windows out of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import texts

LENGTH, DIGEST, REMEMBERED = 50, 12, 1 << 19


def by_text(hits: DataFrame) -> DataFrame:
    """One row (ord, row_key, at, back) of the hits of each text. Equal rows send equal hits, which count once, so the arrays grow
    with the text and not with its copies."""
    both = hits.groupBy("ord", "row_key").agg(F.collect_set(F.struct("at", "back")).alias("x"))
    return both.select("ord", "row_key", F.flatten(F.transform("x", lambda v: v["at"])).alias("at"), F.flatten(F.transform("x", lambda v: v["back"])).alias("back"))


def body_of(text: str) -> tuple[bytes, np.ndarray]:
    """The words of a text joined by one space, and where each begins (one place more: where a next one would)."""
    body = b" ".join(text.encode().split())
    if not body:
        return body, np.zeros(1, dtype=np.int64)
    gaps = np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 32)
    return body, np.concatenate([[0], gaps + 1, [len(body) + 1]])


def repeated(docs: DataFrame, hits: DataFrame, length: int = LENGTH, remembered: int = REMEMBERED) -> DataFrame:
    """ord, row_key and starts (places of the windows that also start in a document of a smaller ord)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}
        for b in batches:
            code, owner, key, ats = [], [], [], []
            for order, row_key, text, at, back in zip(*(b.column(c).to_pylist() for c in ("ord", "row_key", "text", "at", "back")), strict=True):
                body, begin = body_of(text)
                last = len(begin) - 1 - length
                if last < 0:
                    continue
                at, back = np.array(at, dtype=np.int64), np.array(back, dtype=np.int64)
                marks = np.zeros(last + 2, dtype=np.int64)
                np.add.at(marks, np.clip(at - back, 0, last + 1), 1)
                np.add.at(marks, np.clip(at + 1, 0, last + 1), -1)
                windows = np.flatnonzero(np.cumsum(marks)[:-1])
                if len(first) > remembered:
                    first.clear()
                decided: list[int] = []
                mine: dict[bytes, list[int]] = {}
                for s, i, j in zip(windows.tolist(), begin[windows].tolist(), (begin[windows + length] - 1).tolist(), strict=True):
                    code_ = hashlib.blake2b(body[i:j], digest_size=DIGEST).digest()
                    before = first.get(code_)
                    if before is not None and before < order:
                        decided.append(s)
                    elif before == order and code_ in mine:
                        mine[code_].append(s)
                    else:
                        first[code_] = order
                        mine[code_] = [s]
                code += mine
                ats += mine.values()
                if decided:
                    code.append(None)
                    ats.append(decided)
                n = len(mine) + bool(decided)
                owner += [order] * n
                key += [row_key] * n
            # a decided row has a code of its own, so that it can go with the others
            halves = np.array([int.from_bytes(c[:8], "little", signed=True) if c else hash((k, o)) for c, k, o in zip(code, key, owner)], dtype=np.int64)
            rest = [int.from_bytes(c[8:], "little", signed=True) if c else None for c in code]
            yield pa.RecordBatch.from_arrays([pa.array(halves), pa.array(rest, pa.int32()), pa.array(owner, pa.int64()), pa.array(key, pa.int64()), pa.array(ats, pa.list_(pa.int32()))], names=["code", "rest", "ord", "row_key", "at"])

    found = texts(docs).join(by_text(hits), ["ord", "row_key"]).select("doc_id", "ord", "row_key", "text", "at", "back")
    rows = found.mapInArrow(run, "code bigint, rest int, ord bigint, row_key bigint, at array<int>")
    least = F.min("ord").over(Window.partitionBy("code", "rest"))
    later = rows.withColumn("least", least).filter(F.col("rest").isNull() | (F.col("ord") > F.col("least")))
    # equal rows find the same windows at the same places
    return later.groupBy("ord", "row_key").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("starts"))


def cut(docs: DataFrame, starts: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (start:end of the words removed, comma-joined) and kept_text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, spans, kept_text = [], [], [], [], []
            for text, at in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = text.encode().split()
                n.append(len(words))
                found: list[list[int]] = []
                for s in sorted(at or ()):
                    if found and s <= found[-1][1]:
                        found[-1][1] = s + length
                    else:
                        found.append([s, s + length])
                kept, last = [], 0
                for s, e in found:
                    kept += words[last:s]
                    last = e
                kept = b" ".join(kept + words[last:] if found else words)
                gone.append(sum(e - s for s, e in found))
                sha.append(hashlib.sha256(kept).hexdigest())
                spans.append(",".join(f"{s}:{e}" for s, e in found))
                kept_text.append(kept.decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    both = texts(docs).join(starts, ["ord", "row_key"], "left").select("doc_id", "ord", "row_key", "text", "starts")
    return both.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans string, kept_text string")
