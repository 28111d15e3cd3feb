"""Transcript chunks and their retrieval by cosine distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cosine_distance

TOP_K, CUT = 4, 0.45
#: How a chunk ends, how many words back an end is looked for, and the least words of a last chunk.
SENTENCE_ENDS, SNAP, LEAST = (".", "،", "؟", "!", "؛", "?"), 25, 40


def nearest(chunks: DataFrame, query: list[float], k: int = TOP_K, video_id=None) -> DataFrame:
    """The k chunks (vec_id, video_id, embedding) of least distance, ties by id; within one video where one is given."""
    rows = chunks if video_id is None else chunks.filter(F.col("video_id") == video_id)
    vector = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("vec_id", "video_id", cosine_distance(F.col("embedding"), vector).alias("distance")).orderBy(F.asc_nulls_last("distance"), "vec_id").limit(k)


def relevant(passages: DataFrame, cut: float = CUT) -> DataFrame:
    return passages.filter(F.col("distance") <= cut)


def search_or_siblings(chunks: DataFrame, query: list[float], video_id, siblings: list, k: int = TOP_K, cut: float = CUT) -> DataFrame:
    """Relevant chunks of a video; those of its siblings only where the video has none."""
    own = relevant(nearest(chunks, query, k, video_id), cut)
    rest = relevant(nearest(chunks.filter(F.col("video_id").isin(siblings)), query, k), cut)
    return own.withColumn("fallback", F.lit(False)).unionByName(rest.join(own.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti").withColumn("fallback", F.lit(True)))


def restored(chunks: DataFrame, ids: list[int]) -> DataFrame:
    """Chunks in the order of the cited ids."""
    cited = chunks.sparkSession.createDataFrame([(i, p) for p, i in enumerate(ids)], "vec_id bigint, position int")
    return chunks.join(F.broadcast(cited), "vec_id")


def reuse(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """texts (video_id, text) with the stored embedding of an equal text of the video, and whether one must be made."""
    known = stored.groupBy("video_id", "text").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return texts.join(known, ["video_id", "text"], "left").withColumn("missing", F.col("embedding").isNull())


def ingested(new: DataFrame, stored: DataFrame, made: DataFrame) -> DataFrame:
    """The chunks table after new chunks (video_id, position, text) took the place of all stored ones of their videos: each has
    the stored embedding of an equal text of its video, else the one made for its text (video_id, text, embedding). Chunks of
    other videos stay. Equal texts of a video share an embedding; null texts match none, and lack one unless it was stored."""
    known = reuse(new, stored.withColumnRenamed("position", "vec_id")).drop("missing")
    fresh = made.groupBy("video_id", "text").agg(F.first("embedding").alias("_made"))
    out = known.join(fresh, ["video_id", "text"], "left").withColumn("embedding", F.coalesce("embedding", "_made"))
    rest = stored.join(new.select("video_id").distinct(), "video_id", "left_anti")
    names = ["video_id", "position", "text", "embedding"]
    return rest.select(*names).unionByName(out.select(*names))


def chunk_bounds(words: list[str], size: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges of chunks: each ends at the last sentence end of its last SNAP words (and of its second half) where there
    is one; the next begins `overlap` words before; a last chunk of under LEAST words goes to the one before it."""
    out, start = [], 0
    while start < len(words):
        end = min(start + size, len(words))
        if end < len(words):
            for i in range(end - 1, max(end - SNAP, start + size // 2) - 1, -1):
                if words[i].endswith(SENTENCE_ENDS):
                    end = i + 1
                    break
        out.append((start, end))
        if end >= len(words):
            break
        start = end - overlap
    if len(out) > 1 and out[-1][1] - out[-1][0] < LEAST:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def chunk_texts(blocks: DataFrame, size: int = 120, overlap: int = 25) -> DataFrame:
    """block_id, chunk, text, start_ts, end_ts of blocks (block_id, text, start_ts, end_ts); times by the share of words."""
    if overlap * 2 >= size:
        raise ValueError("overlap must be less than half the size of a chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for block, text, t0, t1 in zip(b["block_id"], b["text"], b["start_ts"], b["end_ts"]):
                words = (text or "").split()
                for k, (i, j) in enumerate(chunk_bounds(words, size, overlap)):
                    at = [t0 + round(max(t1 - t0, 1) * x / len(words)) for x in (i, j)]
                    rows.append((block, k, " ".join(words[i:j]), at[0], max(at[1], at[0] + 1)))
            yield pd.DataFrame(rows, columns=["block_id", "chunk", "text", "start_ts", "end_ts"])

    return blocks.select("block_id", "text", "start_ts", "end_ts").mapInPandas(run, "block_id bigint, chunk int, text string, start_ts bigint, end_ts bigint")
