"""Chat memory: turns, budgets of tokens and what is to be summarised. Messages: conv_id, turn, role, text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import token_estimate

#: Tokens that a message and a passage take besides their own.
MESSAGE, PASSAGE = 4, 16


def turns(messages: DataFrame) -> DataFrame:
    """Turns: a user's message and the first answer after it (NULL where there is none yet); answers without a user before
    them, and further ones, are left out. tokens: each message's and 4 more. Null texts count one token; equal places of a
    conversation are taken in any order; an empty table gives no rows."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    x = messages.filter(F.col("role").isin("user", "assistant")).withColumn("_pair", F.sum((F.col("role") == "user").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    out = x.filter("_pair > 0").groupBy("conv_id", F.col("_pair").alias("pair")).agg(F.min(F.when(user, F.col("turn"))).alias("user_turn"), F.min(F.when(reply, F.col("turn"))).alias("assistant_turn"), F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("question"), F.min_by(F.when(reply, F.col("text")), F.when(reply, F.col("turn"))).alias("answer"))
    replied = F.when(F.col("assistant_turn").isNotNull(), token_estimate(F.col("answer")) + MESSAGE).otherwise(0)
    return out.withColumn("tokens", token_estimate(F.col("question")) + MESSAGE + replied)


def recent_turns(pairs: DataFrame, budget: int) -> DataFrame:
    """The newest turns whose tokens together stay within the budget: the first that doesn't fit ends the selection."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("pair")).rowsBetween(Window.unboundedPreceding, 0)
    return pairs.withColumn("used", F.sum("tokens").over(newest)).filter(F.col("used") <= budget)


def packed(passages: DataFrame, budget: int) -> DataFrame:
    """Passages (key, rank, chunk_id, tokens) taken in order of rank while they fit, 16 tokens more for each: one that
    doesn't fit, or whose chunk was taken, is passed over. A key's passages are those of one question; the fold over them
    keeps a sum and the chunks taken, which the budget bounds. Equal ranks go by chunk; null chunks are one chunk."""

    ordered = passages.select("key", "rank", "chunk_id", "tokens").repartition("key").sortWithinPartitions("key", "rank", "chunk_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, left, seen = None, budget, set()
        for b in batches:
            take = []
            for k, c, n in zip(b["key"], b["chunk_id"], b["tokens"]):
                if k != key:
                    key, left, seen = k, budget, set()
                take.append(c not in seen and n + PASSAGE <= left)
                if take[-1]:
                    left -= n + PASSAGE
                    seen.add(c)
            yield b[take]

    return ordered.mapInPandas(fold, "key bigint, rank bigint, chunk_id bigint, tokens bigint")


def to_summarise(messages: DataFrame, threshold: int, keep: int = 4, checkpoints: DataFrame | None = None) -> DataFrame:
    """Messages after a conversation's checkpoint (conv_id, checkpoint: a turn; none: from the start) and before its last
    `keep`, where they have `threshold` tokens or more, 4 for each message counted besides its own."""
    if checkpoints is not None:
        known = checkpoints.groupBy("conv_id").agg(F.max("checkpoint").alias("_from"))
        messages = messages.join(known, "conv_id", "left").filter(F.col("_from").isNull() | (F.col("turn") > F.col("_from"))).drop("_from")
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    old = messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") > keep).withColumn("tokens", token_estimate(F.col("text")))
    return old.withColumn("_all", F.sum(F.col("tokens") + MESSAGE).over(Window.partitionBy("conv_id"))).filter(F.col("_all") >= threshold).drop("_n", "_all")
