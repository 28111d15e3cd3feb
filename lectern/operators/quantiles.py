"""Exact quantiles of any number of groups, where no group is sorted or held by one task.

A quantile lies between two order statistics. The interval that holds one is cut into bins; Spark counts the rows of each
bin, partly before the shuffle, and the running count tells the bin to go on with, from its own least to its own greatest
value. Only when a bin holds few values are they brought together. Equal values are counted before anything else, so what is
shuffled are counts, and a hot group of any size costs some more rounds over its own values. Rounds divide the values and their logarithms in turn, which
copes with values over many orders of magnitude; every round parts the least from the greatest value, so it ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rounded_exactly
from ..stored import stored

#: Bins of a round, and the different values of a bin that are put in order by one task.
BINS, SMALL = 512, 2048


def _spread(x: Column, by_size: bool) -> Column:
    """A function of x that never falls."""
    return F.signum(x) * F.log1p(F.abs(x) * 1e6) if by_size else x


def order_statistics(counted: DataFrame, keys: list[str], ranks: DataFrame, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """keys, rank and value: the value of that rank (from 0 in ascending order) among the rows of keys. counted: keys, value (a
    double without nulls or NaN) and n, its number of rows; ranks: keys and rank, below the rows of keys. The state of each
    round is stored; counted is read in each, so it should be a stored table."""
    ends = counted.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("inside"))
    state = stored(ranks.select(*keys, "rank").distinct().join(ends, keys).withColumn("below", F.lit(0).cast("bigint")), "ranks")
    large = (F.col("inside") > small) & (F.col("low") < F.col("high"))
    by_size = False
    while not state.filter(large).isEmpty():
        live = counted.join(state.filter(large).select(*keys, "rank", "low", "high"), keys).filter(F.col("value").between(F.col("low"), F.col("high")))
        at, low, high = (_spread(F.col(c), by_size) for c in ("value", "low", "high"))
        # the ends fall into the first and the last bin whatever the rounding
        bin_ = F.when(F.col("value") == F.col("low"), 0).when(F.col("value") == F.col("high"), bins - 1).otherwise(F.least(F.floor(F.coalesce(F.try_divide(at - low, high - low), F.lit(0.0)) * bins), F.lit(bins - 1)))
        counts = live.groupBy(*keys, "rank", bin_.alias("bin")).agg(F.sum("n").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high"), F.count(F.lit(1)).alias("_values"))
        hit = _hit(state.select(*keys, "rank", "below").join(counts, [*keys, "rank"]), keys, "bin")  # a row for each bin at most
        moved = hit.select(*keys, "rank", F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_values").alias("inside"), (F.col("below") + F.col("_to") - F.col("_n")).alias("below"))
        state = stored(moved.unionByName(state.filter(~large)), "ranks")
        by_size = not by_size
    few = state.filter("low < high").select(*keys, "rank", "low", "high", "below")
    last = counted.join(few, keys).filter(F.col("value").between(F.col("low"), F.col("high"))).withColumnRenamed("n", "_n")
    return _hit(last, keys, "value").select(*keys, "rank", "value").unionByName(state.filter("low = high").select(*keys, "rank", F.col("low").alias("value")))


def _hit(counts: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of counts (keys, rank, below, by, _n) in order of `by`, the row of each rank in which its place lies."""
    order = Window.partitionBy(*keys, "rank").orderBy(by)
    counts = counts.withColumn("_to", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return counts.filter((F.col("below") + F.col("_to") - F.col("_n") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("_to")))


def quantiles(rows: DataFrame, keys: list[str], probs: list[float], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """keys, n, mean and quantiles (an array, one for each of probs, interpolated between neighbours) of value over keys. Null and
    NaN values don't count; keys without a value have no row. Rows are read once; equal values of keys are one row from then on."""
    known = rows.select(*keys, F.col("value").cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    counted = stored(known.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")), "values")
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    places = sizes.select(*keys, "n", "mean", F.posexplode(F.array(*map(F.lit, probs))).alias("_i", "_p")).withColumn("_at", (F.col("n") - 1) * F.col("_p"))
    places = places.withColumns({"_lo": F.floor("_at"), "_hi": F.ceil("_at")})
    ranks = places.select(*keys, F.explode(F.array("_lo", "_hi")).alias("rank"))
    found = order_statistics(counted, keys, ranks, bins, small)
    named = lambda rank, value: found.select(*keys, F.col("rank").alias(rank), F.col("value").alias(value))
    out = places.join(named("_lo", "_a"), [*keys, "_lo"]).join(named("_hi", "_b"), [*keys, "_hi"])
    out = out.withColumn("_q", F.when(F.col("_lo") == F.col("_hi"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_lo"))))
    return out.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("quantiles"))


def bundle(rows: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """keys, n, mean, p25, median and p75 of value / scale, to one place."""
    out = quantiles(rows.withColumn("value", F.col("value").cast("double") / scale), keys, [0.25, 0.5, 0.75])
    return out.select(*keys, "n", rounded_exactly(F.col("mean")).alias("mean"), *[rounded_exactly(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("p25", "median", "p75"))])
