"""Spans (start, end): union, gaps and overlaps, with window functions over each key. Spans with a null or an end that is
not past the start are left out; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(spans: DataFrame, keys: list[str], join_gap: float = 1.0) -> DataFrame:
    """keys, start, end and n (spans joined) of the union; spans at most join_gap apart become one."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = spans.filter(F.col("end") > F.col("start")).withColumn("_reach", F.max("end").over(before))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("start") <= F.col("_reach") + join_gap, 0).otherwise(1)).over(upto))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def covered_seconds(spans: DataFrame, keys: list[str], join_gap: float = 1.0) -> DataFrame:
    return merge_spans(spans, keys, join_gap).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def missing_spans(spans: DataFrame, durations: DataFrame, keys: list[str], min_length: float = 30.0) -> DataFrame:
    """keys, start, end of what no span covers between 0 and the duration; keys of an unknown duration give nothing."""
    known = durations.filter("duration > 0").select(*keys, "duration")
    merged = merge_spans(spans, keys).join(known, keys).select(*keys, F.least("start", "duration").alias("start"), F.least("end", "duration").alias("end"))
    edges = merged.unionByName(known.select(*keys, F.col("duration").alias("start"), F.col("duration").alias("end")))
    order = Window.partitionBy(*keys).orderBy("start", "end")
    gaps = edges.select(*keys, F.lag("end", 1, 0.0).over(order).alias("_from"), F.col("start").alias("_to"))
    return gaps.filter(F.col("_to") - F.col("_from") >= min_length).select(*keys, F.col("_from").alias("start"), F.col("_to").alias("end"))


def repeated_spans(spans: DataFrame, keys: list[str], min_length: float = 1.0) -> DataFrame:
    """keys, start, end of stretches that two spans or more cover; touching spans don't overlap."""
    real = spans.filter(F.col("end") > F.col("start"))
    edges = real.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("change")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("change")))).alias("e")).select(*keys, "e.at", "e.change")
    # edges of one place are added up first, so spans that only touch leave the depth as it is
    net = edges.groupBy(*keys, "at").agg(F.sum("change").alias("change"))
    order = Window.partitionBy(*keys).orderBy("at")
    depth = F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))
    deep = net.select(*keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), depth.alias("_depth")).filter("_depth >= 2")
    return merge_spans(deep.drop("_depth"), keys, 0.0).filter(F.col("end") - F.col("start") >= min_length).drop("n")


def segments(passages: DataFrame, merge_gap: float = 20.0, lead_in: float = 3.0) -> DataFrame:
    """Passages (video_id, start, end, distance) joined within a video; the least distance stays, the start moves ahead."""
    order = Window.partitionBy("video_id").orderBy("start", "end", "distance")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = passages.withColumn("_new", F.when(F.col("start") <= reach + merge_gap, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("video_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("distance").alias("distance"), F.count(F.lit(1)).alias("n"))
    return out.select("video_id", F.greatest(F.col("start") - lead_in, F.lit(0.0)).alias("start"), "end", "distance", "n")
