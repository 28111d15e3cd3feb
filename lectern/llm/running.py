"""Running totals and ranks over a whole table, without one task that holds or sorts all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import unused
from .shared import saved


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """rows with, for each name of sums, the total of its column over this row and all before it in `order`.

    Rows are dealt to ranges of the order and numbered by range; the totals of the ranges (a row for each, at most
    `parts`, the session's shuffle partitions unless given) are added to those within the range. `order` should tell
    rows apart, or equal rows share a range. An empty table gives an empty one."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = unused(rows, "_part")
    held = {k: unused(rows, f"_of_{k}") for k in sums}
    placed = saved(rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()).withColumns({held[k]: v for k, v in sums.items()}), "ranges")
    totals = placed.groupBy(part).agg(*(F.sum(held[k]).alias(held[k]) for k in sums))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(part, *(F.coalesce(F.sum(held[k]).over(before), F.lit(0)).alias(f"{held[k]}_before") for k in sums))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.withColumns({k: F.sum(held[k]).over(within) for k in sums}).join(F.broadcast(totals), part)
    return found.withColumns({k: F.col(k) + F.col(f"{held[k]}_before") for k in sums}).drop(part, *held.values(), *(f"{held[k]}_before" for k in sums))
