"""Connected components of a graph given as links, by alternating large and small stars over DataFrames.

Every round is a grouped minimum and a join on the node, so no node's links meet in one task or on the driver; the links
are written to the shared folder after each round, and the rounds (of the order of the logarithm of a component's size)
end when the table of links no longer changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes as the links (a, b), one for each node that isn't a root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        fresh = label.copy()
        np.minimum.at(fresh, label[x], low)
        np.minimum.at(fresh, label[y], low)
        while True:
            deeper = fresh[fresh]
            if (deeper == fresh).all():
                break
            fresh = deeper
        if (fresh == label).all():
            break
        label = fresh
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link, from links (a, b) of one orderable type; root: the least node reachable."""
    links = saved(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter(F.col("u") != F.col("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = saved(small.filter(F.col("u") != F.col("v")).distinct(), "stars")
        now = state(links)
        if now == before:
            break
        before = now
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
