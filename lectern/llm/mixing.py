"""Mixing sources to target weights by hash-threshold histograms.

Every row has a size in words and a fixed hash. A source's target is its share of `share` times all words by weight, but
at most `repeats` times its words; what is cut is shared again by weight until none is above. A source takes each row
floor(target / words) times, and once more the rows whose hash lies below a threshold: the words by source and bucket of
the hash are summed, running totals over the buckets give the bucket in which the rest of the target falls, and only
that bucket's rows are cut into finer buckets, until it holds one row. That row is taken if this comes closer to the
target, so a source misses it by half of one row's words at most. No rows are sorted; the filter is a comparison. All
of it is DataFrame functions.

Cases: a null text has no words and is never taken; a null source is a source of its own and ranks last; the hash is
that of the id and the size, so that rows of equal ids are all-or-nothing only where a bucket says so: rows of equal
hashes, and with them any number of equal rows, are told apart by the number of the row in the written table, and as
they agree in id and size the results of reruns agree. An empty table gives an empty one, sources without words have a
target of zero, extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running
from .shared import saved

WEIGHTS, SHARE, REPEATS, SEED = (5, 2, 1), (3, 2), 2, "mix"
#: Bits of the hash and of the row's number, and how many a level of the histogram looks at.
BITS, LEVEL = 60, 10
#: A table of sources with more rows than this is joined by a shuffle.
BROADCAST_ROWS = 100_000
_GAPS = "\\x20\\x09-\\x0D"


def n_words(text: Column) -> Column:
    """Runs of characters other than white space. One letter stands for each, so no list of words is made."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[^{_GAPS}]+[{_GAPS}]*", "x")
    return F.length(F.regexp_replace(marks, f"^[{_GAPS}]+", "")).cast("bigint")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, named and name (the source and whether there is one), size, hash and row (its number) of each row; written once."""
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), F.col("source").isNotNull().alias("named"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), n_words(F.col("text")).alias("size"))
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    hashed = F.conv(F.substring(F.sha2(key, 256), 1, BITS // 4), 16, 10).cast("bigint")
    return saved(rows.withColumns({"hash": hashed, "row": F.monotonically_increasing_id()}), "sized")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS) -> DataFrame:
    """named, name, source_size and target of each source. share is a ratio (numerator, denominator) below repeats.

    In the order of words by weight, the sources that stop at their most come first: a source does if its share of what
    those before it leave is no less. So one pass of running totals stands for the rounds of sharing again."""
    up, down = share
    sums = rows.groupBy("named", "name").agg(F.sum("size").alias("source_size"))
    ranked = running(sums, [F.col("named").desc(), F.col("name")], {"place": F.lit(1)})
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint"))
    exact = "decimal(38,0)"
    order = [F.col("source_size") / F.col("weight"), F.col("named"), F.col("name")]
    found = running(weighed.drop("place"), order, {"sizes_to": F.col("source_size"), "weights_to": F.col("weight")})
    whole = found.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    found = found.crossJoin(F.broadcast(whole))  # one row
    left = (up * F.col("all_sizes") - down * repeats * (F.col("sizes_to") - F.col("source_size"))).cast(exact)
    stops = left * F.col("weight").cast(exact) >= (down * repeats * F.col("source_size")).cast(exact) * (F.col("all_weights") - F.col("weights_to") + F.col("weight")).cast(exact)
    found = saved(found.withColumn("stops", stops), "stops")
    free = found.agg(F.coalesce(F.max("all_sizes"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("stops"), F.col("source_size"))), F.lit(0)).alias("stopped"), F.sum(F.when(~F.col("stops"), F.col("weight"))).alias("shared"))
    found = found.select("named", "name", "source_size", "weight", "stops").crossJoin(F.broadcast(free))
    split = (F.col("weight") * (up * F.col("all") - down * repeats * F.col("stopped"))).cast("double") / (down * F.col("shared")).cast("double")
    return found.select("named", "name", "source_size", F.when(F.col("stops"), (F.col("source_size") * repeats).cast("double")).otherwise(split).alias("target"))


def _with(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, ["named", "name"])


def thresholds(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """sources with times (whole copies of each row), hash_to and row_to: rows that lie before (hash_to, row_to) are taken
    once more."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = sources.withColumn("times", times).withColumns({"rest": F.col("target") - F.col("times") * F.col("source_size"), "hash_to": F.lit(0).cast("bigint"), "row_to": F.lit(0).cast("bigint")})
    state = saved(state.withColumn("open", F.col("rest") > 0), "thresholds")
    live = rows.select("named", "name", "size", "hash", "row").filter(F.col("size") > 0)
    levels = [("hash", BITS - LEVEL * (i + 1)) for i in range(BITS // LEVEL)] + [("row", max(0, 63 - LEVEL * (i + 1))) for i in range(-(-63 // LEVEL))]
    for column, shift in levels:
        wide = 1 << shift
        live = _with(live, state.filter("open").select("named", "name", "hash_to", "row_to"), few)
        # the rows of the boundary bucket of the level before: hash_to and row_to are its lower edge
        before = [(c, s) for c, s in levels[: levels.index((column, shift))]][-1:]
        for c, s in before:
            live = live.filter((F.shiftright(F.col(c), s) == F.shiftright(F.col(f"{c}_to"), s)) & ((F.col("hash") == F.col("hash_to")) if c == "row" else F.lit(True)))
        live = live.select("named", "name", "size", "hash", "row")
        if before:
            live = saved(live, "boundary")
        histogram = live.groupBy("named", "name", F.shiftright(F.col(column), shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        up_to = Window.partitionBy("named", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = histogram.withColumn("up_to", F.sum("words").over(up_to))
        edge = _with(totals, state.filter("open").select("named", "name", "rest"), few)
        edge = edge.filter((F.col("up_to") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("up_to")))
        edge = edge.select("named", "name", "bucket", "words", "rows", (F.col("up_to") - F.col("words")).alias("below"))
        state = state.join(F.broadcast(edge) if few else edge, ["named", "name"], "left")
        hit = F.col("bucket").isNotNull()
        done = hit & (F.col("rows") == 1)
        taken = done & (2 * (F.col("rest") - F.col("below")) > F.col("words"))
        at = F.col("bucket") * wide
        on = F.when(hit, at + F.when(taken, wide).otherwise(0))
        state = state.withColumns({f"{column}_to": F.coalesce(on, F.col(f"{column}_to")), "rest": F.col("rest") - F.coalesce("below", F.lit(0)), "open": F.col("open") & hit & ~done})
        state = saved(state.drop("bucket", "words", "rows", "below"), "thresholds")
        if state.filter("open").isEmpty():
            break
    return state


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words that the mix takes of the row) for each row of docs."""
    rows = sized(docs, seed)
    sources = saved(targets(rows, weights, share, repeats), "sources")
    few = sources.count() <= BROADCAST_ROWS
    edges = thresholds(rows, sources, few)
    found = _with(rows, edges.select("named", "name", "source_size", "target", "times", "hash_to", "row_to"), few)
    extra = (F.col("hash") < F.col("hash_to")) | ((F.col("hash") == F.col("hash_to")) & (F.col("row") < F.col("row_to")))
    taken = F.col("size") * (F.col("times") + extra.cast("bigint"))
    return found.select("doc_id", "size", F.when(F.col("named"), F.col("name")).alias("source"), "source_size", "target", taken.alias("taken"))
