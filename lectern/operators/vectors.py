"""Nearest vectors by cosine distance through a partitioned index, exact, for many questions at once.

The index deals every vector (scaled to length one) to the cell of its nearest centre; a cell knows the least and the
greatest distance of its members from the centre, and is cut into blocks of about BLOCK rows by a hash of the id. Distances
between unit vectors as chords obey the triangle inequality, so a question's distance from a centre bounds its distance
from all members. A search first looks where the nearest cells lie that hold enough rows; the k-th distance found there names
all cells that may hold something as near, and only where they lie is looked. So the result is that of a full scan. What is
looked into at once is a bundle: blocks of cells whose centres are near each other, BUNDLE_BYTES of vectors. A task compares one
bundle with as many questions at most and hands on k rows a question, so a question and its finds are shuffled once
for each bundle, not for each cell or block.

Centres are rows of a bounded sample (at most CENTRE_BYTES as floats, so they can go to every task) moved by a few rounds
of means; they decide only how much is looked into, never what is found.

Cases: null vectors, vectors of another length than `dims` (by default the longest), of length zero or with a null, NaN or infinite
part are in no result, and questions of that kind have none. Equal distances (to 12 places) go by id. Fewer rows than k give
what there is; an empty index or no questions give no rows; repeated ids are rows of their own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, BUNDLE_BYTES, CENTRE_BYTES, ROUNDS = 4096, 16 << 20, 64 << 20, 3
#: Added to bounds for the sake of rounding.
SLACK = 1e-9


def _unit(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as rows of length one, and which of them are vectors at all."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out, ok = np.zeros((len(column), dims)), np.zeros(len(column), bool)
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(sizes == dims)
    if len(whole) and dims:
        flat = pc.fill_null(column.take(pa.array(whole)).flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(whole), dims)
        norm = np.linalg.norm(flat, axis=1)
        good = np.isfinite(flat).all(axis=1) & (norm > 0) & np.isfinite(norm)
        out[whole[good]] = flat[good] / norm[good, None]
        ok[whole[good]] = True
    return out, ok


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _centres(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    centres = sample[:n].copy()
    for _ in range(rounds if len(sample) > n else 0):
        of = np.concatenate([(sample[i : i + 1024] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


@dataclass
class Index:
    """rows: vec_id, video_id, embedding, cell and block. Of each cell: centre, least and greatest chord, rows and blocks."""

    rows: DataFrame
    dims: int
    centres: np.ndarray
    near: np.ndarray
    far: np.ndarray
    sizes: np.ndarray
    block: int

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.sizes // self.block)


def build(chunks: DataFrame, path: str | None = None, dims: int | None = None, cells: int | None = None, block: int = BLOCK) -> Index:
    """The index of chunks (vec_id, video_id, embedding); its rows are written to `path` in the order of cells, or else held where
    executors spill to disk. cells: about the root of the number of rows unless given."""
    spark = chunks.sparkSession
    given = chunks.select("vec_id", "video_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    count, longest = given.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    dims = dims or longest or 0
    most = max(1, CENTRE_BYTES // (4 * max(1, dims)))
    n = max(1, min(cells or int(np.ceil(np.sqrt(count))), most, count or 1))
    # a bounded sample by a hash of the id: the same rows in every run
    drawn = given.filter(F.size("embedding") == dims).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(min(most, 16 * n)).select("embedding")
    sample, ok = _unit(pa.array([r.embedding for r in drawn.collect()], pa.list_(pa.float64())), dims)
    sample = sample[ok]
    n = max(1, min(n, len(sample)))
    centres = _centres(sample, n) if len(sample) else np.zeros((1, dims))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                v, good = _unit(part.column("embedding"), dims)
                chord = _chords(v, shared.value)
                cell = chord.argmin(axis=1).astype(np.int32)
                columns = [*part.columns, pa.array(cell), pa.array(chord[np.arange(len(v)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "cell", "chord"]).filter(pa.array(good))

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    dealt = given.mapInArrow(assign, f"vec_id {kinds['vec_id']}, video_id {kinds['video_id']}, embedding array<double>, cell int, chord double")
    if path:
        dealt.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell").write.mode("overwrite").parquet(path)
        dealt = spark.read.schema(dealt.schema).parquet(path)
    else:
        dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    near, far, sizes = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    for r in dealt.groupBy("cell").agg(F.min("chord"), F.max("chord"), F.count(F.lit(1))).collect():  # a row for each cell
        near[r[0]], far[r[0]], sizes[r[0]] = r[1], r[2], r[3]
    blocks = F.element_at(F.array(*[F.lit(int(x)) for x in -(-np.maximum(sizes, 1) // block)]), F.col("cell") + 1) if n <= 64 else None
    if blocks is None:
        table = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(-(-np.maximum(sizes, 1) // block))], "cell int, _blocks bigint")
        dealt = dealt.join(F.broadcast(table), "cell")  # a row for each cell
        blocks = F.col("_blocks")
    rows = dealt.select("vec_id", "video_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id", F.lit(9)), blocks).cast("int").alias("block"))
    return Index(rows, dims, centres, near, far, sizes, block)


def _compared(rows: DataFrame, asked: DataFrame, keys: list[str], dims: int, k: int) -> DataFrame:
    """query_id, vec_id, video_id and distance: of each group of keys the k nearest of its rows to each of its questions. rows: keys,
    vec_id, video_id, embedding; asked: keys, query_id, embedding."""
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *asked.schema]}
    schema = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, video_id {kinds['video_id']}, distance double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v, good = _unit(left["embedding"], dims)
        q, known = _unit(right["embedding"], dims)
        left, right = left.filter(pa.array(good)).combine_chunks(), right.filter(pa.array(known)).combine_chunks()
        v, q = v[good], q[known]
        order = pc.sort_indices(left["vec_id"]).to_numpy().astype(np.int64)
        v = v[order]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(0, len(q) if len(v) else 0, 64):
            alike = q[i : i + 64] @ v.T
            least = np.partition(alike, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(alike), -np.inf)
            # rounded, so that equal vectors tie in whatever order the sums were made; of the ties the least ids
            at, row = np.nonzero(alike >= least[:, None] - 2e-12)
            d = np.round(1 - alike[at, row], 12)
            best = np.lexsort((row, d, at))
            at, row, d = at[best], row[best], d[best]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            found.append((at[first] + i, order[row[first]], d[first]))
        a, b, d = (np.concatenate(c) for c in zip(*found))
        return pa.table([right["query_id"].take(pa.array(a)), left["vec_id"].take(pa.array(b)), left["video_id"].take(pa.array(b)), pa.array(d)], names=["query_id", "vec_id", "video_id", "distance"])

    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _side_by_side(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which near ones are mostly near: halves along the way between two far ones, again and again."""
    done, todo = [], [np.arange(len(centres))]
    while todo:
        own = todo.pop()
        if len(own) <= 2:
            done.append(own)
            continue
        x = centres[own]
        one = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
        two = x[((x - one) ** 2).sum(axis=1).argmax()]
        own = own[np.argsort(x @ (two - one), kind="stable")]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(done)


@dataclass
class Bundles:
    """Bundles of about `rows` rows: block b of a cell lies in the bundle in which the row `at` + (b + 1/2) * `step` of all lies."""

    rows: int
    at: np.ndarray
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _bundles(index: Index) -> Bundles:
    rows = max(index.block, BUNDLE_BYTES // (8 * max(1, index.dims)))
    order = _side_by_side(index.centres)
    at = np.zeros(len(order))
    at[order] = np.cumsum(index.sizes[order]) - index.sizes[order]
    blocks = np.maximum(index.blocks, 1)
    step = index.sizes / blocks
    return Bundles(rows, at, step, np.floor((at + 0.5 * step) / rows).astype(np.int64), np.floor((at + (blocks - 0.5) * step) / rows).astype(np.int64))


def _planned(index: Index, queries: DataFrame, k: int, reach: DataFrame | None) -> DataFrame:
    """query_id, embedding and bundle to look into. Without reach: those of the nearest cells that hold k rows; with it (query_id, reach: the
    chord of the k-th found, or NULL): those of all cells within reach."""
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    given = queries.select("query_id", "embedding") if reach is None else queries.select("query_id", "embedding").join(reach, "query_id", "left")
    bundles = _bundles(index)
    known = queries.sparkSession.sparkContext.broadcast((index.centres, index.near, index.far, index.sizes, bundles.first, bundles.last))
    dims = index.dims
    later = reach is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, near, far, sizes, first, last = known.value
        number = np.arange(int(last.max()) + 1)
        holds = ((first[:, None] <= number) & (number <= last[:, None])).astype(np.float32)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                q, good = _unit(part.column("embedding"), dims)
                chord = _chords(q, centres)
                if later:
                    least = np.maximum(np.maximum(chord - far[None, :], near[None, :] - chord), 0)
                    within = part.column("reach").to_numpy(zero_copy_only=False).astype(np.float64)
                    on = least <= np.where(np.isnan(within), np.inf, within)[:, None] + SLACK
                else:
                    chord[:, sizes == 0] = np.inf
                    order = np.argsort(chord, axis=1, kind="stable")
                    # the cells before the one with which k rows are reached, and that one
                    held = np.cumsum(sizes[order], axis=1)
                    on = np.zeros(chord.shape, bool)
                    np.put_along_axis(on, order, np.concatenate([np.zeros((len(q), 1), np.int64), held[:, :-1]], axis=1) < k, axis=1)
                on &= good[:, None] & (sizes > 0)[None, :]
                at, bundle = np.nonzero(on.astype(np.float32) @ holds)
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(at)), part.column("embedding").take(pa.array(at)), pa.array(bundle.astype(np.int32))], names=["query_id", "embedding", "bundle"])

    return given.mapInArrow(run, f"query_id {kinds['query_id']}, embedding array<double>, bundle int")


def _dealt(rows: DataFrame, asked: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Both with a column `turn`: questions of a group go in turns of about `block`, and the group's rows to each turn."""
    sizes = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_turns"))
    asked = asked.join(sizes, keys).withColumn("turn", F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("_turns")).cast("int")).drop("_turns")
    rows = rows.join(sizes, keys).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1))).drop("_turns")
    return rows, asked


def nearest(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, video_id, distance and rank: the k nearest rows of the index to each question (query_id, embedding)."""
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bundles = _bundles(index)
    spots = queries.sparkSession.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(zip(bundles.at, bundles.step))], "cell int, _at double, _step double")
    place = F.floor((F.col("_at") + (F.col("block") + 0.5) * F.col("_step")) / bundles.rows).cast("int")
    rows = index.rows.join(F.broadcast(spots), "cell").select("vec_id", "video_id", "embedding", place.alias("bundle"))  # a spot for each cell

    def looked(planned: DataFrame) -> DataFrame:
        return _best(_compared(*_dealt(rows, planned, ["bundle"], bundles.rows), ["bundle", "turn"], index.dims, k), k)

    # the chord of a cosine distance d is sqrt(2 d); with fewer than k rows everything is within reach
    early = looked(_planned(index, asked, k, None)).groupBy("query_id")
    reach = early.agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(2 * F.greatest(F.max("distance"), F.lit(0.0)) + 1e-11)).alias("reach")).persist(StorageLevel.MEMORY_AND_DISK)
    return looked(_planned(index, asked, k, reach))


def within(chunks: DataFrame, queries: DataFrame, scopes: DataFrame, k: int, dims: int | None = None, block: int = BLOCK) -> DataFrame:
    """As nearest, among the chunks of the videos that scopes (query_id, video_id) names; whole videos are compared, block by block, so
    no index is needed."""
    given = chunks.select("vec_id", "video_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    dims = dims or queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).join(scopes.select("query_id", "video_id").distinct(), "query_id")
    named = asked.select("video_id").distinct()
    rows = given.join(named, "video_id", "left_semi")
    sizes = rows.groupBy("video_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    rows = rows.join(sizes, "video_id").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("_blocks")).cast("int")).drop("_blocks").withColumn("scope", F.col("video_id"))
    asked = asked.join(sizes, "video_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("query_id", "embedding", F.col("video_id").alias("scope"), "block")
    keys = ["scope", "block"]
    return _best(_compared(*_dealt(rows, asked, keys, block), [*keys, "turn"], dims, k), k)


def own_or_siblings(chunks: DataFrame, queries: DataFrame, siblings: DataFrame, k: int, cut: float, dims: int | None = None) -> DataFrame:
    """query_id, vec_id, video_id, distance, rank and fallback: the relevant chunks (distance at most cut) among the k nearest of the
    question's own video (queries: query_id, video_id, embedding); for questions that have none, those of its siblings (query_id,
    video_id), the own video left out."""
    own = within(chunks, queries, queries.select("query_id", "video_id"), k, dims).filter(F.col("distance") <= cut).persist(StorageLevel.MEMORY_AND_DISK)
    without = queries.join(own.select("query_id").distinct(), "query_id", "left_anti")
    others = siblings.select("query_id", "video_id").join(without.select("query_id", F.col("video_id").alias("_own")), "query_id").filter(~F.col("video_id").eqNullSafe(F.col("_own")))
    rest = within(chunks, without, others, k, dims).filter(F.col("distance") <= cut)
    return own.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))


def restored(chunks: DataFrame, cited: DataFrame) -> DataFrame:
    """query_id and passages: the chunks that cited (query_id, position, vec_id) names, each with its position, in that order. An id cited
    twice stands at its first position, one that no chunk has is left out."""
    first = cited.groupBy("query_id", "vec_id").agg(F.min("position").alias("position"))
    each = first.join(chunks, "vec_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "vec_id", "video_id"))).alias("passages"))
    return each
