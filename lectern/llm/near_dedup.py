"""Near duplicates by SimHash and tables of distances to pivots, verified by the Jaccard similarity of shingle sets; the stage of
the pipeline.

Texts link when their sets of SHINGLE-word shingles (lower-case A-Z; a shorter text is one shingle) are SIMILAR or more
alike. The fingerprint is a SimHash of the set: a bit is one if it is set in over half of the shingles' hashes. Sets of
similarity 0.8 differ in 15 % of the bits, far more than the radius of op9, so the fingerprint has 64 * WIDE bits and candidates
meet in many tables: a cell is a table with the values of some of the bits, drawn for that table. The bits of a cell grow with
the logarithm of the rows (about CELL unrelated rows a cell), the tables so that texts of similarity 0.8 miss each other in all
with a probability of about 4 in 100,000 (1 in 1,000 for texts of four or five shingles).

In a cell a row stands with its sketch, the first bits of the fingerprint, and a table of its sketch's distances to PIVOTS
sketches of the cell, sorted by the first distance. By the triangle inequality no distance of a pair of sketches within FAR
bits differs by more than FAR: pairs beyond that are discarded, and the survivors are compared by their own Hamming distance
(FAR is five deviations beyond 0.8), then by that of the whole fingerprints (FAR_WHOLE is five deviations beyond the worst
small sets of 0.8, four shingles of five). All pairs that are left are verified by whole sets, in integers.

First each member of a cell is compared with the first pivot, the cell's least; what that links is one component. Then the
members of cells that still hold several components are compared with one another, so no pair of a cell is left out; a cell of more
than CROWD rows goes to tasks as pairs of blocks. Rows that are close to none of another component are done. The others are
dealt to blocks of about BLOCK rows, and a task gets two blocks of a cell with their fingerprints. A close pair counts in the first
table alone in which its rows share a cell, which their fingerprints tell, so a row's set goes only where it has a pair that no
other table has. There a task counts what the sets have in common by products of matrices, and gives a forest of the links it
finds, never the pairs. Groups of copies are one component by then and cost nothing more.

Null texts count as empty; the empty text is like any other empty text only; equal rows are one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import saved, texts
from .textops import Words, mix, signed, slices

SHINGLE, SIMILAR = 5, (4, 5)
WIDE, PIVOTS, CELL, MISSES, FAR, FAR_WHOLE, SLICE, BLOCK, CROWD = 16, 4, 64, 12, 42, 256, 1 << 18, 400, 4096
_SALT = mix(np.arange(1, WIDE + 1, dtype=np.uint64))
_OCTETS = np.uint64(0x0101010101010101)
_SKETCH = ["s0", "s1"]
#: A cell's number has its table above these bits.
_TABLE = 48
#: Rows that a task compares at once, a whole cell at least.
HELD = 1 << 16


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingles of text i, repeats included, are hashes[first[i]:first[i+1]], one at least."""
    h = w.hashes(lower=True)
    at, found = w.windows(h, size)
    doc = np.searchsorted(w.first, at, side="right") - 1
    n = np.diff(w.first)
    short = np.flatnonzero(n < size)
    whole = np.zeros(len(short), dtype=np.uint64)
    for k in range(size - 1):
        on = n[short] > k
        whole[on] = mix(whole[on] * np.uint64(3) + h[w.first[short[on]] + k])
    found, doc = np.concatenate([found, whole]), np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    return found[order], np.searchsorted(doc[order], np.arange(w.n_docs + 1))


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, WIDE): the SimHash of each run hashes[first[i]:first[i+1]] as a set; no run is empty."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    hashes = hashes[np.lexsort((hashes, doc))]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, size = hashes[fresh], np.bincount(doc[fresh], minlength=n)
    # counters of eight bits, eight in a word: a run has 255 hashes at most
    runs = -(-size // 255)
    of_doc = np.cumsum(runs) - runs
    start = np.repeat(np.cumsum(size) - size, runs) + 255 * (np.arange(runs.sum()) - np.repeat(of_doc, runs))
    out = np.zeros((n, WIDE * 8), dtype=np.uint8)
    for k in range(WIDE):
        x = mix(hashes ^ _SALT[k])
        for lane in range(8):
            counts = np.add.reduceat((x >> np.uint64(lane)) & _OCTETS, start).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(counts.astype(np.int64), of_doc, axis=0)
            out[:, k * 8 : k * 8 + 8] |= (2 * counts > size[:, None]).astype(np.uint8) << np.uint8(lane)
    return out.view(np.uint64)


def _prints(rows: DataFrame) -> DataFrame:
    """ord, row_key and the fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column("text"), SLICE):
                found = fingerprints(*shingles(w))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(w.n_docs + 1, dtype=np.int32) * WIDE), pa.array(signed(found.ravel())))
                yield pa.RecordBatch.from_arrays([b.column("ord").slice(i, j - i), b.column("row_key").slice(i, j - i), lists], names=["ord", "row_key", "print"])

    return rows.select("ord", "row_key", "text").mapInArrow(run, "ord bigint, row_key bigint, print array<bigint>")


def tables(n: int) -> np.ndarray:
    """(tables, bits of a cell): the places of the bits that make the cells of each table, for n rows."""
    up, down = SIMILAR
    same = 1 - np.arccos(2 * up / (up + down)) / np.pi
    deep = min(max(6, int(np.ceil(np.log2(max(n, 1) / CELL)))), 31)
    rng = np.random.default_rng(64)
    return np.array([rng.permutation(64 * WIDE)[:deep] for _ in range(int(np.ceil(MISSES / same**deep)))])


def _cells(prints: DataFrame, places: np.ndarray) -> DataFrame:
    """cell, the other columns of prints, and the sketch: each row in its cell of each table."""
    shared = prints.sparkSession.sparkContext.broadcast(places)
    others = [c for c in prints.columns if c != "print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        worth = np.int64(1) << np.arange(at.shape[1], dtype=np.int64)
        table = np.arange(len(at), dtype=np.int64) << _TABLE
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                own = part.column("print").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDE)
                bits = np.unpackbits(np.ascontiguousarray(own).view(np.uint8), axis=1, bitorder="little")
                cell = np.stack([bits[:, p] @ worth + t for p, t in zip(at, table)], axis=1)
                each = np.repeat(np.arange(len(own)), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), *(part.column(c).take(pa.array(each)) for c in others), *(pa.array(own[each, k]) for k in range(len(_SKETCH)))], names=["cell", *others, *_SKETCH])

    return prints.mapInArrow(run, ", ".join(f"{c} bigint" for c in ["cell", *others, *_SKETCH]))


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


def _sketches(b: pa.RecordBatch) -> np.ndarray:
    return np.stack(_columns(b, *_SKETCH), axis=1).view(np.uint64)


def _bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int16).sum(axis=1, dtype=np.int16)


def _starts(cell: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))


def _hubs(cells: DataFrame, crowd: int) -> DataFrame:
    """Pairs (a, b) of a row and its cell's least with close sketches, and the rows n of each cell that has over `crowd`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(cell, n, a, b) -> pa.RecordBatch:
            void, nil = np.ones(len(a), bool), np.ones(len(cell), bool)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64), mask=np.concatenate(m)) for c, m in (((cell, a), (~nil, void)), ((n, a), (~nil, void)), ((cell, a), (nil, ~void)), ((cell, b), (nil, ~void)))], names=["cell", "n", "a", "b"])

        none = np.empty(0, np.int64)
        at, hub, mark, n = None, None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            cell, key = _columns(b, "cell", "row_key")
            sketch = _sketches(b)
            start = _starts(cell)
            size = np.diff(np.append(start, len(cell)))
            of = np.repeat(np.arange(len(start)), size)
            hubs, marks = key[start], sketch[start]
            if cell[0] == at:
                hubs[0], marks[0] = hub, mark
                size[0] += n
            elif n > crowd:
                yield told(np.array([at]), np.array([n]), none, none)
            on = (_bits_apart(sketch, marks[of]) <= FAR) & (key != hubs[of])
            full = np.flatnonzero(size[:-1] > crowd)
            yield told(cell[start[full]], size[full], key[on], hubs[of[on]])
            at, hub, mark, n = cell[-1], hubs[-1], marks[-1], size[-1]
        if n > crowd:
            yield told(np.array([at]), np.array([n]), none, none)

    return cells.repartition("cell").sortWithinPartitions("cell", "row_key").mapInArrow(run, "cell bigint, n bigint, a bigint, b bigint")


def meeting(cell: np.ndarray, root: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Which rows have a close sketch in their cell across components; equal cells are next to each other."""
    out = np.zeros(len(cell), bool)
    start = _starts(cell)
    size = np.diff(np.append(start, len(cell)))
    mixed = np.repeat(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start), size)
    at = np.flatnonzero(mixed)
    if not len(at):
        return out
    first, last = np.repeat(start, size)[at], np.repeat(start + size - 1, size)[at]
    table = np.stack([_bits_apart(sketch[at], sketch[np.minimum(first + p, last)]) for p in range(PIVOTS)], axis=1)
    order = np.lexsort((table[:, 0], cell[at]))
    at, table = at[order], table[order]
    cell, root, sketch = cell[at], root[at], sketch[at]
    live = np.arange(len(at))
    for step in range(1, len(at)):
        live = live[: np.searchsorted(live, len(at) - step)]
        # the rows are sorted: once the first distance is out of reach it stays so, and the row is done
        live = live[(cell[live] == cell[live + step]) & (table[live + step, 0] - table[live, 0] <= FAR)]
        if not len(live):
            break
        a = live[root[live] != root[live + step]]
        for p in range(1, PIVOTS):
            a = a[np.abs(table[a, p] - table[a + step, p]) <= FAR]
        a = a[_bits_apart(sketch[a], sketch[a + step]) <= FAR]
        out[at[a]] = out[at[a + step]] = True
    return out


def _meeting(cells: DataFrame) -> DataFrame:
    """The rows (cell, row_key, root, sketch) that `meeting` tells."""
    names = ["cell", "row_key", "root", *_SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.RecordBatch) -> pa.RecordBatch:
            return rows.filter(pa.array(meeting(*_columns(rows, "cell", "root"), _sketches(rows)))) if rows.num_rows else rows

        held, n, most = [], 0, HELD
        for b in batches:
            held.append(b.select(names))
            n += b.num_rows
            if n >= most:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cell = rows.column("cell").to_numpy()
                # the last cell may go on
                whole = int(np.searchsorted(cell, cell[-1]))
                yield done(rows.slice(0, whole))
                held, n = [rows.slice(whole)], len(cell) - whole
                most = max(HELD, 2 * n)
        if n:
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _sets(rows: DataFrame) -> DataFrame:
    """row_key and the set of shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column("text"), SLICE):
                hashes, first = shingles(w)
                own = [np.unique(hashes[x:y]) for x, y in zip(first[:-1], first[1:])]
                cuts = np.cumsum([0, *map(len, own)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(np.concatenate(own))))
                yield pa.RecordBatch.from_arrays([b.column("row_key").slice(i, j - i), lists], names=["row_key", "shingles"])

    return rows.select("row_key", "text").mapInArrow(run, "row_key bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are SIMILAR or more alike."""
    up, down = SIMILAR
    found = pairs.join(sets.select(F.col("row_key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("row_key").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    # both / (x + y - both) >= up / down
    return found.filter(both * (up + down) >= (F.size("x") + F.size("y")) * up).select("a", "b")


def overlaps(sets: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """How many values each two sets have in common."""
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets) if len(sets) else np.empty(0, np.int64), return_inverse=True, return_counts=True)
    # a value of one set alone has nothing in common with another
    shared = np.flatnonzero(times > 1)
    number = np.full(len(times), -1)
    number[shared] = np.arange(len(shared))
    column = number[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, len(shared), step):
        i, j = np.searchsorted(column, [at, at + step])
        some, back = np.unique(row[i:j], return_inverse=True)
        part = np.zeros((len(some), min(step, len(shared) - at)), dtype=np.float32)
        part[back, column[i:j] - at] = 1
        out[np.ix_(some, some)] += part @ part.T
    out[np.diag_indices(len(sets))] = sizes
    return out.astype(np.int64)


def _block_links(group: list[tuple], near: Callable[[list[tuple]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows (row_key, root, block, sketch, set) that `near` tells."""
    key = np.array([g[0] for g in group], dtype=np.int64)
    x, y = np.nonzero(near(group))
    if not len(x):
        return key[:0], key[:0]
    some, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = back[: len(x)], back[len(x) :]
    sets = [group[i][4] for i in some]
    both, size = overlaps(sets), np.array([len(v) for v in sets])
    up, down = SIMILAR
    on = both[a, b] * (up + down) >= (size[a] + size[b]) * up
    return forest(key[x[on]], key[y[on]]) if on.any() else (key[:0], key[:0])


def _gathered(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], sets: bool = False) -> Iterator[list[tuple]]:
    """The rows of each (cell, low, high), which come one after the other, as tuples of columns."""
    group: list[tuple] = []
    at = None
    for b in batches:
        held = b.column("shingles") if sets else None
        for i, (now, *row) in enumerate(zip(zip(*(b.column(c).to_pylist() for c in ("cell", "low", "high"))), *(b.column(c).to_pylist() for c in columns))):
            if now != at:
                if len(group) > 1:
                    yield group
                group, at = [], now
            group.append((*row, held[i].values.to_numpy(zero_copy_only=False), now) if sets else (*row, now))
    if len(group) > 1:
        yield group


def _near(group: list[tuple], far: int = FAR) -> np.ndarray:
    """Pairs of rows (row_key, root, block, sketch, ...) of two blocks that lie in different components and have close sketches, as
    a triangle of booleans; within a block only where the group is that block alone."""
    root, block = (np.array([g[k] for g in group], dtype=np.int64) for k in (1, 2))
    sketch = np.array([g[3] for g in group], dtype=np.int64).view(np.uint64).reshape(len(group), -1)
    apart = root[:, None] != root[None, :]
    if len(np.unique(block)) > 1:
        apart &= block[:, None] != block[None, :]
    apart = np.triu(apart)
    first = len(_SKETCH)
    for at in range(0, len(group), 64):
        apart[at : at + 64] &= np.bitwise_count(sketch[at : at + 64, None, :first] ^ sketch[None, :, :first]).astype(np.int32).sum(axis=2) <= FAR
    if sketch.shape[1] > first:
        x, y = np.nonzero(apart)
        for at in range(0, len(x), 1 << 14):
            a, b = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
            apart[a, b] = np.bitwise_count(sketch[a] ^ sketch[b]).astype(np.int32).sum(axis=1) <= far
    return apart


def _first_table(x: np.ndarray, y: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first table in which the fingerprints x[i] and y[i] share a cell, or how many there are."""
    out = np.full(len(x), len(places))
    for at in range(0, len(x), 4096):
        unlike = np.unpackbits(np.ascontiguousarray(x[at : at + 4096] ^ y[at : at + 4096]).view(np.uint8), axis=1, bitorder="little")
        left = np.arange(len(unlike))
        for t, p in enumerate(places):
            same = ~unlike[left][:, p].any(axis=1)
            out[at + left[same]] = t
            left = left[~same]
            if not len(left):
                break
    return out


def _near_first(group: list[tuple], places: np.ndarray) -> np.ndarray:
    """As `_near` of rows with whole fingerprints, without the pairs that share a cell of a table before that of the group's cell, which
    comes first in the last column."""
    near = _near(group, FAR_WHOLE)
    prints = np.array([g[3] for g in group], dtype=np.int64).view(np.uint64).reshape(len(group), -1)
    x, y = np.nonzero(near)
    near[x, y] = _first_table(prints[x], prints[y], places) == group[0][-1][0] >> _TABLE
    return near


_PLACE, _OWN = ["cell", "low", "high"], ["row_key", "root", "block", "sketch"]


def close_rows(left: DataFrame, block: int = BLOCK, prints: DataFrame | None = None, places: np.ndarray | None = None) -> DataFrame:
    """The rows of cells (cell, row_key, root, sketch) with the pair of blocks in which each has a close sketch across components; with
    prints (row_key, print), a close fingerprint, in the first table of the pair."""
    n_blocks = left.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = left.join(n_blocks, "cell").withColumn("block", F.pmod(F.xxhash64("row_key", F.lit(3)), F.col("blocks")).cast("int"))
    # a row goes to the pairs of blocks that its own is in; a block alone is a pair with itself
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    sketch = F.array(*_SKETCH)
    if prints is not None:
        pairs, sketch = pairs.join(prints, "row_key"), F.col("print")
    rows = pairs.select(*_PLACE, "row_key", "root", "block", sketch.alias("sketch")).repartition(*_PLACE).sortWithinPartitions(*_PLACE)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, tuple(_OWN)):
            near = _near(group) if places is None else _near_first(group, places)
            on = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
            if len(on):
                kept = [(*group[i][4], *group[i][:4]) for i in on]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], names=[*_PLACE, *_OWN])

    return rows.mapInArrow(sketched, "cell bigint, low int, high int, row_key bigint, root bigint, block int, sketch array<bigint>")


def set_links(close: DataFrame, sets: DataFrame, places: np.ndarray | None = None) -> DataFrame:
    """Links (a, b) between the rows of `close_rows` that lie in different components."""

    def near(group: list[tuple]) -> np.ndarray:
        return _near(group) if places is None else _near_first([(*g[:4], g[5]) for g in group], places)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, tuple(_OWN), sets=True):
            a, b = _block_links(group, near)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = close.join(sets, "row_key").select(*_PLACE, *_OWN, "shingles").repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    return ordered.mapInArrow(compared, "a bigint, b bigint").distinct()


def crossed(left: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the rows of cells (cell, row_key, root, sketch) that lie in different components. Sketches are compared
    first; the sets go only to the pairs of blocks in which their row has a close sketch across components."""
    return set_links(saved(close_rows(left, block), "close"), sets)


def _blocks(cells: DataFrame, crowded: DataFrame, crowd: int) -> DataFrame:
    """cells with each crowded one (cell, n) dealt to pairs of blocks of about half of `crowd` rows, which are cells of their own."""
    dealt = cells.join(crowded.select("cell", F.ceil(F.col("n") * 2 / crowd).cast("int").alias("blocks")), "cell", "left")
    block = F.pmod(F.xxhash64("row_key", F.lit(5)), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.withColumn("block", block).withColumn("other", other)
    # two cells of one hash would be compared as one: more pairs, none fewer
    low = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).bitwiseAND((1 << _TABLE) - 1)
    place = F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.shiftleft(F.shiftright("cell", _TABLE), _TABLE).bitwiseOR(low))
    return pairs.withColumn("cell", place).drop("blocks", "block", "other")


def similar_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """ord, row_key and root (equal for the rows that links connect) of each distinct row."""
    rows = texts(docs)
    prints = saved(_prints(rows).dropDuplicates(["row_key"]), "fingerprints")
    places = tables(prints.count())

    def sets_of(keys: DataFrame) -> DataFrame:
        keys = saved(keys.distinct(), "keys")
        return saved(_sets(rows.join(keys, "row_key", "left_semi").dropDuplicates(["row_key"])), "sets")

    met = saved(_hubs(_cells(prints.select("row_key", "print"), places), crowd), "hubs")
    pairs = met.filter("a IS NOT NULL").select("a", "b").distinct()
    links = saved(_verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("row_key")))), "links")
    rooted = prints.select("row_key", "print").join(components(links).withColumnRenamed("node", "row_key"), "row_key", "left")
    cells = _cells(rooted.select("row_key", F.coalesce("root", "row_key").alias("root"), "print"), places)
    crowded = met.filter("n IS NOT NULL").select("cell", "n")
    if crowded.limit(1).count():
        cells = _blocks(cells, crowded, crowd)
    # cells of one component are done; of the others, the close pairs between components are still to be compared
    left = saved(_meeting(cells), "meeting")
    close = saved(close_rows(left, prints=prints.select("row_key", "print"), places=places), "close")
    roots = components(links.unionByName(saved(set_links(close, sets_of(close.select("row_key")), places), "links")))
    return prints.select("ord", "row_key").join(roots.withColumnRenamed("node", "row_key"), "row_key", "left").select("ord", "row_key", F.coalesce("root", "row_key").alias("root"))
