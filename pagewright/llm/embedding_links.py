"""Near-duplicates among vectors: a pigeonhole join over blocks of rotated vectors.

Unit vectors whose cosine is at least c are at most sqrt(2 - 2c) apart. Vectors are rotated
at random and split into blocks of few dimensions; the squared distance is the sum of the
blocks', so two vectors that link are within a block's share of it, proportional to the
block's dimensions, in one block at least. Every block is a range join of its own: vectors go
to the cells of a grid that a box around them touches, pairs meet in the cell of their middle,
and those within the block's share are candidates. A pair counts in the first block that
finds it, and there the cosine of the whole vectors, in double precision, decides.

No pair leaves the task that finds it: a group of vectors gives how many links each has, and a
tree of links per component of the group. A cell with more vectors than a group may have is
cut into chunks, and all pairs of chunks are groups.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .ranges import join_unique
from .storage import free_name, written
from .vectors import finite_rows

LEAST_COSINE = 0.95
BLOCK_DIMS = 8
#: Vectors of one chunk, and of a cell that isn't cut. A vector is sent once per chunk of its cell.
CHUNK_ROWS = 1 << 16
#: Vectors that are rotated at a time.
TURNED_ROWS = 4096
#: By how much one more dimension of the grid thins cells out, about; it only chooses the plan.
THINS = 1.7
#: What budgets and boxes give away to rounding; rotated coordinates are stored as floats.
SLACK = 1e-5
#: Rows of a tile, and pairs that are looked at whole at a time.
TILE_ROWS, TILE_PAIRS = 256, 1 << 15
#: Vectors of length 1 have squared distances as floats that are out by less than this.
FLOAT_SLACK = 2e-6
SEED = 20


def blocks_of(dim: int) -> list[tuple[int, int]]:
    """Where the blocks of a vector begin and end."""
    n = max(1, dim // BLOCK_DIMS)
    ends = [dim * k // n for k in range(n + 1)]
    return list(zip(ends, ends[1:]))


@functools.lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]


def budgets(dim: int, least: float) -> np.ndarray:
    """Squared distance that is each block's share."""
    return np.array([(2 - 2 * least) * (b - a) / dim for a, b in blocks_of(dim)]) * (1 + SLACK) + SLACK * SLACK


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(rotated: np.ndarray, width: float, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and cells (integers by grid dimension) that boxes around the rows, as wide as
    half a cell, touch."""
    at = rotated[:, :grid] / width
    low, high = np.floor(at - 0.25 - SLACK).astype(np.int32), np.floor(at + 0.25 + SLACK).astype(np.int32)
    for corner in range(1 << grid):
        up = (corner >> np.arange(grid)) & 1 == 1
        rows = np.flatnonzero((low != high)[:, up].all(axis=1))
        if len(rows):
            yield rows, np.where(up, high[rows], low[rows])


def placed(groups: DataFrame, least: float, grid: int, payload: bool = True) -> DataFrame:
    """dim, block and cell of every cell that a vector goes to, with its loc, copies, vector and
    rotated coordinates if ``payload``."""
    names = ["dim", "block", "cell", "loc", "copies", "vector", "rotated"][: 7 if payload else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            raws = batch.column(3).to_pylist()
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                for i in range(0, len(of), TURNED_ROWS):
                    own = of[i : i + TURNED_ROWS]
                    turned = (unit(_doubles([raws[k] for k in own], dim)) @ rotation(dim)).astype("<f4")
                    packed = pa.array([r.tobytes() for r in turned], pa.binary())
                    for b, ((first, end), share) in enumerate(zip(blocks_of(dim), budgets(dim, least))):
                        for rows, cell in cells(turned[:, first:end].astype(np.float64), 2 * share**0.5, min(grid, end - first)):
                            take = batch.take(pa.array(own[rows]))
                            columns = [take.column(1), pa.array(np.full(len(rows), b, dtype=np.int32)), pa.array([c.tobytes() for c in cell.astype("<i4")], pa.binary()), take.column(0), take.column(2), take.column(3)]
                            yield pa.RecordBatch.from_arrays([*columns, packed.take(pa.array(rows))][: len(names)], names=names)

    kinds = ("int", "int", "binary", "long", "long", "binary", "binary")
    return groups.select("loc", "dim", "copies", "vector").mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds))))


def _packed(v: np.ndarray) -> bytes:
    """As floats where those say the same, else as doubles."""
    short = v.astype("<f4")
    return short.tobytes() if (short == v).all() else v.astype("<f8").tobytes()


def _doubles(packed: list[bytes], dim: int) -> np.ndarray:
    if len({len(x) for x in packed}) == 1:
        return np.frombuffer(b"".join(packed), dtype="<f4" if len(packed[0]) == 4 * dim else "<f8").astype(np.float64).reshape(len(packed), dim)
    return np.stack([np.frombuffer(x, dtype="<f4" if len(x) == 4 * dim else "<f8").astype(np.float64) for x in packed])


class Members:
    """Vectors of one side of a group, in slabs of about equally many by the block's first
    coordinate, and in each slab ascending by its second; a block of one dimension has one slab."""

    def __init__(self, table: pa.Table, dim: int, first: int, end: int):
        loc = np.asarray(table.column("loc"))
        rotated, vectors = (_doubles(table.column(name).to_pylist(), dim) for name in ("rotated", "vector"))
        n = len(loc)
        self.by = min(first + 1, end - 1)
        slabs = max(1, math.isqrt(n // TILE_ROWS)) if end - first > 1 else 1
        self.ends = [n * k // slabs for k in range(slabs + 1)]
        order = np.argsort(rotated[:, first], kind="stable")
        for a, b in zip(self.ends, self.ends[1:]):
            order[a:b] = order[a:b][np.argsort(rotated[order[a:b], self.by], kind="stable")]
        self.loc, self.rotated, self.copies = loc[order], rotated[order], np.asarray(table.column("copies"))[order]
        self.vectors = unit(vectors[order])
        self.low = [self.rotated[a:b, first].min() if b > a else np.inf for a, b in zip(self.ends, self.ends[1:])]
        self.high = [self.rotated[a:b, first].max() if b > a else -np.inf for a, b in zip(self.ends, self.ends[1:])]
        # Products of these are squared distances in the block.
        block = self.rotated[:, first:end].astype(np.float32)
        square, one = (block * block).sum(axis=1, keepdims=True), np.ones((n, 1), dtype=np.float32)
        self.left, self.right = np.hstack((-2 * block, square, one)), np.hstack((block, one, square))
        self.key = self.rotated[:, self.by].copy()

    def near(self, other: Members, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (own, other's) within the block's share, and some little over it; of a
        group with itself each once."""
        reach = share**0.5 + SLACK
        for slab, (start, stop) in enumerate(zip(self.ends, self.ends[1:])):
            for i in range(start, stop, TILE_ROWS):
                j = min(i + TILE_ROWS, stop)
                for k, (low, high) in enumerate(zip(other.ends, other.ends[1:])):
                    if (other is self and k < slab) or other.low[k] > self.high[slab] + reach or other.high[k] < self.low[slab] - reach:
                        continue
                    a, b = low + np.searchsorted(other.key[low:high], (self.key[i] - reach, self.key[j - 1] + reach), side="left")
                    a = max(a, i) if other is self and k == slab else a
                    if a < b:
                        square = self.left[i:j] @ other.right[a:b].T
                        x, y = np.divmod(np.flatnonzero(square <= np.float32(share + FLOAT_SLACK)), b - a)
                        x, y = x + i, y + a
                        if other is self and k == slab:
                            x, y = x[y > x], y[y > x]
                        for at in range(0, len(x), TILE_PAIRS):
                            yield x[at : at + TILE_PAIRS], y[at : at + TILE_PAIRS]


class Links:
    """How many links rows have, and the least row each is linked to, directly or not."""

    def __init__(self, loc: np.ndarray):
        self.loc, self.count, self.root = loc, np.zeros(len(loc), dtype=np.int64), np.arange(len(loc))

    def add(self, a: np.ndarray, b: np.ndarray, copies: np.ndarray) -> None:
        np.add.at(self.count, a, copies[b])
        np.add.at(self.count, b, copies[a])
        root = self.root
        while True:  # hook the greater root to the lesser, then shorten paths, until nothing changes
            x, y = root[a], root[b]
            if (x == y).all():
                return
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]


LINKS = "loc long, links long, root long"


def group_links(least: float, grid: int):
    """The links within one group (dim, block, cell, low, high) of rows of `placed` with their chunk."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, block, cell, low, high = (k.as_py() for k in key)
        ends, shares = blocks_of(dim), budgets(dim, least)
        first, end = ends[block]
        width, grids = 2 * shares[block] ** 0.5, min(grid, end - first)
        cell = np.frombuffer(cell, dtype="<i4")
        chunk = np.asarray(table.column("chunk"))
        left = Members(table.filter(pa.array(chunk == low)), dim, first, end)
        right = left if low == high else Members(table.filter(pa.array(chunk == high)), dim, first, end)
        shift = 0 if right is left else len(left.loc)
        loc = left.loc if right is left else np.concatenate((left.loc, right.loc))
        copies = left.copies if right is left else np.concatenate((left.copies, right.copies))
        links = Links(loc)
        for a, b in left.near(right, shares[block]):
            x, y = left.rotated[a], right.rotated[b]
            here = np.floor((x[:, first : first + grids] + y[:, first : first + grids]) / 2 / width).astype(np.int32)
            squares = np.add.reduceat((x - y) ** 2, [s for s, _ in ends], axis=1)
            within = squares <= shares
            good = (here == cell).all(axis=1) & within[:, block] & ~within[:, :block].any(axis=1)
            a, b = a[good], b[good]
            good = np.einsum("ij,ij->i", left.vectors[a], right.vectors[b]) >= least
            links.add(a[good], b[good] + shift, copies)
        some = np.flatnonzero(links.count)
        # Roots are row numbers here; the least locator of each tree stands for it.
        least_loc = np.full(len(loc), np.iinfo(np.int64).max)
        np.minimum.at(least_loc, links.root, loc)
        return pa.table({"loc": loc[some], "links": links.count[some], "root": least_loc[links.root[some]]})

    return run


def vector_links(vectors: DataFrame, least: float = LEAST_COSINE, chunk_rows: int = CHUNK_ROWS, grid: int | None = None, locator: str | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding),
    and the column ``locator`` of numbers unique by row, if one is named.

    Rows are vectors of their own, whatever their vec_id: a repeated row links with its like,
    and component_id is the smallest vec_id that links reach, null only if none there has one.
    Vectors that are null, zero or empty, or hold null or non-finite components, link with
    nothing, nor do vectors of different lengths. ``least`` is over 0. Other columns are
    ignored; an empty table gives no rows. Equal vectors are one in the join, with their number.
    ``grid`` is the number of dimensions of the grid; by default it follows the number of rows.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (vectors[locator].cast("long") if locator else F.monotonically_increasing_id()).alias("loc"), "embedding")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[bytes | None] = [None] * batch.num_rows
            dims = np.zeros(batch.num_rows, dtype=np.int32)
            for rows, x in finite_rows(batch.column(2)):
                for k, v in zip(rows.tolist(), x + 0.0):  # a negative zero is a zero
                    if v.any():
                        packed[k], dims[k] = _packed(v), len(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(packed, pa.binary())], names=["vec_id", "loc", "dim", "vector"])

    # Locators are fixed by being written.
    rows = written(source.mapInArrow(whole, "vec_id long, loc long, dim int, vector binary"), "vector-rows").withColumn("digest", F.sha2("vector", 256))
    some = rows.where("vector IS NOT NULL")
    groups = some.groupBy("digest").agg(F.min("loc").alias("loc"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    groups = written(groups, "vector-groups")
    n_groups = groups.count()
    if grid is None:
        grid = 0
        while n_groups / THINS**grid > chunk_rows and grid < BLOCK_DIMS:
            grid += 1

    place = ["dim", "block", "cell"]
    crowded = placed(groups, least, grid, payload=False).groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows)
    crowded = written(crowded.select(*place, F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks")), "vector-crowded")
    # Written, crowded cells have a known size: Spark broadcasts them if they are few, else merges.
    chunked = placed(groups, least, grid).join(crowded, place, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("loc"), F.col("chunks")).cast("int"))
    other = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    paired = other.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("other", "chunks")
    found = written(paired.groupBy(*place, "low", "high").applyInArrow(group_links(least, grid), LINKS), "vector-links")

    labels = connected(found.where("loc <> root").select(F.col("loc").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("loc").agg(F.sum("links").alias("links"))
    groups = groups.select("digest", "loc", "vec_id", "copies").join(counts.hint("merge"), "loc", "left").join(labels.withColumnRenamed("node", "loc").hint("merge"), "loc", "left")
    groups = written(groups.select("digest", "vec_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "loc").alias("label")), "vector-labelled")
    least_id = groups.groupBy("label").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n"))
    labelled = groups
    groups = join_unique(groups, least_id, ["label"], "n", n_groups)
    groups = groups.select("digest", "copies", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    linked = join_unique(some.select("vec_id", "loc", "digest"), groups, ["digest"], "copies", rows.count(), labelled)
    alone = rows.where("vector IS NULL").select("vec_id", "loc", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.select("vec_id", "loc", "n_links", "component_id").unionByName(alone)
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    return every.select("vec_id", "n_links", "component_id", kept, *([F.col("loc").alias(locator)] if locator else []))


def drop_near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """The rows of ``vectors`` (all columns) that are kept: with the least vec_id of their component,
    or without any where no row of it has one. Rows are met by a number in a written copy."""
    locator = free_name(vectors, "locator")
    rows = written(vectors.withColumn(locator, F.monotonically_increasing_id()), "vectors-located")
    kept = vector_links(rows, least, locator=locator).where("kept").select(locator)
    return rows.join(kept.hint("merge"), locator, "left_semi").select(*vectors.columns)
