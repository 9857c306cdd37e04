"""Codes of vectors by Lloyd's rounds over integer parts, with heaps of bounds.

Components become integers and vectors are cut into parts, each with a codebook of its own.
Per part, a vector has an upper bound of its distance to the entry it is assigned to and a
lower bound of that to the entry next best. Vectors are kept in blocks, and a block has a
binary heap per part and entry whose key is lower minus upper bound, as of entry into the
heap. When entries move, the bounds of all vectors of an entry close in by the same amount;
those amounts are added up, and only vectors whose key the sum has reached are popped and
compared with all entries, exactly. So sums and assignments are those of plain Lloyd rounds.

Blocks stay in their tasks: a round is one pass that writes blocks anew, and what is shuffled
is how much the sums of entries changed. Entries are a table of fixed size on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import join_unique
from .storage import delete, shared_path, written
from .vectors import finite_rows

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block.
BLOCK_ROWS = 4096
#: Integers below this in size are computed with in 64 bits: squares of differences of 64
#: components stay below 2**63. Others are Python's, and are compared anew in every round.
NARROW = 1 << 27
#: What bounds give away to rounding.
SLACK = 1e-9
MOST_LONG = (1 << 63) - 1


def bounds_of(dim: int, parts: int) -> list[int]:
    """Where each part begins, and the end: equal parts, or as equal as they can be."""
    return [dim * p // parts for p in range(parts + 1)]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; Python's integers where some are large."""
    floors = np.floor(x * scale)
    if (np.abs(floors) < NARROW).all():
        return floors.astype(np.int64)
    return np.array([[_floor(v, scale) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _floor(v: float, scale: int) -> int:
    over, under = v.as_integer_ratio()
    return over * scale // under


def _packed(comps: np.ndarray) -> bytes:
    return ",".join(map(str, comps.ravel().tolist())).encode() if comps.dtype == object else comps.astype("<i4").tobytes()


def _unpacked(data: bytes, wide: bool, rows: int, dim: int) -> np.ndarray:
    if wide:
        return np.array([int(v) for v in data.split(b",")] if data else [], dtype=object).reshape(rows, dim)
    return np.frombuffer(data, dtype="<i4").astype(np.int64).reshape(rows, dim)


def nearest(part: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower), its squared distance, and lower minus upper
    bound less what rounding may take; minus infinity where integers are large."""
    wide = part.dtype == object or any(abs(v) >= NARROW for e in entries for v in e)
    part = part.astype(object) if wide else part
    own = np.array(entries, dtype=part.dtype).reshape(len(entries), part.shape[1])
    distance = ((part[:, None, :] - own[None, :, :]) ** 2).sum(axis=2) if part.shape[1] else np.zeros((len(part), len(own)), dtype=np.int64)
    best = np.argmin(distance, axis=1)
    rows = np.arange(len(part))
    least = distance[rows, best]
    if wide:
        return best, least, np.full(len(part), -np.inf)
    upper = np.sqrt(least.astype(np.float64))
    others = distance.astype(np.float64)
    others[rows, best] = np.inf
    lower = np.sqrt(others.min(axis=1))
    return best, least, np.where(np.isinf(lower), np.inf, lower - upper - SLACK * (1 + lower + upper))


def violated(keys: np.ndarray, limit: float) -> np.ndarray:
    """Positions in a binary heap of all keys that are at most ``limit``: from the root, below
    none that is over it."""
    found, reach = [], np.zeros(min(1, len(keys)), dtype=np.int64)
    while len(reach):
        bad = reach[keys[reach] <= limit]
        found.append(bad)
        reach = np.concatenate((2 * bad + 1, 2 * bad + 2))
        reach = reach[reach < len(keys)]
    return np.concatenate(found) if found else reach


class Heaps:
    """Of one part of a block: a heap of (key, row) per entry. Arrays in ascending order of keys
    are heaps, so what is pushed is merged in."""

    def __init__(self, keys: list[np.ndarray], rows: list[np.ndarray]):
        self.keys, self.rows = keys, rows

    def pop(self, limits: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose bounds are violated, and the entries they were assigned to."""
        gone, of = [], []
        for j, limit in enumerate(limits):
            bad = violated(self.keys[j], limit)
            if len(bad):
                gone.append(self.rows[j][bad])
                of.append(np.full(len(bad), j))
                self.keys[j], self.rows[j] = np.delete(self.keys[j], bad), np.delete(self.rows[j], bad)
        return (np.concatenate(gone), np.concatenate(of)) if gone else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def push(self, rows: np.ndarray, entries: np.ndarray, keys: np.ndarray) -> None:
        for j in np.unique(entries).tolist():
            here = entries == j
            key, row = np.concatenate((self.keys[j], keys[here])), np.concatenate((self.rows[j], rows[here]))
            order = np.argsort(key, kind="stable")
            self.keys[j], self.rows[j] = key[order], row[order]


def _changes(part: np.ndarray, rows: np.ndarray, old: np.ndarray | None, new: np.ndarray, n_entries: int) -> list[list[int]]:
    """Per entry, by how much its number of rows and its componentwise sums grew."""
    out = [[0] * (part.shape[1] + 1) for _ in range(n_entries)]
    for which, sign in ((new, 1), (old, -1)):
        for j in [] if which is None else np.unique(which).tolist():
            mine = part[rows[which == j]]
            for i, v in enumerate((len(mine), *mine.sum(axis=0).tolist())):
                out[j][i] += sign * v
    return out


BLOCK = "ids array<long>, labels array<{label}>, dim int, wide boolean, comps binary, keys binary, rows binary, sizes array<int>, changes array<string>"
_FIELDS = ("ids", "labels", "dim", "wide", "comps", "keys", "rows", "sizes", "changes")


def _block(ids: pa.Array, labels: pa.Array, comps: np.ndarray, heaps: list[Heaps], changes: list[str]) -> pa.RecordBatch:
    lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    keys = np.concatenate([np.zeros(0), *(k for h in heaps for k in h.keys)])
    rows = np.concatenate([np.zeros(0, np.int64), *(r for h in heaps for r in h.rows)])
    columns = [lists(ids), lists(labels), pa.array([comps.shape[1]], pa.int32()), pa.array([comps.dtype == object]), pa.array([_packed(comps)], pa.binary())]
    columns += [pa.array([keys.astype("<f8").tobytes()], pa.binary()), pa.array([rows.astype("<i4").tobytes()], pa.binary()), lists(pa.array([len(k) for h in heaps for k in h.keys], pa.int32())), lists(pa.array(changes, pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=list(_FIELDS))


def _blocks(batches: Iterator[pa.RecordBatch], n_entries: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, list[Heaps]]]:
    """The blocks in written rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
            dim, wide, comps, keys, rows, sizes = (batch.column(k)[i].as_py() for k in range(2, 8))
            ends = np.cumsum(sizes)[:-1]
            keys = np.split(np.frombuffer(keys, dtype="<f8"), ends)
            rows = np.split(np.frombuffer(rows, dtype="<i4").astype(np.int64), ends)
            heaps = [Heaps(keys[a : a + n_entries], rows[a : a + n_entries]) for a in range(0, len(sizes), n_entries)]
            yield ids, labels, _unpacked(comps, wide, len(ids), dim), heaps


class Books:
    """Entries of all parts, sums and numbers of the parts assigned to them, and how far the
    bounds of each entry's parts have closed in so far."""

    def __init__(self, vectors: np.ndarray, parts: int):
        self.cuts = bounds_of(vectors.shape[1], parts)
        self.n = len(vectors)
        self.entries = [[[int(v) for v in row[a:b]] for row in vectors] for a, b in zip(self.cuts, self.cuts[1:])]
        self.sums = [[[0] * (b - a + 1) for _ in range(self.n)] for a, b in zip(self.cuts, self.cuts[1:])]
        self.drift = [[0.0] * self.n for _ in range(parts)]

    def part(self, comps: np.ndarray, p: int) -> np.ndarray:
        return comps[:, self.cuts[p] : self.cuts[p + 1]]

    def add(self, changes: dict[int, int]) -> None:
        slot = 0
        for sums in self.sums:
            for own in sums:
                for i in range(len(own)):
                    own[i] += changes.get(slot, 0)
                    slot += 1

    def move(self) -> None:
        """Entries become the floored means of their parts; bounds close in by what each entry
        moved and by the most that another did."""
        for p, (entries, sums) in enumerate(zip(self.entries, self.sums)):
            moved = []
            for j, (n, *own) in enumerate(sums):
                new = [s // n for s in own] if n else entries[j]
                moved.append(_length([a - b for a, b in zip(new, entries[j])]))
                entries[j] = new
            for j, own in enumerate(moved):
                self.drift[p][j] += (own + max([m for i, m in enumerate(moved) if i != j], default=0.0)) * (1 + SLACK)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for entries in self.entries for e in entries for v in e).encode()).hexdigest()


def _length(x: list[int]) -> float:
    square = sum(v * v for v in x)
    return math.sqrt(square) if square < 1 << 900 else math.inf


def _first_blocks(rows: DataFrame, books: Books, scale: int) -> DataFrame:
    """Blocks of all rows whose vectors are whole and as long as the entries', assigned."""
    dim = books.cuts[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in finite_rows(batch.column(2)):
                for i in range(0, len(at) if x.shape[1] == dim else 0, BLOCK_ROWS):
                    comps = integers(x[i : i + BLOCK_ROWS], scale)
                    here = batch.take(pa.array(at[i : i + BLOCK_ROWS]))
                    every, heaps, changes = np.arange(len(comps)), [], []
                    for p, entries in enumerate(books.entries):
                        part = books.part(comps, p)
                        best, _, key = nearest(part, entries)
                        heaps.append(Heaps([np.zeros(0)] * books.n, [np.zeros(0, np.int64)] * books.n))
                        heaps[-1].push(every, best, key)
                        changes += [str(v) for own in _changes(part, every, None, best, books.n) for v in own]
                    yield _block(here.column(0), here.column(1), comps, heaps, changes)

    return rows.mapInArrow(run, BLOCK.format(label=rows.schema["label"].dataType.simpleString()))


def _next_blocks(blocks: DataFrame, books: Books) -> DataFrame:
    """The same blocks, with what the entries' moves violated assigned anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, comps, heaps in _blocks(batches, books.n):
            changes = []
            for p, entries in enumerate(books.entries):
                part = books.part(comps, p)
                rows, old = heaps[p].pop(books.drift[p])
                best, _, key = nearest(part[rows], entries)
                heaps[p].push(rows, best, key + np.array(books.drift[p])[best])
                other = best != old
                changes += [str(v) for own in _changes(part, rows[other], old[other], best[other], books.n) for v in own]
            yield _block(ids, labels, comps, heaps, changes)

    return blocks.mapInArrow(run, blocks.schema)


def _changed(blocks: DataFrame) -> dict[int, int]:
    """The blocks' changes in total: a number per entry and position, added within tasks first."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for changes in batch.column(0).to_pylist():
                for slot, v in enumerate(changes):
                    if v != "0":
                        total[slot] = total.get(slot, 0) + int(v)
        yield _slots(total)

    def over(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_slots({key[0].as_py(): sum(map(int, table.column("change").to_pylist()))})])

    schema = "slot int, change string"
    found = blocks.select("changes").mapInArrow(within, schema).groupBy("slot").applyInArrow(over, schema)
    return {r["slot"]: int(r["change"]) for r in found.collect()}


def _slots(total: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([str(v) for v in total.values()], pa.string())], names=["slot", "change"])


def _codes(blocks: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code and error of every row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, comps, heaps in _blocks(batches, books.n):
            error, codes = np.zeros(len(ids), dtype=object), np.zeros((len(ids), len(heaps)), dtype=np.int64)
            for p, heap in enumerate(heaps):
                for j, rows in enumerate(heap.rows):
                    codes[rows, p] = j
                    error[rows] += ((books.part(comps, p)[rows].astype(object) - np.array(books.entries[p][j], dtype=object)) ** 2).sum(axis=1) if len(rows) and books.cuts[p] < books.cuts[p + 1] else 0
            text = ["".join(f"{j:02x}" for j in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array([min(v, MOST_LONG) for v in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    label = blocks.schema["labels"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of ``vectors``
    (vec_id, label, embedding) that has a whole vector.

    Left out are rows whose vector is null, holds null or non-finite components, or has
    another length than that of the least vec_id kept (a table has vectors of one length). Rows
    of one vec_id are rows of their own, the lesser vector first; a null vec_id comes last. With
    fewer rows than entries there are fewer entries. Integers have any size; an error beyond a
    long's range is given as the greatest long. Labels are of any type that has a text; null is
    a label. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    whole = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("vec_id", "embedding").limit(1).collect()
    if not first:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dim = len(first[0]["embedding"])
    first = whole.where(F.size("embedding") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    books = Books(integers(np.array([r["embedding"] for r in first], dtype=np.float64).reshape(len(first), dim), scale), parts)

    at = shared_path(spark, "vector-blocks")
    blocks = written(_first_blocks(rows, books, scale), "vector-blocks", at)
    for _ in range(rounds):
        books.add(_changed(blocks))
        books.move()
        before, at = at, shared_path(spark, "vector-blocks")
        blocks = written(_next_blocks(blocks, books), "vector-blocks", at)
        delete(spark, before)
    codes = written(_codes(blocks, books), "vector-codes")
    delete(spark, at)
    label = codes.withColumn("no_label", F.col("label").isNull()).withColumn("label_key", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = label.groupBy("no_label", "label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    sums = sums.select("no_label", "label_key", "n", F.least("sum", F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return join_unique(label, sums, ["no_label", "label_key"], "n", codes.count()).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
