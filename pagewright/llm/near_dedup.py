"""Near-duplicate documents: BagMinHash signatures, banding, exact verification, components.

A document is the bag of its five-word shingles (`shingles.py`); two documents are linked
when their weighted Jaccard similarity, sum of least counts over sum of greatest, is 0.8 or
more. Classes are the connected components of the links.

BagMinHash: a shingle of count w is the weight interval [0, w) on a line cut at 0, 1, 2, 4,
8, ... Each piece is a Poisson process seeded by shingle and piece, of rate equal to the
piece's length; each point has a time, a register and a place in the piece, a number whose
binary digits say which half of the piece it is in, which half of that, and so on, and only
points below w count. A register keeps the least time.
Two bags agree in a register with a probability of exactly their weighted Jaccard
similarity. Points are made in ascending time and only until every register is filled, so a
document needs about m ln m points whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .ranges import HOT_SHARE, join_unique
from .shingles import mix64, pieces, shingle_hashes
from .storage import identified, written
from .workers import resident

SIMILARITY = 0.8
#: 24 bands of 5 registers: a pair of similarity 0.8 shares a band with probability
#: 1 - (1 - 0.8**5)**24 = 0.99993.
BANDS, BAND_ROWS = 24, 5
#: Bands of at most so many documents that aren't in one class yet are tested pair by pair,
#: larger ones in blocks of about BLOCK documents, of which two at a time are in a task.
DIRECT_BAND, BLOCK = 64, 256

_STEP, _PIECE, _PLACE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def bags(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle of each row, by row and hash."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    order = np.lexsort((hashes, row))
    row, h = row[order], hashes[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def signatures(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int, m: int) -> np.ndarray:
    """BagMinHash registers (rows x m, times as float64; infinity where a bag is empty)."""
    registers = np.full((rows, m), np.inf)
    weight = np.bincount(row, weights=count, minlength=rows)
    if not len(row):
        return registers
    # Pieces [0,1), [1,2), [2,4), ... that begin below the count.
    n_pieces = 1 + np.where(count > 1, np.floor(np.log2(np.maximum(count - 1, 1))).astype(np.int64) + 1, 0)
    of = np.repeat(np.arange(len(h)), n_pieces)
    number = np.arange(len(of)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    low = np.where(number == 0, 0, 1 << np.maximum(number - 1, 0))
    length = np.maximum(low, 1)
    limit = np.minimum(count[of] - low, length)
    doc = row[of]
    seed = mix64(h[of] ^ (number.astype(np.uint64) * _PIECE))
    time = np.zeros(len(of))
    made = np.zeros(len(of), dtype=np.uint64)
    until = np.zeros(rows)
    full = weight > 0
    until[full] = m / weight[full] * (np.log(m) + 1.5)
    flat = registers.reshape(-1)

    def draw(active: np.ndarray, n: int) -> np.ndarray:
        """The next n points of each active process, as far as they are due; those that go on."""
        number = made[active][:, None] + np.arange(1, n + 1, dtype=np.uint64)
        r = mix64(seed[active][:, None] + number * _STEP)
        at = -np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / length[active][:, None]
        at[:, 0] += time[active]
        at = np.cumsum(at, axis=1)  # one by one, so that a time doesn't depend on how points are dealt
        due = at <= until[doc[active]][:, None]
        n_due = due.sum(axis=1)
        some = np.flatnonzero(n_due)
        time[active[some]] = at[some, n_due[some] - 1]
        made[active] += n_due.astype(np.uint64)
        of_process = active[np.nonzero(due)[0]]
        p = mix64(r[due] ^ _PLACE)
        inside = ((p & np.uint64(0xFFFFFFFF)) * length[of_process].astype(np.uint64)) >> np.uint64(32) < limit[of_process].astype(np.uint64)
        cell = doc[of_process] * m + (((p >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, cell[inside], at[due][inside])
        return active[n_due == n]

    todo = np.arange(len(of))
    while True:
        active = todo
        while len(active):
            left = (until[doc[active]] - time[active]) * length[active]  # points to come, on average
            active = np.concatenate([draw(active[(left >= lo) & (left < hi)], n) for lo, hi, n in ((-np.inf, 1, 1), (1, 16, 8), (16, np.inf, 128))])
        open_rows = full & np.isinf(registers).any(axis=1)
        if not open_rows.any():
            return registers
        until[open_rows] *= 1.4
        todo = np.flatnonzero(open_rows[doc])


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two arrays, row by row; 0 where both are without words."""
    n = len(a)
    (ha, ea), (hb, eb) = shingle_hashes(a), shingle_hashes(b)
    ra, xa, ca = bags(ha, ea)
    rb, xb, cb = bags(hb, eb)
    row, x, c = np.concatenate((ra, rb)), np.concatenate((xa, xb)), np.concatenate((ca, cb))
    order = np.lexsort((x, row))
    row, x, c = row[order], x[order], c[order]
    same = np.flatnonzero((x[1:] == x[:-1]) & (row[1:] == row[:-1]))
    least = np.bincount(row[same], weights=np.minimum(c[same], c[same + 1]), minlength=n)
    total = np.bincount(row, weights=c, minlength=n) if len(row) else np.zeros(n)
    return np.where(total > 0, least / np.maximum(total - least, 1), 0.0)


SIGNED = "doc_id long, bag_a long, bag_b long, bands array<long>"


def sign(docs: DataFrame, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, a 128-bit digest of the bag (null where there are no words) and one key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("near-duplicates", lambda: None)  # a model that the worker has kept is let go
        for batch in batches:
            for at, to in pieces(batch.column(1)):
                b = batch.slice(at, to - at)
                rows = b.num_rows
                row, h, count = bags(*shingle_hashes(b.column(1)))
                digest = []
                for salt in (1, 2):
                    with np.errstate(over="ignore"):
                        term = mix64(mix64(h + np.uint64(salt)) ^ count.astype(np.uint64))
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
                    ends = np.searchsorted(row, np.arange(rows + 1))
                    digest.append(mix64(sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
                empty = np.bincount(row, minlength=rows) == 0
                s = signatures(row, h, count, rows, bands * band_rows).view(np.uint64).reshape(rows, bands, band_rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (rows, bands))
                for k in range(band_rows):
                    key = mix64(key ^ s[:, :, k])
                ends = np.concatenate(([0], np.cumsum(np.where(empty, 0, bands))))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(pa.int64()), pa.array(digest[0], mask=empty), pa.array(digest[1], mask=empty), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[~empty].reshape(-1).view(np.int64)))],
                    names=["doc_id", "bag_a", "bag_b", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of the distinct pairs (a, b), those whose texts are similar enough. ``texts``: id, text.

    b may be in very many pairs; its text is then sent in several salted copies. Such b are
    in more than a thousandth of the pairs, so fewer than a thousand, and broadcast.
    """
    most = 64
    busy = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > max(most, pairs.count() // HOT_SHARE))
    busy = F.broadcast(busy.select("b", F.ceil(F.col("n") / most).cast("int").alias("salts")))
    salted = pairs.join(busy, "b", "left").select("a", "b", F.expr("pmod(xxhash64(a), coalesce(salts, 1))").cast("int").alias("salt"))
    ends = pairs.select("b").distinct().join(texts.withColumnRenamed("id", "b").hint("merge"), "b").join(busy, "b", "left")
    ends = ends.select("b", F.col("text").alias("text_b"), F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")).alias("salt"))
    joined = salted.join(texts.withColumnRenamed("id", "a").withColumnRenamed("text", "text_a").hint("merge"), "a").join(ends.hint("merge"), ["b", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pieces(batch.column(2)):
                part = batch.slice(at, to - at)
                for lo, hi in pieces(part.column(3)):
                    b = part.slice(lo, hi - lo)
                    keep = pa.array(overlap(b.column(2), b.column(3)) >= similarity)
                    yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def overlaps(texts: pa.Array, most_columns: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarity of each text with each other; the k-th occurrence of a
    shingle is an element of its own, and only elements that two texts have are multiplied."""
    n = len(texts)
    parts, rows = [], []
    for at, to in pieces(texts):
        row, h, count = bags(*shingle_hashes(texts.slice(at, to - at)))
        of = np.repeat(np.arange(len(h)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        parts.append(mix64(h[of] ^ mix64(nth.astype(np.uint64))))
        rows.append(row[of] + at)
    x, row = np.concatenate(parts), np.concatenate(rows)
    size = np.bincount(row, minlength=n).astype(np.float64)
    _, column, count = np.unique(x, return_inverse=True, return_counts=True)
    row, column = row[count[column] > 1], column[count[column] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    both = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, most_columns):
        lo, hi = np.searchsorted(column, [first, first + most_columns])
        has = np.zeros((n, most_columns), dtype=np.float32)
        has[row[lo:hi], column[lo:hi] - first] = 1
        both += has @ has.T
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def block_links(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between documents of different classes in each band of ``rows`` (band, id,
    label, main, members, n_main).

    A band's documents outside its largest class are dealt to blocks, and so are the rest; each
    block of the first kind meets every block. A task holds two blocks, never a band.
    """
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    dealt = rows.withColumn("outer", blocks(F.col("members") - F.col("n_main"))).withColumn("every", F.col("outer") + blocks(F.col("n_main")))
    out = F.col("label") != F.col("main")
    hashed = F.xxhash64("id", "band")
    own = F.when(out, F.pmod(hashed, F.col("outer"))).otherwise(F.col("outer") + F.pmod(hashed, F.col("every") - F.col("outer"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("meets", F.explode(F.sequence(F.lit(0), F.when(out, F.col("every") - 1).otherwise(F.col("outer") - 1))))
    dealt = dealt.select("band", "id", "label", F.least("own", "meets").alias("i"), F.greatest("own", "meets").alias("j"))
    full = dealt.join(texts.hint("merge"), "id").select("band", "i", "j", "id", "label", "text")

    def run(group: pa.Table) -> pa.Table:
        ids, labels = (np.asarray(group.column(c)) for c in ("id", "label"))
        s = overlaps(group.column("text").combine_chunks())
        a, b = np.nonzero(np.triu(s >= similarity, 1) & (labels[:, None] != labels[None, :]))
        return pa.table({"a": np.maximum(ids[a], ids[b]), "b": np.minimum(ids[a], ids[b])})

    return full.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _members(rows: DataFrame, total: int) -> DataFrame:
    """band, id, score of the bands that hold more than one row. The score is the number of
    others that a document meets in its bands: the text that copies were made from meets most."""
    sizes = written(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
    met = written(join_unique(rows, sizes.withColumn("others", F.col("n") - 1), ["band"], "n", total), "near-met")
    return met.select("band", "id").join(met.groupBy("id").agg(F.sum("others").alias("score")), "id")


def _led(shared: DataFrame, total: int) -> DataFrame:
    """``shared`` with the leader of each band, the document of highest score, and its label."""
    first = F.min(F.struct((-F.col("score")).alias("s"), F.col("id").alias("leader"), F.col("label").alias("leader_label")))
    lead = written(shared.groupBy("band").agg(first.alias("x"), F.count("*").alias("n")).select("band", "n", "x.leader", "x.leader_label"), "near-lead")
    return join_unique(shared, lead, ["band"], "n", total)


def _classes(docs: DataFrame, similarity: float, bands: int, band_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """The signed rows of ``docs``; doc_id and class_id, written, of each doc_id that isn't null
    and has a text with words; how many rows those are.

    Rows that share a doc_id are one document: a link of any of its texts counts. Texts of
    equal bags are joined by digest before anything else, so
    groups of copies cost one row each. Joins with texts are merges at every size. Links are sought in bands: each band's documents are
    tested against its leader, the one with most others in its bands. Documents of a band that
    are in different classes after that are tested against each other, pair by pair in bands
    of at most DIRECT_BAND of them and block by block in larger ones. No pair of different
    classes that shares a band stays untested.
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = written(sign(columns, bands, band_rows), "near-signed")
    worded = signed.where(F.col("bag_a").isNotNull() & F.col("doc_id").isNotNull())
    total = worded.count()
    bag = written(worded.groupBy("bag_a", "bag_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "near-bags")
    member = written(join_unique(worded.select("doc_id", "bag_a", "bag_b"), bag, ["bag_a", "bag_b"], "n", total).select("doc_id", "rep").distinct(), "near-members")
    reps = worded.join(bag.select("bag_a", "bag_b", F.col("rep").alias("doc_id")), ["bag_a", "bag_b", "doc_id"]).select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    # A document of several texts may have several bags: their classes are linked through it.
    links = member.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b").select("a", "b")
    shared = written(_led(_members(reps, total).withColumn("label", F.col("id")), total), "near-shared")
    # Text is shuffled once, to keep that of the documents that share a band.
    texts = written(columns.withColumnRenamed("doc_id", "id").join(shared.select("id").distinct().hint("merge"), "id"), "near-texts")
    pairs = written(shared.where("label <> leader_label").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "near-pairs")
    links = written(links.union(verify(pairs, texts, similarity)), "near-links")
    label = connected(links)
    # A leader has met its whole band. Of the others, those outside the band's largest class
    # are still to meet the documents of other classes.
    left = shared.where("id <> leader").select("id", "band").join(label.withColumnRenamed("node", "id"), "id", "left")
    left = written(left.withColumn("label", F.coalesce("label", "id")), "near-left")
    size = left.groupBy("band", "label").agg(F.count("*").alias("k")).groupBy("band")
    size = size.agg(F.sum("k").alias("n"), F.max("k").alias("n_main"), F.max_by("label", "k").alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    open_bands = written(size.withColumn("members", F.col("n")), "near-open")
    open_rows = open_bands.agg(F.sum("n")).first()[0]
    if open_rows:
        left = written(join_unique(left, open_bands, ["band"], "n", open_rows), "near-left")
        few = left.where(F.col("members") <= DIRECT_BAND)
        outside = few.where("label <> main").select("band", F.col("id").alias("a"), F.col("label").alias("of_a"))
        direct = outside.join(few.select("band", F.col("id").alias("b"), F.col("label").alias("of_b")), "band").where("of_a <> of_b")
        direct = written(direct.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
        more = verify(direct, texts, similarity).union(block_links(left.where(F.col("members") > DIRECT_BAND), texts, similarity))
        label = connected(written(links.union(more), "near-links"))
    # Labels are least ids of components of representatives; a class also has their copies.
    of = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    return signed, written(of.groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "near-classes"), total


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size and kept of every row of ``docs``.

    Texts without words are in a class of their own, null doc_ids in a class of id null and
    size 1; such rows are kept. Rows that share a doc_id are one document; see `_classes`.
    """
    signed, of, total = _classes(docs, similarity, bands, band_rows)
    n_class = of.groupBy("class_id").agg(F.count("*").alias("class_size"), F.count("*").alias("n"))
    sized = join_unique(of, n_class, ["class_id"], "n", total)
    # Rows of one doc_id may be very many, and so may those without one.
    uses = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("uses"))
    sized = written(uses.join(sized.hint("merge"), "doc_id", "left"), "near-sized")
    rows = join_unique(signed.select("doc_id").where(F.col("doc_id").isNotNull()), sized, ["doc_id"], "uses", signed.count())
    without = signed.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("class_size"))
    return rows.union(without).select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each class of rows the one of least
    doc_id (null last). Every row is a document here, whatever rows share its doc_id: where
    that doesn't tell rows apart, a number does, so the sizes of `near_classes` aren't needed."""
    rows, locator = identified(docs, "near-located")
    classes = _classes(rows.select(F.col(locator).alias("doc_id"), "text"), similarity, BANDS, BAND_ROWS)[1].withColumnRenamed("doc_id", locator)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col(locator).cast("long").alias("locator"))
    kind = rows.schema[locator].dataType
    first = rows.select(F.col(locator).cast("long").alias(locator), rank.alias("rank")).join(classes.hint("merge"), locator, "left").groupBy(F.coalesce("class_id", locator)).agg(F.min("rank").alias("rank"))
    return rows.join(first.select(F.col("rank.locator").cast(kind).alias(locator)).hint("merge"), locator, "left_semi").select(*docs.columns)
