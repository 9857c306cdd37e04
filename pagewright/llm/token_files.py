"""Token ids in Parquet: files of list columns in ascending doc_id order.

A row is a document: doc_id, part (number of its file), local_start (ids before it in the
part), n_tokens and ids. Ids are dictionary-encoded, the integers beside them
delta-encoded; row groups and pages are small and page indexes are written, so a reader that
wants some documents, or only counts, reads little more than those. ``start``, the ids of all
documents before one, is local_start plus the parts' totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import cuttable
from .ranges import MOST_TASKS, range_cuts, range_part, text_tasks
from .shingles import pieces
from .workers import resident, returned

END = 2
#: Pieces of text that a worker keeps by last use: when there are so many of late, those before go.
GENERATION = 600_000
#: Text that is encoded at a time: the more there is, the fewer of its pieces differ.
BATCH_BYTES = 4 << 20
#: New pieces that go to the library at a time.
NEW_PIECES = 20_000
#: Between a letter and these is a border of pretokens: a new piece that ends in them is its stem,
#: which is often known, and its tail. Only letters below LETTERS_END are taken for such, on which
#: all versions of Unicode agree. Tails of so many characters are kept.
TAIL, LETTERS_END, KEPT_TAIL = ".,;:!?#$%&*", "\u0528", 3
ROW_GROUP_BYTES, PAGE_ROWS = 16 << 20, 256
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


class Known:
    """Pieces of text and their packed ids, as Arrow has strings: looked up many at a time, without
    an object of Python's for each."""

    def __init__(self):
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.late = np.zeros(0, dtype=bool)  # those used of late

    def find(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """Where each of the pieces, which differ, is, -1 if it isn't known."""
        # What is known is looked up among the pieces, as the table of these is much smaller.
        found = np.asarray(pc.index_in(self.pieces, value_set=pieces).fill_null(-1))
        known = np.flatnonzero(found >= 0)
        self.late[known] = True
        at = np.full(len(pieces), -1)
        at[found[known]] = known
        return at

    def add(self, pieces: pa.LargeStringArray, ids: pa.LargeBinaryArray) -> None:
        self.pieces, self.ids = pa.concat_arrays([self.pieces, pieces]), pa.concat_arrays([self.ids, ids])
        self.late = np.concatenate((self.late, np.ones(len(pieces), dtype=bool)))

    def forget(self) -> None:
        """Let go of all that weren't used since the last time."""
        late = pa.array(self.late)
        self.pieces, self.ids = self.pieces.filter(late), self.ids.filter(late)
        self.late = np.zeros(len(self.pieces), dtype=bool)


def _encoder(path: str):
    """The library's tokenizer, how many bytes each id stands for, and what is kept of pieces of
    text (``pieces``) and their tails (``tails``); one per Python worker."""

    def make() -> tuple:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():  # a byte-level token has a character per byte
            lengths[i] = len(token)
        return tokenizer, lengths, {}

    return resident(("token files", path), make)


def encode_batch(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text as the library gives them, without added special tokens.

    Texts whose blanks are pretoken borders (`bpe.cuttable`) are cut there. Pieces not seen
    before go to the library joined as one text, whose ids are cut where the pieces end;
    other texts go to it whole, and so do all if a token should cross a piece's end.
    """
    tokenizer, lengths, kept = _encoder(path)
    known, tails = kept.setdefault("pieces", Known()), kept.setdefault("tails", {})
    if known.late.sum() > GENERATION:
        known.forget()
        returned()
    cut = [cuttable(t) for t in texts]
    starts, data = _strings(pa.array([t for t, c in zip(texts, cut) if c], pa.large_string()))
    # A piece begins with the blank before it; a text's first has none, and is no string here.
    begins = (data == 32) | (data == 10)
    begins[starts[:-1]] = True
    begins = np.flatnonzero(begins)
    firsts = np.searchsorted(begins, starts)
    behind = np.ones(len(begins), dtype=bool)
    behind[firsts[:-1]] = False
    pieces = _array(pa.large_string(), np.append(begins, len(data)), data, behind)
    # Pieces as places in the list of those that differ; of these, the stems.
    coded = pieces.dictionary_encode()
    stems, tail = _stems(coded.dictionary)
    stems = stems.dictionary_encode()
    at = known.find(stems.dictionary)
    missing = at < 0
    at[missing] = len(known.pieces) + np.arange(missing.sum())  # new ones are added in this order
    # By way of numpy a list of strings takes an eighth of the time that to_pylist takes.
    new = pc.utf8_ltrim(stems.dictionary.filter(pa.array(missing)), " ").to_numpy(zero_copy_only=False).tolist()
    for i in range(0, len(new), NEW_PIECES):
        if not _encode_new(tokenizer, lengths, new[i : i + NEW_PIECES], known):
            return _whole(tokenizer, texts)
    tail = tail.dictionary_encode()
    tail_ids = pa.array([_tail(tokenizer, tails, t) for t in tail.dictionary.to_pylist()], pa.large_binary()).take(tail.indices)
    packed = pc.binary_join_element_wise(known.ids.take(pa.array(at)).take(stems.indices), tail_ids, pa.scalar(b"", pa.large_binary()))
    upto, ids = _strings(packed.take(coded.indices))
    first_text = [data[i:j].tobytes().decode() for i, j in zip(starts[:-1], np.append(begins, len(data))[firsts[:-1] + 1])]
    first_ids = _whole(tokenizer, first_text)
    cut_ids = (np.concatenate(x) for x in zip(first_ids, np.split(ids.view("<u4"), upto[firsts[1:-1]] // 4)))
    whole_ids = iter(_whole(tokenizer, [t for t, c in zip(texts, cut) if not c]))
    return [next(cut_ids) if c else next(whole_ids) for c in cut]


def _strings(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string starts, and the last ends, among the bytes; the bytes."""
    _, offsets, data = strings.buffers()
    upto = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1] if offsets else np.zeros(1, dtype=np.int64)
    return upto - upto[0], np.frombuffer(data or b"", dtype=np.uint8)[upto[0] : upto[-1]]


def _array(kind: pa.DataType, upto: np.ndarray, data: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The other way round; without copies."""
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(kind, len(upto) - 1, [bits, pa.py_buffer(np.ascontiguousarray(upto, dtype=np.int64)), pa.py_buffer(data)])


def _stems(pieces: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeStringArray]:
    """Each piece without its tail, and its tail; where that wouldn't be a border, all of it and ""."""
    stems = pc.utf8_rtrim(pieces, TAIL)
    last = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
    letter = np.array([c < LETTERS_END and c.isalpha() for c in last.dictionary.to_pylist()], dtype=bool)[np.asarray(last.indices)]
    stems = pc.if_else(pa.array(letter), stems, pieces)
    upto, data = _strings(pieces)
    size = np.diff(upto) - np.diff(_strings(stems)[0])
    ends = np.concatenate(([0], np.cumsum(size)))
    return stems, _array(pa.large_string(), ends, data[np.repeat(upto[1:] - ends[1:], size) + np.arange(ends[-1])])


def _tail(tokenizer, tails: dict[str, bytes], tail: str) -> bytes:
    """The packed ids of a piece's tail; short ones are kept, of which there are few."""
    found = tails.get(tail)
    if found is None:
        found = _whole(tokenizer, [tail])[0].tobytes()
        if len(tail) <= KEPT_TAIL:
            tails[tail] = found
    return found


def _whole(tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def _encode_new(tokenizer, lengths: np.ndarray, new: list[str], known: Known) -> bool:
    """Add the packed ids of new pieces; False if a token crosses a piece's end."""
    pieces = pa.array([p if p[0] == "\n" else " " + p for p in new], pa.large_string())
    upto, data = _strings(pieces)
    ids = np.array(tokenizer.encode_batch_fast([data.tobytes().decode()], add_special_tokens=False)[0].ids, dtype="<u4")
    ends = np.cumsum(lengths[ids])
    at = np.searchsorted(ends, upto[1:]) + 1
    if at[-1] != len(ids) or (ends[at - 1] != upto[1:]).any():
        return False
    known.add(pieces, _array(pa.large_binary(), np.append(0, 4 * at), ids))
    return True


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end: int | None = END) -> None:
    """Encode every row's whole text (null: empty), append ``end``, and write the files to ``out``.

    Rows of one doc_id are in ascending order of a hash of the text, a null doc_id comes
    first; where a doc_id has more rows than a range is to have, ranges go by both.
    ``tokenizer`` must be readable on executors. An empty table makes files without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        returned()  # what the worker's last task has freed
        for batch in batches:
            for at, to in pieces(batch.column(1), BATCH_BYTES):
                b = batch.slice(at, to - at)
                ids = encode_batch(tokenizer, [t or "" for t in b.column(1).to_pylist()])
                if end is not None:
                    ids = [np.append(x, np.uint32(end)) for x in ids]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(np.full(len(n), part, dtype=np.int32)),
                        pa.array(start + ends - n),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1]) if len(ends) else 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tasks, total = text_tasks(rows)
    ids = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    cuts = range_cuts(ids, "id", tasks, min(4 * tasks, MOST_TASKS), total)
    part = range_part(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text"), cuts)
    placed = rows.repartitionById(tasks, F.floor(part.cast("long") * tasks / (len(cuts) + 1)).cast("int")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    (
        placed.mapInArrow(run, SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(out)
    )


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part and base, the ids in all parts before it: one row per file."""
    sums = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; ids aren't read."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    # One row per file: files are at least some MB of text each, so this is small whatever the corpus.
    return rows.join(F.broadcast(part_starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents with first <= doc_id <= last; the bounds
    are pushed down to row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.join(F.broadcast(part_starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def token_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (counted anew) and ids_crc32 of rows of `read_tokens`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("token checksums", lambda: None)  # a tokenizer that the worker has kept is let go
        for b in batches:
            lists = b.column(2)
            ids = np.asarray(lists.flatten(), dtype="<u4")
            ends = np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))
            starts = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
