"""Bottom-k sketches of shingle hashes.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's
five-word shingles (`shingles.py` defines words). Fewer than k hashes are all there are,
and then every estimate is exact. Sketches of parts merge into the sketch of the whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import MOST_TASKS, range_cuts, range_part, table_of, text_tasks
from .shingles import pieces, shingle_hashes

K = 256
_SPACE = 2.0**64


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    if len(hashes) > 8 * k:  # the k smallest are among these, unless copies crowd them out
        least = np.sort(np.partition(hashes, 4 * k)[: 4 * k])
        least = least[np.append(True, least[1:] != least[:-1])]
        if len(least) >= k:
            return least[:k]
    least = np.sort(hashes)
    return least[np.append(True, least[1:] != least[:-1])][:k] if len(least) else least


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / _SPACE)


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """Of the smallest hashes of the union that both sketches know: how many are in both, how many there are."""
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    n = len(both) - int(np.count_nonzero(twice))
    if (len(a) < k and len(b) < k) or n <= k:
        return int(np.count_nonzero(twice)), n
    first = np.ones(len(both), dtype=bool)
    first[1:] = ~twice
    last = np.searchsorted(np.cumsum(first), k)  # where the k-th distinct hash stands
    return int(np.count_nonzero(twice[: last + 1])), k


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 where neither has a shingle."""
    both, n = _shared(a, b, k)
    return both / n if n else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 where a has none."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r / (1 + r) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype="<u8")


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sketch of each text of an Arrow array."""
    out = []
    for at, to in pieces(texts):
        hashes, ends = shingle_hashes(texts.slice(at, to - at))
        start = 0
        for end in ends.tolist():
            out.append(sketch(hashes[start:end], k))
            start = end
    return out


FINGERPRINT = "fingerprint string, n_shingles double"


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated) of each row; null text counts as empty.

    One row out per row in; other columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sketches(b.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([to_text(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())],
                names=["doc_id", "fingerprint", "n_shingles"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FINGERPRINT}")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points (or all) of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"


def fingerprint_edits(docs: DataFrame, k: int = K, bytes_per_task: int = 32 << 20) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Documents follow each other in descending doc_id (null doc_ids last, rows of one doc_id
    in descending order of a hash of the text); the first follows the last. Text is shuffled
    once, by range of doc_id and, where one doc_id has very many rows, of that hash; the first
    row of each range also goes to the range before it, so that no window over all rows is
    needed. Null text counts as empty; one row out per row in.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "text")
    tasks, total = text_tasks(rows, bytes_per_task)
    cuts = range_cuts(rows.select("id"), "id", tasks, max(tasks, min(4 * tasks, MOST_TASKS)), total)
    n_parts = len(cuts) + 1
    rows = rows.select(F.struct(F.col("id").alias("id"), F.xxhash64("text").alias("hash")).alias("key"), "doc_id", "text")
    part = len(cuts) - range_part(F.col("key.id"), F.col("key.hash"), cuts)  # ascending as key descends
    firsts = rows.select("key", part.alias("part")).groupBy("part").agg(F.max("key").alias("key")).collect()
    first_key = {r["part"]: r["key"] for r in firsts}
    order = sorted(first_key)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first one's rows go to the last
    # One small row per range, in one literal each, looked up by position.
    keys = table_of([dict(zip(("id", "hash"), first_key.get(p, (None, None)))) for p in range(n_parts)], "array<struct<id:bigint,hash:bigint>>")
    to = table_of([before.get(p, 0) for p in range(n_parts)], "array<int>")
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    placed = rows.withColumn("part", part)
    places = F.when(F.col("key") == F.get(keys, F.col("part")), F.array(here, F.struct(F.get(to, F.col("part")).alias("part"), F.lit(True).alias("extra")))).otherwise(F.array(here))
    placed = placed.select("key", "doc_id", "text", F.explode(places).alias("place")).select("place.part", "place.extra", "doc_id", "text", "key")
    # A task gets ranges next to each other.
    placed = placed.repartitionById(tasks, F.floor(F.col("part").cast("long") * tasks / n_parts).cast("int"))
    placed = placed.sortWithinPartitions("part", "extra", F.desc("key"), F.desc("text")).drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before
        for batch in batches:
            for at, end in pieces(batch.column(3)):
                b = batch.slice(at, end - at)
                part, extra, key, text = (b.column(i).to_pylist() for i in range(4))
                own = sketches(b.column(3), k)
                if held is not None:
                    part, extra, key, text, own = ([h, *x] for h, x in zip(held, (part, extra, key, text, own)))
                # Of a part's extra rows only the first matters: it follows the last own row.
                todo = [i for i in range(len(part) - 1) if part[i] == part[i + 1] and not extra[i]]
                held = (part[-1], extra[-1], key[-1], text[-1], own[-1])
                if not todo:
                    continue
                edits = [edited_text(text[i], text[i + 1]) for i in todo]
                of_edits = sketches(pa.array(edits, pa.large_string()), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key[i] for i in todo], pa.int64()),
                        pa.array([len(text[i]) for i in todo], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits]),
                        pa.array([to_text(own[i]) for i in todo]),
                        pa.array([to_text(x) for x in of_edits]),
                        pa.array([resemblance(own[i], x, k) for i, x in zip(todo, of_edits)], pa.float64()),
                        pa.array([resemblance(own[i], own[i + 1], k) for i in todo], pa.float64()),
                        pa.array([distinct(own[i], k) for i in todo], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"],
                )

    return placed.mapInArrow(run, EDITED)
