"""The seam for text recognition: page images to words, by whatever engine is at hand."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Engine(Protocol):
    """Must be picklable; `recognise` runs on executors."""

    def recognise(self, image: bytes) -> list[tuple[str, float, float, float, float]]:
        """Text, x, y, width and height of each word, its origin at the bottom left."""


class WordsInBytes:
    """A stand-in for tests: the image is its text, ten points a word."""

    def recognise(self, image: bytes) -> list[tuple[str, float, float, float, float]]:
        return [(w, 10.0 * i, 0.0, 9.0, 10.0) for i, w in enumerate(w for w in image.decode().replace("\n", " ").split(" ") if w)]


#: Words that a task holds at a time, beside those of one page.
BATCH_WORDS = 4096
WORDS = "doc_id long, page long, ord long, text string, x double, y double, width double, height double"


def _word_batches(batches: Iterator[pa.RecordBatch], engine: Engine) -> Iterator[pa.RecordBatch]:
    """However many pages and words the batches hold, no more than BATCH_WORDS words are held at a time."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * 4]
    names = [x.split(" ")[0] for x in WORDS.split(", ")]
    words = ((d.as_py(), p.as_py(), k, *w) for b in batches for d, p, image in zip(*(b.column(i) for i in range(3))) for k, w in enumerate(engine.recognise(image.as_py()), 1))
    while rows := list(islice(words, BATCH_WORDS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def recognise(images: DataFrame, engine: Engine) -> DataFrame:
    """A row per word of each image (doc_id, page, image); a page without words has
    none. An image that the engine can't read fails the job."""
    from ..shipping import ship

    ship(images.sparkSession)

    return images.select("doc_id", "page", "image").mapInArrow(lambda batches: _word_batches(batches, engine), WORDS)


def register(spark, engine: Engine, name: str = "recognise") -> None:
    """Recognition as a table function of SQL, by ``engine``:
    ``SELECT * FROM recognise(TABLE(images) PARTITION BY (doc_id, page))``. ``images`` has doc_id,
    page and image; the result is that of `recognise` and error, which is why an image couldn't be
    read: such an image is one row, and the others are there."""
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    from ..shipping import ship

    ship(spark)
    schema = StructType.fromDDL(f"{WORDS}, error string")

    class Recognise:
        @staticmethod
        def analyze(images: AnalyzeArgument) -> AnalyzeResult:
            missing = {"doc_id", "page", "image"} - (set(images.dataType.names) if images.isTable else set())
            if missing:
                raise ValueError(f"recognition takes a table of images; {sorted(missing)} are missing")
            return AnalyzeResult(schema)

        def eval(self, row):
            try:
                found = list(engine.recognise(bytes(row["image"])))
            except Exception as e:  # whatever an engine makes of bytes that are no image
                yield row["doc_id"], row["page"], None, None, None, None, None, None, f"{type(e).__name__}: {e}"
                return
            for k, (text, *box) in enumerate(found, 1):
                yield row["doc_id"], row["page"], k, text, *map(float, box), None

    spark.udtf.register(name, udtf(Recognise))
