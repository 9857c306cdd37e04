"""Typewriter notes: owned rows beside foreign ones, replaced as a set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank


def without_owned(rows: DataFrame) -> DataFrame:
    """Foreign rows only (those without a note id)."""
    return rows.where(F.col("note_id").isNull())


def replace_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """All owned rows replaced by ``notes``; the same call again changes nothing."""
    return without_owned(rows).unionByName(notes)


def committed(notes: DataFrame) -> DataFrame:
    """Notes that say something."""
    return notes.where(~is_blank(F.col("text")))


def read_notes(rows: DataFrame, page_height: float) -> DataFrame:
    """Owned rows in page order with defaults filled in, y counted from the top."""
    return rows.where(F.col("note_id").isNotNull()).select(
        "doc_id",
        "page",
        "note_id",
        F.coalesce("family", F.lit("Helvetica")).alias("family"),
        F.coalesce("size", F.lit(12.0)).alias("size"),
        F.coalesce("color", F.lit("#000000")).alias("color"),
        (F.lit(page_height) - F.col("y")).alias("y"),
    )


def text_streams(notes: DataFrame) -> DataFrame:
    """One text of all of a page's notes, in order of their ids."""
    parts = F.array_sort(F.collect_list(F.struct("note_id", "text")))
    return notes.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("stream"))


def on_pages(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """Notes on pages that are there (doc_id, page)."""
    return notes.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").select(*notes.columns)


def removed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left without the owned streams, and how many each document had."""
    return without_owned(rows), rows.groupBy("doc_id").agg(F.count_if(F.col("note_id").isNotNull()).alias("removed"))
