"""Notes on pages. Rows are events: those of users with an even number are owned notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import notes as N
from .registry import Book, table

book = Book()

_ROWS = "(SELECT user_id AS doc_id, CAST(event_id % 5 + 1 AS BIGINT) AS page, CASE WHEN event_id % 2 = 0 THEN event_id END AS note_id, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END AS text, CASE WHEN event_id % 4 = 0 THEN 'Times' END AS family, CASE WHEN event_id % 6 = 0 THEN 9.0::DOUBLE END AS size, CASE WHEN event_id % 8 = 0 THEN '#ff0000' END AS color, CAST(event_id % 700 AS DOUBLE) AS y FROM events)"


def rows(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        (e % 5 + 1).alias("page"),
        F.when(e % 2 == 0, e).alias("note_id"),
        F.when(e % 3 == 0, " ").otherwise(F.col("event_type")).alias("text"),
        F.when(e % 4 == 0, "Times").alias("family"),
        F.when(e % 6 == 0, 9.0).alias("size"),
        F.when(e % 8 == 0, "#ff0000").alias("color"),
        (e % 700).cast("double").alias("y"),
    )


@book.query(f"SELECT doc_id, page, note_id IS NOT NULL AS owned FROM {_ROWS}")
def b25_owned(spark, sf_dir):
    return rows(spark, sf_dir).select("doc_id", "page", F.col("note_id").isNotNull().alias("owned"))


@book.query(f"SELECT doc_id, page, text FROM {_ROWS} WHERE trim(text) <> ''")
def b30_committed_notes(spark, sf_dir):
    return N.committed(rows(spark, sf_dir)).select("doc_id", "page", "text")


@book.query(f"SELECT doc_id, page, note_id, text FROM {_ROWS} WHERE note_id IS NULL UNION ALL SELECT r_regionkey, 1, r_regionkey, r_name FROM region")
def g16_replace_notes(spark, sf_dir):
    old = rows(spark, sf_dir).select("doc_id", "page", "note_id", "text")
    new = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page"), F.col("r_regionkey").cast("long").alias("note_id"), F.col("r_name").alias("text"))
    return N.replace_notes(N.replace_notes(old, new), new)


@book.query(f"SELECT doc_id, page, text FROM {_ROWS} WHERE note_id IS NULL")
def g17_remove_notes(spark, sf_dir):
    return N.without_owned(rows(spark, sf_dir)).select("doc_id", "page", "text")


@book.query(f"SELECT doc_id, CAST(count(*) FILTER (note_id IS NOT NULL) AS BIGINT) AS removed, CAST(count(*) FILTER (note_id IS NULL) AS BIGINT) AS kept FROM {_ROWS} GROUP BY doc_id")
def g18_remove_text_layer(spark, sf_dir):
    """How many owned streams go from each document, and how many are in what is left."""
    left, gone = N.removed(rows(spark, sf_dir))
    kept = left.groupBy("doc_id").agg(F.count("*").alias("kept"))
    return gone.join(kept, "doc_id", "left").select("doc_id", "removed", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))


@book.query(f"SELECT doc_id, page, string_agg(text, chr(10) ORDER BY note_id) AS stream FROM {_ROWS} WHERE note_id IS NOT NULL GROUP BY doc_id, page")
def g19_text_streams(spark, sf_dir):
    return N.text_streams(rows(spark, sf_dir).where("note_id IS NOT NULL"))


@book.query(f"SELECT doc_id, page, note_id, coalesce(family, 'Helvetica') AS family, coalesce(size, 12.0::DOUBLE) AS size, coalesce(color, '#000000') AS color, 792.0::DOUBLE - y AS y FROM {_ROWS} WHERE note_id IS NOT NULL")
def g20_read_notes(spark, sf_dir):
    return N.read_notes(rows(spark, sf_dir), 792.0)


@book.query(f"SELECT doc_id, page, note_id, family = 'Helvetica' AND size = 12.0::DOUBLE AND color = '#000000' AS plain, 595.0::DOUBLE - y AS y FROM (SELECT doc_id, page, note_id, coalesce(family, 'Helvetica') AS family, coalesce(size, 12.0::DOUBLE) AS size, coalesce(color, '#000000') AS color, y FROM {_ROWS} WHERE note_id IS NOT NULL)")
def g21_reconstruct_note(spark, sf_dir):
    """On lower pages; whether all of a note's style is the default."""
    notes = N.read_notes(rows(spark, sf_dir), 595.0)
    plain = (F.col("family") == "Helvetica") & (F.col("size") == 12.0) & (F.col("color") == "#000000")
    return notes.select("doc_id", "page", "note_id", plain.alias("plain"), "y")
