"""Search over documents as they arrive: the same expressions on an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import search_pages


def search_arrivals(spark: SparkSession, path: str, schema, query: str, files_per_batch: int = 16, **options) -> DataFrame:
    """Hits (doc_id, page, n_matches) in Parquet files of pages (doc_id, page, text) that arrive in a folder."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return search_pages(pages, query, **options)


def hits_per_window(hits: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Hits (seen: timestamp, n_matches) per window of time; rows later than ``late`` are left out
    and closed windows leave the state."""
    return hits.withWatermark("seen", late).groupBy(F.window("seen", window).alias("window")).agg(F.sum("n_matches").alias("n_matches"))
