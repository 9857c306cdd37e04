"""Pages of PDF files, and the sink of their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import Rounds
from .objects import page_rows, parse_objects


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the PDF files at ``path``, read where Spark reads them."""
    return parse_pages(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path))


def parse_pages(files: DataFrame) -> DataFrame:
    """Path, page, width, height, rotation, linearized and error of every page of files
    (path, content). What can't be read, of a file or of its page tree, is a row with an error and
    no page; a file's other pages are there. The objects are written once and joined."""
    objects, _ = Rounds(files.sparkSession).keep(parse_objects(files))
    flags = objects.where("object IS NULL").select("path", F.coalesce(F.col("entries")["Linearized"] == "true", F.lit(False)).alias("linearized"))
    return page_rows(objects).join(flags, "path").select("path", "page", "width", "height", "rotation", "linearized", "error")


def write_text(exported: DataFrame, path: str) -> None:
    """A05's sink: one text file per document (doc_id, exported) below ``path``, all or none."""
    exported.select(F.col("exported").alias("value"), "doc_id").write.mode("errorifexists").partitionBy("doc_id").option("lineSep", "\n").text(path)
