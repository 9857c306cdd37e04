"""Long jobs and change events. Customers' orders are a document's versions, conversations documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import shared_folder
from ..streaming import changes, jobs
from .registry import Book, table

book = Book()

_VERSIONS = "(SELECT o_custkey AS doc_id, o_orderkey AS version, min(o_orderpriority) AS pages, min(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END) AS metadata, min(o_orderkey) % 4 = 0 AS saved FROM orders GROUP BY o_custkey, o_orderkey)"
_BEFORE = f"(SELECT *, lag(pages) OVER w AS p, lag(metadata) OVER w AS m, coalesce(lag(saved) OVER w, true) AS s, row_number() OVER w AS n FROM {_VERSIONS} WINDOW w AS (PARTITION BY doc_id ORDER BY version))"


def versions(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(F.col("o_custkey").cast("long").alias("doc_id"), key.cast("long").alias("version"), F.col("o_orderpriority").alias("pages"), F.when(key % 3 > 0, F.col("o_orderstatus")).alias("metadata"), (key % 4 == 0).alias("saved"))


@book.query(f"""SELECT doc_id, version, 'pages-changed' AS event, NOT saved AS dirty FROM {_BEFORE} WHERE n > 1 AND pages IS DISTINCT FROM p
    UNION ALL SELECT doc_id, version, 'metadata-changed', NOT saved FROM {_BEFORE} WHERE n > 1 AND metadata IS DISTINCT FROM m
    UNION ALL SELECT doc_id, version, 'dirty-changed', NOT saved FROM {_BEFORE} WHERE saved <> s""")
def i02_change_events(spark, sf_dir):
    return changes.change_events(versions(table(spark, sf_dir, "orders")))


#: Batches that an export takes its source in, at least.
BATCHES = 4


def exported(spark, sf_dir, on_batch=None) -> tuple[str, dict]:
    """Conversations exported as documents, in batches of the source's files; the folder and the report."""
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    blank = lambda t: F.trim(F.coalesce(t["text"], F.lit(""))) == ""
    rows = turns.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda t: F.coalesce(t["text"], F.lit(""))), "\f").alias("content"), F.size("t").alias("pages"), F.size(F.filter("t", blank)).alias("recognised"))
    rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int")).write.partitionBy("part").parquet(f"{folder}/source")
    source = spark.read.parquet(f"{folder}/source")
    files = max(1, len(source.inputFiles()) // BATCHES)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/source")
    return folder, jobs.export(stream, f"{folder}/out", jobs.Slots(), on_batch=on_batch).wait()


@book.query("SELECT CAST(count(DISTINCT conv_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (trim(coalesce(text, '')) = '') AS BIGINT) AS recognised, true AS several FROM conversations")
def i01_export_progress(spark, sf_dir):
    """Counts of the ledger's batches, summed, and whether there was more than one."""
    folder, _ = exported(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in ("documents", "pages", "recognised")]
    return jobs.progress(spark, f"{folder}/out").agg(*sums, (F.count("*") > 1).alias("several"))


@book.query("SELECT true AS cancelled, true AS same, true AS fewer")
def i04_partial_export(spark, sf_dir):
    """An export cancelled as its first batch is done: what it reports is what is on disk, and isn't all."""
    folder, report = exported(spark, sf_dir, on_batch=lambda job, _: job.cancel())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{folder}/out/batch-0")
    total = spark.read.parquet(f"{folder}/source").agg(F.count("*").alias("total"))
    done = files.select("path").agg(F.count("*").alias("done")).join(total)
    return done.select(F.lit(report["cancelled"]).alias("cancelled"), (F.col("done") == report["documents"]).alias("same"), (F.col("done") < F.col("total")).alias("fewer"))
