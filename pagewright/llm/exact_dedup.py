r"""Exact deduplication as a stream over disk-backed keyed state.

Texts are equal when they are identical after deleting every character of
``[\x20\x09-\x0D]``. Rows reduced to digest, identifier and locator run through a streaming
aggregation whose state (RocksDB, no expiry) keeps per digest the row that stays, its
locator and the number of rows. For every digest that was hit more than once the full
normalised bytes are then compared; should one digest stand for several texts, its rows are
grouped anew by the bytes themselves. DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import join_unique
from .storage import identified, shared_path, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _rank(n_chars: str, doc_id: str, locator: str) -> Column:
    """Least for the row that stays: most code points, then smallest doc_id (null last), then locator."""
    return F.struct((-F.col(n_chars)).alias("minus_chars"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(locator).alias("locator"))


def keyed_state(rows: DataFrame) -> DataFrame:
    """digest, best (the row that stays) and n (rows so far) of a batch or stream of
    (digest, n_chars, doc_id, locator); on a stream this is the keyed state, without expiry."""
    return rows.groupBy("digest").agg(F.min(_rank("n_chars", "doc_id", "locator")).alias("best"), F.count("*").alias("n"))


#: Bytes that one state store is meant to hold on its disk, and about how many a key takes there.
#: The number of stores is fixed by the first run.
BYTES_PER_STORE, KEY_BYTES = 1 << 30, 200
LEAST_STORES = 12
#: Memory of all stores of an executor, beside its heap.
STORES_MB = 200


def _session(spark: SparkSession, stores: int) -> SparkSession:
    """A session on the same context whose streams keep state in so many RocksDB stores."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.internal.stateStore.partitions", str(stores))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Files aren't extended ahead of need: there is one store per state partition.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # An executor's stores share so much memory, however many they are.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STORES_MB))
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return own


def run_stream(spark: SparkSession, source: str, schema, state_path: str, out_path: str, stores: int, files_per_batch: int | None = None) -> None:
    """Feed the Parquet files of ``source`` that the checkpoint at ``state_path`` hasn't seen
    into the state; what changed goes to ``out_path``/batch=N. Call it again as files arrive:
    state, and the answer, carry on where they were."""
    own = _session(spark, stores)
    reader = own.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out_path}/batch={batch}")

    stream = keyed_state(reader.parquet(source)).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state_path).trigger(availableNow=True).start()
    stream.awaitTermination()


def latest(spark: SparkSession, out_path: str, schema) -> DataFrame:
    """The state as of the last batch: counts only grow, so of a digest's rows the last has most."""
    rows = spark.read.schema(schema).parquet(f"{out_path}/batch=*")
    return rows.groupBy("digest").agg(F.max_by("best", "n").alias("best"), F.max("n").alias("n"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] | None = None, files_per_batch: int | None = None, locator: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and locator of every row of ``docs``.

    Null text counts as empty; a null doc_id is a document like others and stays only if no
    other row can; of rows alike in all this the first as stored stays. An empty table gives
    no rows; other columns are ignored. ``digest`` (of the normalised text) may be weak: full
    bytes decide. The locator is that column of ``docs``, unique by row, or a number given here.
    """
    spark = docs.sparkSession
    digest = digest or (lambda text: F.sha2(text, 256))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (docs[locator].cast("long") if locator else F.monotonically_increasing_id()).alias("locator"))
    plain = source.select("doc_id", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("plain"), "locator")
    # The locator is fixed by being written; it addresses a row of this table for good.
    path = shared_path(spark, "exact-rows")
    plain.select("doc_id", "n_chars", digest(F.col("plain")).alias("digest"), F.sha2("plain", 256).alias("text_sha256"), "locator").write.parquet(path)
    schema = spark.read.parquet(path).schema
    rows = spark.read.schema(schema).parquet(path)
    total = rows.count()
    if not total:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "locator")
    out = shared_path(spark, "exact-state-rows")
    run_stream(spark, path, schema, shared_path(spark, "exact-state"), out, max(LEAST_STORES, math.ceil(total * KEY_BYTES / BYTES_PER_STORE)), files_per_batch)
    state = written(latest(spark, out, keyed_state(rows).schema), "exact-groups")

    # Full bytes of the hits: how many texts each digest stands for.
    texts = plain.select(digest(F.col("plain")).alias("digest"), "plain")
    hit = join_unique(texts, state.where("n > 1").select("digest", "n"), ["digest"], "n", total)
    several = written(hit.groupBy("digest", "plain").agg(F.count("*").alias("k")).groupBy("digest").agg(F.count("*").alias("texts"), F.sum("k").alias("n")).where("texts > 1"), "exact-several")

    group = state.select("digest", "best", "n", F.col("n").alias("group_size"))
    if several.isEmpty():
        return _answer(join_unique(rows, group, ["digest"], "n", total))
    alone = join_unique(rows, group.join(several.select("digest"), "digest", "left_anti"), ["digest"], "n", total)
    # Rows of digests with several texts: group by the bytes.
    again = plain.withColumn("digest", digest(F.col("plain"))).join(several.select("digest"), "digest", "left_semi")
    again = written(again.select("doc_id", "n_chars", "plain", F.sha2("plain", 256).alias("text_sha256"), "locator"), "exact-again")
    by_bytes = again.groupBy("plain").agg(F.min(_rank("n_chars", "doc_id", "locator")).alias("best"), F.count("*").alias("n"))
    by_bytes = by_bytes.withColumn("group_size", F.col("n"))
    return _answer(alone).unionByName(_answer(join_unique(again, by_bytes, ["plain"], "n", total)))


def _answer(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("best.locator")).alias("kept"), "text_sha256", "locator")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one of each group of equal texts, of
    repeated rows too. Rows are met by doc_id where that tells them apart, else by a number."""
    rows, locator = identified(docs, "exact-located")
    kept = exact_groups(rows, locator=locator).where("kept").select(F.col("locator").cast(rows.schema[locator].dataType).alias(locator))
    return rows.join(kept.hint("merge"), locator, "left_semi").select(*docs.columns)
