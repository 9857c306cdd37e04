"""Long jobs that report progress, can be cancelled and say what they had done.

A job is a stream of documents taken batch by batch, so that each row is read once. A batch is written
whole by the sink of `sources.text_files` and then entered in the ledger; what was cancelled or lost
within a batch leaves nothing. Started again on the same folder, a job goes on behind its last batch.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import text_files

LEDGER = "batch long, documents long, pages long, recognised long"


@dataclass
class Job:
    kind: str
    path: str
    spark: SparkSession
    stopped: threading.Event = field(default_factory=threading.Event)
    query: StreamingQuery | None = None

    @property
    def tag(self) -> str:
        return f"pagewright-{self.kind}-{id(self)}"

    def cancel(self) -> None:
        """Begin no further batch and break off the one that runs, also one that is about to begin."""
        self.stopped.set()

        def break_off() -> None:
            while self.query is None or self.query.isActive:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
                time.sleep(0.2)

        threading.Thread(target=break_off, daemon=True).start()

    def wait(self) -> dict:
        """Block until the job ends; documents, pages and recognised pages done, and whether it was
        cancelled before its end. An error of the job itself is raised."""
        failed = None
        try:
            self.query.awaitTermination()
        except Exception as e:  # noqa: BLE001 - a cancelled batch fails in one of many ways
            failed = e
        if failed and not self.stopped.is_set():
            raise failed
        done = progress(self.spark, self.path).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "pages", "recognised")]).first()
        return {**done.asDict(), "cancelled": failed is not None}


class Slots:
    """One running job per kind. A new job of a kind takes the slot; the one before is cancelled."""

    def __init__(self):
        self._lock, self._jobs = threading.Lock(), {}

    def take(self, job: Job) -> None:
        with self._lock:
            before, self._jobs[job.kind] = self._jobs.get(job.kind), job
        if before:
            before.cancel()

    def cancel(self, kind: str) -> bool:
        """Cancel the job of a kind; whether there was one."""
        with self._lock:
            job = self._jobs.get(kind)
        if job:
            job.cancel()
        return job is not None


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Cancelled(Exception):
    pass


def export(documents: DataFrame, path: str, slots: Slots, kind: str = "export", on_batch=None) -> Job:
    """Write a stream of documents (doc_id, content, pages, recognised: numbers of pages; verified, if
    there) below ``path``: files of batch n in ``batch-n``, the ledger in ``ledger``, the stream's
    offsets in ``offsets``. ``on_batch(job, row)`` is told each entry of the ledger (I01)."""
    spark = documents.sparkSession
    text_files.register(spark)
    job = Job(kind, path.rstrip("/"), spark)

    def write(batch: DataFrame, number: int) -> None:
        if job.stopped.is_set():
            raise Cancelled(kind)
        session = batch.sparkSession
        if _exists(session, f"{job.path}/ledger/batch={number}/_SUCCESS"):
            return
        counts = [F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "recognised")]]
        session.sparkContext.addJobTag(job.tag)
        try:
            if _exists(session, f"{job.path}/batch-{number}"):
                # The files were there when the job was lost; only the entry is missing.
                row = batch.agg(*counts).first().asDict()
            else:
                seen = Observation()
                kept = [c for c in ("doc_id", "content", "verified") if c in batch.columns]
                batch.observe(seen, *counts).select(*kept).write.format("document_files").option("path", f"{job.path}/batch-{number}").mode("append").save()
                row = seen.get
        finally:
            session.sparkContext.removeJobTag(job.tag)
        entry = session.range(1).select(*[F.lit(row[c]).cast("long").alias(c) for c in ("documents", "pages", "recognised")])
        entry.coalesce(1).write.mode("overwrite").parquet(f"{job.path}/ledger/batch={number}")
        if on_batch:
            on_batch(job, {"batch": number, **row})

    slots.take(job)
    job.query = documents.writeStream.foreachBatch(write).option("checkpointLocation", f"{job.path}/offsets").trigger(availableNow=True).start()
    return job


def progress(spark: SparkSession, path: str) -> DataFrame:
    """batch, documents, pages and recognised of each batch that is done."""
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("basePath", f"{path}/ledger").parquet(f"{path}/ledger")
