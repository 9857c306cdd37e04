"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of `scratch` that are open, by thread: pipelines side by side don't share them.
_open = threading.local()


def _folders() -> list[str]:
    if not hasattr(_open, "folders"):
        _open.folders = []
    return _open.folders


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, or below the folder of `scratch`.

    Where that setting is absent (tests, a single machine) a folder is made once,
    kept in the session's settings and deleted when Python ends. A cluster has no folder of
    that kind that its machines share, so there the setting must be made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pagewright-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{(_folders()[-1] if _folders() else base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever file system that is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A folder for all that is written in the block, deleted at its end: what is still to be
    read later must have been written to a path taken before."""
    _folders().append(shared_path(spark, "scratch"))
    try:
        yield
    finally:
        delete(spark, _folders().pop())


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again (cuts lineage)."""
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` and a column of integers that tells its rows apart.

    That is doc_id, where it is never null or repeated. Else the rows are written with a
    further column of numbers; being written, they stay what they are.
    """
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    if ids.where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs, next(c for c in docs.columns if c.lower() == "doc_id")
    locator = free_name(docs, "locator")
    return written(docs.withColumn(locator, F.monotonically_increasing_id()), name), locator


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
