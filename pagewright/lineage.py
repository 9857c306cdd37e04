"""Tables that are built in rounds: each is written, so that plans stay short and a lost executor
costs a round at most."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Where none is named, a folder
    of this machine is made, if the master is local; a cluster must name one that its machines
    share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="pagewright-rounds-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows over all tasks by ``columns``, where what follows costs much more than their few bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


class Rounds:
    """Tables of one computation; all but those still to be read can be deleted on the way."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
        """``df`` written and read again, and how many rows (that meet a condition) it has, counted
        while they were written."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        seen = Observation()
        rows = df.observe(seen, F.count(F.when(condition, 1) if condition is not None else F.lit(1)).alias("n"))
        rows.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def forget(self, upto: int) -> None:
        """Delete the tables up to number ``upto``; those that aren't there any more are skipped."""
        context = self.spark.sparkContext
        for k in range(1, upto + 1):
            where = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{k}")
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
