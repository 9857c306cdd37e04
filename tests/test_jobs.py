"""Exports that are cancelled, lost and started again, slots, progress, and change events."""

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from pagewright.streaming import changes, jobs

DOCS = "doc_id long, content string, pages int, recognised int"


@pytest.fixture
def stream(spark, tmp_path):
    """Six files of ten documents."""
    rows = [(k, f"text {k}", k % 3, k % 2) for k in range(60)]
    spark.createDataFrame(rows, DOCS).repartitionByRange(6, "doc_id").write.parquet(f"{tmp_path}/in")
    assert len(glob.glob(f"{tmp_path}/in/*.parquet")) == 6
    return spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def files(path):
    return sorted(int(os.path.basename(f)[:-4]) for f in glob.glob(f"{path}/batch-*/**/*.txt", recursive=True))


def test_a_cancelled_export_reports_what_is_there_and_goes_on(spark, stream, tmp_path):
    path, told = f"{tmp_path}/out", []

    def third(job, row):
        told.append(row)
        if row["batch"] == 2:
            job.cancel()
            raise RuntimeError("lost before the stream knew that the batch was done")

    report = jobs.export(stream, path, jobs.Slots(), on_batch=third).wait()
    done = files(path)
    assert report["cancelled"] and report["documents"] == len(done) == 30 and report["pages"] == sum(k % 3 for k in done) and report["recognised"] == sum(k % 2 for k in done)
    assert [r["batch"] for r in told] == [0, 1, 2] and sum(r["documents"] for r in told) == 30 and not glob.glob(f"{path}/*.writing-*")
    # The files of the last batch are there, its entry was lost: it isn't written again.
    shutil.rmtree(f"{path}/ledger/batch=2")
    report = jobs.export(stream, path, jobs.Slots()).wait()
    assert report == {"documents": 60, "pages": 60, "recognised": 30, "cancelled": False} and files(path) == list(range(60))
    assert [r["documents"] for r in jobs.progress(spark, path).orderBy("batch").collect()] == [10] * 6


def test_a_running_batch_is_broken_off(spark, stream, tmp_path):
    """Its tasks sleep for 20 seconds; a new job of the kind takes its slot."""
    slots, path = jobs.Slots(), f"{tmp_path}/out"

    @F.udf("string")
    def late(text):
        import time

        time.sleep(2)
        return text

    job = jobs.export(stream.withColumn("content", late("content")), path, slots)
    while not spark.sparkContext.statusTracker().getActiveJobsIds():
        assert job.query.isActive
    other = jobs.export(stream, f"{tmp_path}/other", slots)
    report = job.wait()
    assert report == {"documents": 0, "pages": 0, "recognised": 0, "cancelled": True} and files(path) == []
    assert other.wait()["documents"] == 60 and slots.cancel("export") and not slots.cancel("margins")


def test_a_failing_export_raises(spark, stream, tmp_path):
    bad = stream.withColumn("verified", F.col("doc_id") != 5)
    with pytest.raises(Exception, match="verified"):
        jobs.export(bad, f"{tmp_path}/out", jobs.Slots()).wait()
    assert 5 not in files(f"{tmp_path}/out")


VERSIONS = "doc_id long, version long, pages string, metadata string, saved boolean"


def test_events_once_per_change(spark, tmp_path):
    """The feed of versions in batches, with replays, and the table of all agree with a loop."""
    r = random.Random(3)
    rows = [(d, v, r.choice(["p", "q", None]), r.choice(["m", None]), r.choice([True, False, None])) for d in range(8) for v in range(12)]
    want = set()
    for d, v, p, m, s in rows:
        b = rows[d * 12 + v - 1] if v else None
        want |= {(d, v, e, not s) for e, i in (("pages-changed", 2), ("metadata-changed", 3)) if b and b[i] != (p, m)[i - 2]}
        want |= {(d, v, "dirty-changed", not s)} if bool(s) != (bool(b[4]) if b else True) else set()
    odd = [(None, 1, "p", "m", True), (1, None, "p", "m", True)]
    table = spark.createDataFrame(rows + rows[:30] + odd, VERSIONS).withColumn("event", F.lit("clash"))
    got = [tuple(x) for x in changes.change_events(table).collect()]
    assert len(got) == len(want) and set(got) == want
    os.makedirs(f"{tmp_path}/in")
    query = changes.change_feed(spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    seen = []
    # A batch each: versions 0 to 5, the same again, and the rest with some of the old ones.
    for part in (rows_of(rows, range(6)) + odd, rows_of(rows, range(6)), rows_of(rows, range(3, 12))):
        spark.createDataFrame(part, VERSIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = query.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, _: seen.extend(tuple(x) for x in b.collect())).trigger(availableNow=True).start()
        run.awaitTermination()
    assert len(seen) == len(want) and set(seen) == want
    assert changes.change_events(table.limit(0)).collect() == []


def rows_of(rows, numbers):
    return [x for x in rows if x[1] in numbers]
