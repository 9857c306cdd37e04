r"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Every document is queued once per epoch in its source's shuffled order. Its virtual finish
time is the source's words up to and with it divided by the source's target, so all sources
run out together at time 1; the queue of all sources is ordered by finish time and cut
where the words taken would pass the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import HOT_SHARE, join_unique
from .storage import identified, written

WEIGHTS = (5, 2, 1)
#: Of all words, how many the mix takes; how often a document may be taken.
BUDGET, EPOCHS = 1.5, 2


def n_words(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """no_source, source_key, n, source_size, place and target of each source of
    (no_source, source_key, size). Targets share ``budget`` times all words by weight; a target
    stops at ``epochs`` times its source's words and the excess goes to the others by weight,
    which is min(cap, level * weight) with the level that spends the budget. One row per
    source throughout: the windows here run over sources, never over documents."""
    src = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    src = src.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("no_source", "source_key")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    src = src.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs)).withColumn("spend", F.sum("source_size").over(everything) * float(budget))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "place")
    full_before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", (F.col("spend") - full_before) / weight_left).withColumn("order", F.row_number().over(by_ratio))
    # The first source, by cap over weight, that the level doesn't fill sets the level for the rest.
    src = src.withColumn("first", F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("order", "level"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("order") < F.col("first.order")), F.col("cap")).otherwise(F.col("first.level") * F.col("weight"))
    return src.select("no_source", "source_key", "n", "source_size", "place", target.alias("target"))


#: Hexadecimal digits of the shuffle key that stand for doc_id, for the text, and for the row.
DIGITS = (32, 16, 16)


def _buckets(rows: DataFrame, digits: int, total: int) -> DataFrame:
    """``rows`` with the bucket of their shuffle key: its first digits. Buckets of more than a
    thousandth of the rows, and of four times their even share, hold rows alike in doc_id;
    they are cut by the digits of the text, and where those are alike too by those of the row,
    so that any number can be repeated."""
    most = max(total // HOT_SHARE, 4 * total // 16**digits, 64)
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    for upto in (DIGITS[0] + digits, sum(DIGITS[:2]) + digits):
        hot = rows.groupBy("bucket").agg(F.count("*").alias("k")).where(F.col("k") > most).select("bucket", F.lit(True).alias("hot"))
        if hot.isEmpty():  # nor does cutting on
            return rows
        rows = rows.join(F.broadcast(hot), "bucket", "left").withColumn("bucket", F.when(F.col("hot"), F.substring("key", 1, upto)).otherwise(F.col("bucket"))).drop("hot")
    return rows


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = "mix", locator: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and locator of every row. The locator
    is that column of ``docs``, unique by row, or a number given here.

    Null text has size 0; null is a source of its own, the last; a document without words is
    never taken. Rows alike in doc_id are shuffled next to each other, by text; a rerun gives
    the same rows. An empty table gives no rows. Running sums have two levels: buckets of the
    shuffle key per source, then rows within a bucket, so no task holds more than about the
    square root of a source, or a thousandth.
    """
    if epochs != 2:
        raise ValueError("two epochs are supported")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        n_words(F.col("text")).alias("size"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
        F.xxhash64("text").alias("text_hash"),
        (docs[locator].cast("long") if locator else F.monotonically_increasing_id()).alias("locator"),
    )
    hashed = lambda column: F.lpad(F.hex(F.xxhash64(column)), 16, "0")
    shuffled = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    key = F.concat(shuffled, hashed("text_hash"), hashed("locator"))
    rows = written(rows.select("doc_id", "size", "no_source", "source_key", "locator", key.alias("key")), "mix-sizes")
    total = rows.count()
    digits = max(1, round(math.log(max(total, 1)) / 2 / math.log(16)))
    source = ["no_source", "source_key"]
    src = written(source_targets(rows, weights, budget, epochs), "mix-sources")
    bucketed = _buckets(rows, digits, total)
    sums = bucketed.groupBy(*source, "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(*source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*source, "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*source, "bucket").orderBy("key", "locator").rowsBetween(Window.unboundedPreceding, 0)
    queue = bucketed.withColumn("run", F.sum("size").over(within)).join(sums.hint("merge"), [*source, "bucket"])
    queue = join_unique(queue, src, source, "n", total)
    ends = F.col("base") + F.col("run")
    finish = lambda words: F.when(F.col("size") > 0, words / F.col("target"))
    queue = queue.select("doc_id", "locator", "key", "size", "source_size", "target", "place", finish(ends).alias("first"), finish(ends + F.col("source_size")).alias("second"))
    queue = written(queue, "mix-queue")

    # The queue in ranges of finish time: words per range, then the one range the cut falls in.
    ranges = float(16**digits)
    item = lambda finish, copy: F.struct(F.col(finish).alias("finish"), "place", "key", "locator", "size", F.lit(copy).alias("copy"))
    items = queue.where("size > 0").select(F.explode(F.array(item("first", 1), item("second", 2))).alias("item"))
    items = items.withColumn("range", F.floor(F.least(F.col("item.finish"), F.lit(2.0)) * ranges))
    spend = float(budget) * (queue.agg(F.sum("size")).first()[0] or 0)
    upto = Window.partitionBy(F.lit(0)).orderBy("range")
    words = items.groupBy("range").agg(F.sum("item.size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    cut = words.where(F.col("upto") > spend).agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("base")))).first()[0]
    last = None
    if cut is not None:
        edge = items.where(F.col("range") == cut["range"])
        edge = edge.withColumn("upto", F.lit(cut["base"]) + F.sum("item.size").over(Window.partitionBy("range").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)))
        last = edge.where(F.col("upto") <= spend).agg(F.max("item")).first()[0]

    def taken(finish: str, copy: int) -> Column:
        if cut is None:
            return F.lit(1)
        where = F.floor(F.least(F.col(finish), F.lit(2.0)) * ranges)
        inside = where < cut["range"]
        if last is not None:
            bound = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["place"]).alias("place"), F.lit(last["key"]).alias("key"), F.lit(last["locator"]).cast("long").alias("locator"), F.lit(last["size"]).cast("long").alias("size"), F.lit(last["copy"]).alias("copy"))
            inside |= (where == cut["range"]) & (item(finish, copy) <= bound)
        return inside.cast("int")

    copies = F.when(F.col("size") > 0, taken("first", 1) + taken("second", 2)).otherwise(0)
    return queue.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "locator")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (all columns), each as often as the mix takes it; repeated rows are
    rows of their own. Rows are met by doc_id where that tells them apart, else by a number."""
    rows, locator = identified(docs, "mix-located")
    of = mix(rows, locator=locator, **how).where("copies > 0").select(F.col("locator").cast(rows.schema[locator].dataType).alias(locator), F.expr("sequence(1, copies)").alias("copies"))
    joined = rows.select(F.col(locator), F.struct(*docs.columns).alias("row")).join(of.hint("merge"), locator)
    return joined.select("row", F.explode("copies")).select("row.*")
