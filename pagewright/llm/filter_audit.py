r"""How five filters interact: every order of them, replayed over every document.

Each document is reduced to flags, one per filter, and crossed with the table of all orders;
per order the first step whose filter it fails is found, its steps are exploded, and counts
are conditional sums that tasks combine before anything is shuffled. DataFrame functions only.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import join_unique
from .storage import written

LETTERS = "ABCDE"
#: Least words, least percentage of different words, greatest percentage of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that see one text, by letter."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    counts = F.struct(F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("different"))
    return {
        "A": counts["words"] < LEAST_WORDS,
        "B": 100 * counts["different"] < LEAST_DISTINCT * counts["words"],
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (a bit per filter that the document fails, A the lowest), good and toxic of
    every row of ``docs``.

    A null text is empty, and a null lang is part ''. E asks whether a smaller doc_id has the
    same text, told by its SHA-256: never so for a null doc_id. A document is good (toxic) if a
    row of ``labels`` says so; a null doc_id has no labels. Keys with very many rows, texts or
    ids, are joined apart from the others.
    """
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.col("text")).values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = written(rows.select("doc_id", "part", mask.alias("mask"), F.sha2("text", 256).alias("digest")), "audit-flags")
    total = rows.count()
    rows_of_id = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    rows = join_unique(rows, texts, ["digest"], "n", total)
    repeated = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    rows = rows.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "part", (F.col("mask") + F.when(repeated, 1 << 4).otherwise(0)).alias("mask"))
    ids = rows.groupBy("no_id", "id").agg(F.count("*").alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("no_id", F.lit(False))
    ids = ids.join(said.hint("merge"), ["no_id", "id"], "left").select("no_id", "id", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return join_unique(rows, ids, ["no_id", "id"], "n", total, rows_of_id).select("part", "mask", "good", "toxic")


def all_orders(docs: DataFrame, letters: str = LETTERS) -> DataFrame:
    """filter_order and steps, an array of the filters' bits, of all permutations of ``letters``."""
    rows = [("".join(p), [1 << letters.index(x) for x in p]) for p in itertools.permutations(letters)]
    return docs.sparkSession.createDataFrame(rows, "filter_order string, steps array<int>")


def replay(flags: DataFrame, orders: DataFrame) -> DataFrame:
    """part, filter_order, step and counts: how every order of the filters takes the documents
    of ``flags`` (part, mask, good, toxic) down. ``orders`` is a table of permutations, so its
    size is known, and it is broadcast."""
    n = len(LETTERS)
    crossed = flags.crossJoin(F.broadcast(orders))
    fails = lambda k: F.get("steps", F.lit(k)).bitwiseAND(F.col("mask")) != 0
    first = F.lit(n + 1)
    for k in reversed(range(n)):
        first = F.when(fails(k), k + 1).otherwise(first)
    steps = crossed.withColumn("first", first).select("part", "mask", "good", "toxic", "filter_order", "first", F.posexplode("steps").alias("pos", "bit"))
    step = F.col("pos") + 1
    here = F.col("first") == step
    count = lambda condition, name: F.sum(F.when(condition, F.lit(1)).otherwise(0)).cast("long").alias(name)
    counts = steps.groupBy("part", "filter_order", step.alias("step"), "bit").agg(
        count(F.col("first") > step, "kept"),
        count(here, "removed"),
        count((F.col("first") < step) & (F.col("mask").bitwiseAND(F.col("bit")) != 0), "redundant"),
        count(F.col("mask") == F.col("bit"), "unique_fails"),
        count(here & F.col("good"), "good_lost"),
        count(here & F.col("toxic"), "toxic_lost"),
    )
    return counts


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; zeros are rows too. What of its filter's
    removals all orders together make is in ``shapley``. An empty table gives no rows; other
    columns are ignored. After `replay` there are 600 rows a part, whatever the documents."""
    counts = written(replay(flagged(docs, labels), all_orders(docs)), "audit-counts")
    every = counts.groupBy("part", "bit").agg(F.sum("removed").cast("long").alias("shapley"))
    rows = counts.join(every, ["part", "bit"])
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
