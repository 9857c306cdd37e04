"""Overlap of rectangles on crowded pages: pages are cut into cells, so that one page is many keys.

Rectangles are (doc_id, page, x, y, width, height). Only rectangles that are wider and higher than
the overlap asked for can meet anything; others, and those with a null or non-finite side, meet
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

PAGE, RECT = ["doc_id", "page"], ["x", "y", "width", "height"]
#: Side of the cells of the finest level, by how much a level is coarser than the one before, and
#: the level that is one cell for all (sides beyond 16,384 points, more than a page may have).
SIDE, STEP, TOP = 16.0, 4.0, 6


def level(r: Column) -> Column:
    """The finest level whose cells are no smaller than a rectangle, which meets four there at most."""
    longest = F.greatest(r["width"], r["height"])
    found = F.lit(TOP)
    for k in reversed(range(TOP)):
        found = F.when(longest <= SIDE * STEP**k, F.lit(k)).otherwise(found)
    return found


def _cell(v: Column, at: Column) -> Column:
    return F.when(at == TOP, F.lit(0).cast("long")).otherwise(F.floor(v / (SIDE * F.pow(F.lit(STEP), at))).cast("long"))


def _in_cells(rows: DataFrame, r: str, own: str, other: str, levels: Column) -> DataFrame:
    """A row per cell of a rectangle and per level of the other side: two rectangles meet in cells
    of the coarser one's level. ``levels`` are those the other side has."""
    rows = rows.withColumn(own, level(F.col(r))).withColumn(other, F.explode(levels))
    at, box = F.greatest(own, other), F.col(r)
    rows = rows.withColumn("_at", at)
    span = lambda low, high: F.explode(F.sequence(_cell(low, F.col("_at")), _cell(high, F.col("_at"))))
    return rows.withColumn("_cx", span(box["x"], G.right(box))).withColumn("_cy", span(box["y"], G.bottom(box))).drop("_at")


def _sound(rows: DataFrame, least: float) -> DataFrame:
    """Rows that can overlap something, with their rectangle as ``_r``."""
    finite = F.lit(True)
    for c in RECT:
        finite = finite & F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    return rows.where(finite & (F.col("width") > least) & (F.col("height") > least)).withColumn("_r", G.rect(*(F.col(c).cast("double") for c in RECT)))


def _levels(rows: DataFrame) -> Column:
    """The levels that occur, seven at most, as a scalar subquery."""
    return rows.select(level(F.col("_r")).alias("l")).agg(F.collect_set("l").alias("l")).scalar()


def pairs(left: DataFrame, right: DataFrame, least: float = G.LEAST_OVERLAP) -> DataFrame:
    """Each pair of a left and a right rectangle of a page that share more than ``least`` points in
    both directions, once: in the lowest of the cells they share. Columns are doc_id, page, l and r
    (structs of all columns of either side)."""
    sides = {}
    for name, rows in (("l", left), ("r", right)):
        sides[name] = _sound(rows, least).select(*PAGE, F.struct(*rows.columns).alias(name), F.col("_r").alias(f"_{name}"))
    levels = {n: _levels(d.withColumnRenamed(f"_{n}", "_r")) for n, d in sides.items()}
    # The left side is joined first to levels of the right one, and the other way round.
    a = _in_cells(sides["l"], "_l", "_la", "_lb", levels["r"])
    b = _in_cells(sides["r"], "_r", "_lb", "_la", levels["l"])
    met = a.join(b, [*PAGE, "_la", "_lb", "_cx", "_cy"])
    at = F.greatest("_la", "_lb")
    first = lambda f: F.greatest(_cell(f(F.col("_l")), at), _cell(f(F.col("_r")), at))
    lowest = (F.col("_cx") == first(lambda r: r["x"])) & (F.col("_cy") == first(lambda r: r["y"]))
    return met.where(lowest & G.overlaps(F.col("_l"), F.col("_r"), least)).select(*PAGE, "l", "r")


def _rectangles(rows: DataFrame) -> DataFrame:
    return rows.select(*PAGE, *RECT).distinct()


def hit(left: DataFrame, right: DataFrame, least: float = G.LEAST_OVERLAP) -> DataFrame:
    """doc_id, page and rectangle, each once, of the left rectangles that overlap one of the right.
    What is left of a pair is the left rectangle alone, combined before it is shuffled."""
    met = pairs(_rectangles(left), _rectangles(right), least)
    return met.select(*(F.col(f"l.{c}").alias(c) for c in (*PAGE, *RECT))).distinct()


def meeting(left: DataFrame, right: DataFrame, least: float = G.LEAST_OVERLAP) -> DataFrame:
    """The left rows whose rectangle overlaps one of the right, each as often as it is there."""
    return left.join(hit(left, right, least), [*PAGE, *RECT], "left_semi").select(*left.columns)


def apart(left: DataFrame, right: DataFrame, least: float = G.LEAST_OVERLAP) -> DataFrame:
    """The left rows whose rectangle overlaps none of the right."""
    return left.join(hit(left, right, least), [*PAGE, *RECT], "left_anti").select(*left.columns)
