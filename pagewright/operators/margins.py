"""Ink boxes of pages whose rasters come in strips.

A strip is a row (doc_id, page, y0, rows, width, height, page_w, page_h, pixels): the raster's rows
from y0 on, four bytes a pixel, of a raster of width x height pixels for a page of page_w x page_h
points. A page's strips may lie in as many tasks; each gives a partial result of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import geometry as G

PAGE = ["doc_id", "page"]
_PROFILE = "struct<runs:array<struct<first:int,last:int>>,columns:array<struct<x:int,n:int>>>"


def profile(pixels: bytes, width: int, height: int, rows: int, y0: int, dark: int = B.DARK, share: float = B.SHARE) -> dict | None:
    """Of a strip, runs of rows with enough ink (places in the whole raster) and the ink of each
    column that has any. Of the runs, those at the strip's borders may go on in its neighbours and
    are kept; of the others the first and the last that aren't single rows. None for wrong sizes."""
    if width <= 0 or rows <= 0 or len(pixels) != width * rows * 4:
        return None
    ink = np.frombuffer(pixels, dtype=np.uint8).reshape(rows, width, 4)[:, :, :3].min(axis=2) < dark
    good = np.concatenate([[False], ink.sum(axis=1) >= B.enough(width, share), [False]])
    edges = np.flatnonzero(good[1:] != good[:-1]).reshape(-1, 2)
    border = [(a, b) for a, b in edges if a == 0 or b == rows]
    inner = [(a, b) for a, b in edges if a > 0 and b < rows and b - a > 1]
    runs = sorted(set(border + inner[:1] + inner[-1:]))
    counts = ink.sum(axis=0)
    return {"runs": [{"first": y0 + int(a), "last": y0 + int(b) - 1} for a, b in runs], "columns": [{"x": int(x), "n": int(counts[x])} for x in np.flatnonzero(counts)]}


#: Pixels of strips that are looked at by one array operation.
MOST_PIXELS = 1 << 20


def _alike(strips: list[tuple[int, bytes]], width: int, rows: int) -> list[np.ndarray]:
    """`profile` of strips (y0, pixels) of one size: strip, first and last of runs; strip, x and n of columns."""
    n = len(strips)
    y0 = np.array([y for y, _ in strips], dtype=np.int64)
    ink = np.frombuffer(b"".join(p for _, p in strips), dtype=np.uint8).reshape(n, rows, width, 4)[..., :3].min(axis=3) < B.DARK
    good = np.zeros((n, rows + 2), dtype=bool)
    good[:, 1:-1] = ink.sum(axis=2) >= B.enough(width, B.SHARE)
    strip, edge = np.nonzero(good[:, 1:] != good[:, :-1])
    strip, a, b = strip[::2], edge[::2], edge[1::2]
    border = (a == 0) | (b == rows)
    inner = np.flatnonzero(~border & (b - a > 1))
    end = np.ones(len(inner), dtype=bool)
    end[1:-1] = (strip[inner][1:-1] != strip[inner][:-2]) | (strip[inner][1:-1] != strip[inner][2:])
    kept = np.union1d(np.flatnonzero(border), inner[end])
    counts = ink.sum(axis=1)
    inked, x = np.nonzero(counts)
    return [strip[kept], y0[strip[kept]] + a[kept], y0[strip[kept]] + b[kept] - 1, inked, x, counts[inked, x]]


def _profiles(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    pair = lambda a, b: [pa.field(a, pa.int32()), pa.field(b, pa.int32())]
    for pixels, *numbers in parts:
        rows = list(zip(*(c.to_pylist() for c in numbers)))
        sizes: dict[tuple[int, int], list[int]] = {}
        read = np.zeros(len(rows), dtype=bool)
        for i, (size, (width, height, n, y0)) in enumerate(zip(pc.binary_length(pixels).to_pylist(), rows)):
            if None not in (size, width, height, n, y0) and width > 0 and n > 0 and size == width * n * 4:
                sizes.setdefault((width, n), []).append(i)
                read[i] = True
        found: list[list[np.ndarray]] = [[np.empty(0, dtype=np.int64)] * 6]
        for (width, n), places in sizes.items():
            step = max(1, MOST_PIXELS // (width * n))
            for at in range(0, len(places), step):
                some = np.array(places[at : at + step])
                got = _alike([(rows[i][3], pixels[i].as_py()) for i in some.tolist()], width, n)
                found.append([some[got[0]], *got[1:3], some[got[3]], *got[4:]])
        columns = [np.concatenate(c) for c in zip(*found)]
        lists = []
        for (owner, u, v), fields in zip((columns[:3], columns[3:]), (pair("first", "last"), pair("x", "n"))):
            order = np.argsort(owner, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(rows)))))
            inside = pa.StructArray.from_arrays([pa.array(c[order], pa.int32()) for c in (u, v)], fields=fields)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inside))
        yield pa.StructArray.from_arrays(lists, names=["runs", "columns"], mask=pa.array(~read))


def ink_boxes(strips: DataFrame) -> DataFrame:
    """A row per page: doc_id, page, page_w, page_h, box (x0, y0, x1, y1 in pixels from the top
    left, ends exclusive, as `binary.ink_box` gives it for the whole raster), ink (the same as a
    box in points from the bottom left, as `geometry.ink_scale` takes it) and error.

    A blank page has no box and no error. ``error`` says why a box can't be had: ``size`` (strips
    don't agree on the page's or the raster's size, or it is null), ``pixels`` (null, or not as many
    as the strip's size says) or ``strips`` (they leave a gap or overlap).

    Strips are read once. Strips, runs of rows and columns are intervals of three kinds; those of a
    kind that touch are one, which says whether the strips cover the raster and where ink begins
    and ends. A row or column of ink alone is none, two that touch are."""
    size, part = F.struct("page_w", "page_h", "width", "height"), F.arrow_udf(_PROFILE)(_profiles)("pixels", *[F.col(c).cast("int") for c in ("width", "height", "rows", "y0")])
    read = strips.select(F.struct(*PAGE).alias("_at"), "y0", "rows", size.alias("size"), part.alias("_p"))
    unsized = F.greatest(*[F.col(f"size.{c}").isNull().cast("int") for c in ("page_w", "page_h", "width", "height")])
    one = lambda kind, first, last, n: F.struct(F.lit(kind).alias("kind"), first.cast("int").alias("first"), last.cast("int").alias("last"), n.cast("long").alias("n"))
    none = F.array().cast("array<struct<kind:string,first:int,last:int,n:bigint>>")
    runs = F.coalesce(F.transform("_p.runs", lambda r: one("row", r["first"], r["last"], F.lit(1))), none)
    columns = F.coalesce(F.transform("_p.columns", lambda c: one("column", c["x"], c["x"], c["n"])), none)
    strip = F.array(one("strip", F.col("y0"), F.col("y0") + F.col("rows") - 1, F.lit(1)))
    items = read.select("_at", "size", unsized.alias("unsized"), F.col("_p").isNull().cast("int").alias("unread"), F.explode(F.concat(strip, runs, columns)).alias("i")).select("*", "i.*")
    through = [F.max(c).alias(c) for c in ("unsized", "unread")]
    summed = items.groupBy("_at", "kind", "first").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"), *through)
    ink = summed.where((F.col("kind") != "column") | (F.col("n") >= F.greatest(F.ceil(F.col("lo.height") * B.SHARE), F.lit(1))))

    ink = ink.repartition("_at")  # the last shuffle: a page's columns and runs are summed by now
    order = Window.partitionBy("_at", "kind").orderBy("first")
    before = F.lag("last").over(order)
    crossing = ((F.col("kind") == "strip") & ((F.col("n") > 1) | F.coalesce(F.col("first") <= before, F.lit(False)))).cast("int")
    begins = ink.withColumns({"_new": F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int"), "crossing": crossing})
    islands = begins.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), *through, F.max("crossing").alias("crossing")]
    joined = islands.groupBy("_at", "kind", "_island").agg(F.min("first").alias("low"), F.max("last").alias("high"), *both)
    of = lambda kind, c: F.when((F.col("kind") == kind) & ((F.col("high") > F.col("low")) | (F.col("kind") == "strip")), F.col(c))
    ends = [f(of(kind, c)).alias(name) for kind, c, f, name in (("column", "low", F.min, "x0"), ("column", "high", F.max, "x1"), ("row", "low", F.min, "y0"), ("row", "high", F.max, "y1"), ("strip", "low", F.min, "s0"), ("strip", "high", F.max, "s1"), ("strip", "low", F.count, "stretches"))]
    pages = joined.groupBy("_at").agg(*ends, *both).select("_at.*", "x0", "x1", "y0", "y1", "s0", "s1", "stretches", "lo", "hi", "unsized", "unread", "crossing", "lo.*")

    whole = (F.col("stretches") == 1) & (F.col("s0") == 0) & (F.col("s1") == F.col("height") - 1) & (F.col("crossing") == 0)
    error = F.when((F.col("unsized") > 0) | (F.col("lo") != F.col("hi")), "size").when(F.col("unread") > 0, "pixels").when(~whole, "strips")
    pages = pages.withColumn("error", error)
    there = F.col("error").isNull() & F.col("x0").isNotNull() & F.col("y0").isNotNull()
    edges = (F.col("x0"), F.col("y0"), F.col("x1") + 1, F.col("y1") + 1)
    r = G.pixels_to_points(*edges, F.col("width"), F.col("height"), F.col("page_w"), F.col("page_h"))
    points = G.box(r["x"], r["y"], G.right(r), G.bottom(r))
    return pages.select(*PAGE, "page_w", "page_h", F.when(there, G.box(*edges)).alias("box"), F.when(there, points).alias("ink"), "error")
