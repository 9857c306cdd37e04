"""Ordered folds: lines, runs and wrapping, as aggregates over sorted arrays or windows.

Items of a page come as an array of structs in their order, or as rows with an ordinal. Where
what an item begins depends on the item before it alone, windows say so. Greedy folds, whose
state is what they have built so far, are loops over a page's items in an Arrow function: one
pass, as long as the page. Pages are rows and spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions import text as T
from ..shipping import ship

#: A gap of more than this share of the font size is written as a tab.
TAB_GAP = 0.2


def _folded(kind: str, fold: Callable, *items: Column) -> Column:
    """``fold`` of each row's values, a list of the type ``kind``; null where the first is null."""
    ship(SparkSession.active())
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else fold(*row) for row in zip(*(c.to_pylist() for c in columns))], arrow)

    return run(*items)


def line_numbers(items: DataFrame, *keys: str) -> DataFrame:
    """``line`` of each item (keys, ord, y, height): a new one begins where an item doesn't
    overlap the one before it vertically."""
    order = Window.partitionBy(*keys).orderBy("ord")
    before_y, before_end = F.lag("y").over(order), F.lag(F.col("y") + F.col("height")).over(order)
    apart = before_y.isNotNull() & ~((F.col("y") < before_end) & (F.col("y") + F.col("height") > before_y))
    return items.withColumn("_new", apart.cast("long")).withColumn("line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _lists(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[list[int], np.ndarray, list[list]]]:
    """Per batch of list columns of one shape: rows that aren't null, where the items of each end,
    and the columns' items, all rows' in one list."""
    for columns in parts:
        rows = np.flatnonzero(np.asarray(columns[0].is_valid()))
        ends = np.cumsum(np.asarray(columns[0].value_lengths().fill_null(0), dtype=np.int64))
        yield rows.tolist(), ends, [c.flatten().to_pylist() for c in columns]


def _sides(items: Column, *names: str) -> list[Column]:
    """A list per name of what the items are there."""
    of = lambda name: F.transform(items, lambda i: i[name].cast("double"))
    return [of(name) for name in names]


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())


def anchored_lines(words: Column, element: str) -> Column:
    """Words (x, y, height, ...; origin below) as an array of lines, from the top: a word
    joins the last line if its y is within half the taller height of that line's first word;
    within a line words go by x. ``element`` is the type of a word. The words' places are sorted,
    the words themselves stay where they are."""
    ship(SparkSession.active())

    @F.arrow_udf("array<array<int>>")
    def placed(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for rows, ends, (xs, ys, heights) in _lists(parts):
            lines, sizes, places, there = [0] * len(ends), [], [], np.zeros(len(ends), dtype=bool)
            there[rows] = True
            for row in rows:
                start, end = int(ends[row - 1]) if row else 0, int(ends[row])
                line: list[int] = []
                for i in sorted(range(start, end), key=lambda i: (-ys[i], xs[i])):
                    if line and abs(ys[line[0]] - ys[i]) <= max(heights[line[0]], heights[i]) * 0.5:
                        line.append(i)
                        continue
                    if line:
                        places += [k - start for k in sorted(line, key=xs.__getitem__)]
                        sizes.append(len(line))
                        lines[row] += 1
                    line = [i]
                if line:
                    places += [k - start for k in sorted(line, key=xs.__getitem__)]
                    sizes.append(len(line))
                    lines[row] += 1
            inside = pa.ListArray.from_arrays(_offsets(sizes), pa.array(places, pa.int32()))
            yield pa.ListArray.from_arrays(_offsets(lines), inside, mask=pa.array(~there))

    return F.transform(placed(*_sides(words, "x", "y", "height")), lambda line: F.transform(line, lambda i: F.get(words, i))).cast(f"array<array<{element}>>")


def line_text(lines: Column) -> Column:
    """Words by a space, lines by a line feed."""
    return F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(line, lambda w: w["text"]), " ")), "\n")


def line_boxes(lines: Column) -> Column:
    """Text and box of each line."""

    def one(line: Column) -> Column:
        left, low = F.array_min(F.transform(line, lambda w: w["x"])), F.array_min(F.transform(line, lambda w: w["y"]))
        right, top = F.array_max(F.transform(line, lambda w: w["x"] + w["width"])), F.array_max(F.transform(line, lambda w: w["y"] + w["height"]))
        text = F.array_join(F.transform(line, lambda w: w["text"]), " ")
        return F.struct(text.alias("text"), left.alias("x"), low.alias("y"), (right - left).alias("width"), (top - low).alias("height"))

    return F.transform(lines, one)


_RECT = "struct<x:double,y:double,width:double,height:double>"


def merge_runs(rects: Column) -> Column:
    """Each rectangle joins the first box so far that it shares a line with (the box grows),
    else it begins a box; then top to bottom and left to right. A rectangle is held against all
    boxes so far at once."""

    ship(SparkSession.active())
    shape = pa.struct([(c, pa.float64()) for c in ("x", "y", "width", "height")])

    @F.arrow_udf(f"array<{_RECT}>")
    def merged(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for rows, ends, columns in _lists(parts):
            sizes, boxes, there = [0] * len(ends), [], np.zeros(len(ends), dtype=bool)
            there[rows] = True
            for row in rows:
                start, end = int(ends[row - 1]) if row else 0, int(ends[row])
                own = _merged(*(c[start:end] for c in columns))
                sizes[row] = len(own)
                boxes += own
            at = np.array(boxes, dtype=np.float64).reshape(-1, 4)
            sides = [at[:, 0], at[:, 1], at[:, 2] - at[:, 0], at[:, 3] - at[:, 1]]
            inside = pa.StructArray.from_arrays([pa.array(v) for v in sides], fields=list(shape))
            yield pa.ListArray.from_arrays(_offsets(sizes), inside, mask=pa.array(~there))

    return merged(*_sides(rects, "x", "y", "width", "height"))


#: Boxes from which on a rectangle is held against all of them by one array operation.
MANY_BOXES = 32


def _merged(xs: list[float], ys: list[float], widths: list[float], heights: list[float]) -> list[list[float]]:
    """Left, top, right and bottom of the boxes that rectangles make, from top to bottom."""
    boxes: list[list[float]] = []
    at, n = np.empty((0, 4)), 0  # the same as an array, once there are many
    for x, y, w, h in zip(xs, ys, widths, heights):
        right, bottom = x + w, y + h
        if n < MANY_BOXES:
            for box in boxes:
                if min(box[3], bottom) - max(box[1], y) > 0.5 * min(box[3] - box[1], h):
                    box[:] = min(box[0], x), min(box[1], y), max(box[2], right), max(box[3], bottom)
                    break
            else:
                boxes.append([x, y, right, bottom])
                n += 1
                if n == MANY_BOXES:
                    at = np.empty((len(xs), 4))
                    at[:n] = boxes
            continue
        some = at[:n]
        shared = np.minimum(some[:, 3], bottom) - np.maximum(some[:, 1], y)
        hit = np.flatnonzero(shared > 0.5 * np.minimum(some[:, 3] - some[:, 1], h))
        if len(hit):
            box = at[hit[0]]
            box[:2], box[2:] = np.minimum(box[:2], (x, y)), np.maximum(box[2:], (right, bottom))
        else:
            at[n] = x, y, right, bottom
            n += 1
    return sorted(at[:n].tolist() if n >= MANY_BOXES else boxes, key=lambda v: (v[1], v[0]))


_RUN = "struct<text:string,x:double,y:double,width:double,height:double,size:double>"


def text_runs(chars: Column) -> Column:
    """Characters (text, x, y, width, height, size) to runs. A character joins the run so far
    if sizes differ by less than 0.5, its y lies within half the run's height of the run's, and
    the gap is under half its size; runs of white space alone are dropped."""

    def fold(chars: list[dict]) -> list[dict]:
        runs: list[tuple[list[str], dict]] = []
        for c in chars:
            last = runs[-1][1] if runs else None
            if last and abs(last["size"] - c["size"]) < 0.5 and abs(last["y"] - c["y"]) < last["height"] * 0.5 and c["x"] - (last["x"] + last["width"]) < c["size"] * 0.5:
                x, y = min(last["x"], c["x"]), min(last["y"], c["y"])
                right, bottom = max(last["x"] + last["width"], c["x"] + c["width"]), max(last["y"] + last["height"], c["y"] + c["height"])
                runs[-1][0].append(c["text"])
                last.update(x=x, y=y, width=right - x, height=bottom - y)
            else:
                runs.append(([c["text"]], dict(c)))
        return [{**box, "text": text} for parts, box in runs for text in ["".join(parts)] if text.strip()]

    return _folded(f"array<{_RUN}>", fold, chars)


def copied_text(tokens: DataFrame, *keys: str) -> DataFrame:
    """Keys and copied of tokens (keys, ord, text, line, x, right, size) as they are copied: a
    line feed where the line changes, a tab over a wide gap; tokens without a line change nothing."""
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = F.col("line").isNotNull()
    rows = tokens.withColumn("_last", F.last(F.when(placed, F.struct("line", "right")), ignorenulls=True).over(before))
    seen = placed & F.col("_last").isNotNull()
    wide = F.col("_last.right").isNotNull() & (F.col("size") > 0) & (F.col("x") - F.col("_last.right") > F.col("size") * TAB_GAP)
    mark = F.when(seen & (F.col("line") != F.col("_last.line")), "\n").when(seen & wide, "\t").otherwise("")
    part = F.struct("ord", F.concat(mark, F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select(*keys, part.alias("_part")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["t"]), "").alias("copied"))


def wrapped(text: Column, family: Column, size: Column, width: Column, inset: float = 2.0) -> Column:
    """Greedy wrapping to a width in points; blank paragraphs stay, a long word overflows.
    Characters that the font has no byte for are left out."""

    def fold(text: str, family: str, size: float, width: float) -> list[str]:
        room = max(width - 2.0 * inset, 1.0)
        thousandths = (lambda c: T.COURIER_WIDTH) if family == "Courier" else T.CHARACTER_WIDTHS.__getitem__
        lines: list[str] = []
        for paragraph in text.split("\n"):
            line, wide, empty = [], 0, True
            for word in "".join(c for c in paragraph if c in T.CHARACTER_WIDTHS).split(" "):
                own = sum(map(thousandths, word))
                longer = own if empty else wide + thousandths(" ") + own
                if empty or size * longer / 1000.0 <= room:
                    line = [] if empty else line
                    line.append(word)
                    wide = longer
                else:
                    lines.append(" ".join(line))
                    line, wide = [word], own
                empty = line == [""]
            lines.append(" ".join(line))
        return lines

    return _folded("array<string>", fold, text, family, size, width)


def run_extent(counts: DataFrame, least: int, *keys: str) -> DataFrame:
    """First and last index (keys, idx, n) that lie in a run of two or more in a row of n >= least."""
    order = Window.partitionBy(*keys).orderBy("idx")
    good = F.col("n") >= least
    beside = lambda f: F.coalesce(f(good).over(order) & (F.abs(f("idx").over(order) - F.col("idx")) == 1), F.lit(False))
    inside = counts.withColumn("_in", good & (beside(F.lag) | beside(F.lead))).where("_in")
    return inside.groupBy(*keys).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
