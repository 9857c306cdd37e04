"""Ordered partitions and joins that stay even when one key is very frequent."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows is hot; there are fewer than HOT_SHARE
#: hot keys in any table, which bounds what ``join_unique`` broadcasts.
HOT_SHARE = 1000


#: No shuffle by range is dealt to more tasks than this: range bounds are kept by the driver.
MOST_TASKS = 50_000
_LOW = -(1 << 63)


def range_cuts(rows: DataFrame, key: str, tasks: int, parts: int, total: int) -> list[tuple[int, int]]:
    """Ascending pairs of ``key`` (an integer without nulls) and a 64-bit hash that cut ``rows``
    into about ``parts`` even ranges, of which a task gets some.

    Inside keys of more rows than a task is to have there are more of them, by the hash alone;
    there are fewer such keys than ``tasks``. Only the key is read.
    """
    if parts < 2 or not total:
        return []
    probs = [i / parts for i in range(1, parts)]
    found = rows.select(F.col(key).cast("double").alias("k")).stat.approxQuantile("k", probs, 0.25 / parts)
    out = {(math.ceil(x), _LOW) for x in found or []}
    most = max(1, total // tasks)
    for k, n in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).collect():
        many = math.ceil(n * parts / total)
        out |= {(k, _LOW + i * (1 << 64) // many) for i in range(many)}
        if k + 1 < 1 << 63:
            out.add((k + 1, _LOW))
    return sorted(out)


def table_of(values: list, kind: str) -> Column:
    """``values`` as one literal of the type ``kind``, however many there are."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def range_part(key: Column, tie: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of ``cuts`` are at most (``key``, ``tie``): the number of its range, found in two
    steps. Where no key is cut by the hash, ``tie`` isn't looked at."""
    if not cuts:
        return F.lit(0)
    both = any(h != _LOW for _, h in cuts)
    cuts = [{"k": k, "h": h} for k, h in cuts] if both else [k for k, _ in cuts]
    kind, key = ("struct<k:bigint,h:bigint>", F.struct(key.alias("k"), tie.alias("h"))) if both else ("bigint", key)
    step = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    block = F.size(F.filter(table_of([b[0] for b in blocks], f"array<{kind}>"), lambda x: x <= key))
    inside = F.size(F.filter(F.element_at(table_of(blocks, f"array<array<{kind}>>"), block), lambda x: x <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside).cast("int")


def text_tasks(rows: DataFrame, bytes_per_task: int = 32 << 20) -> tuple[int, int]:
    """How many tasks give each about so many bytes of ``text``, or more from MOST_TASKS on; and
    how many rows there are."""
    size, total = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return min(MOST_TASKS, max(1, math.ceil((size or 0) / bytes_per_task))), total


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, counts: DataFrame | None = None) -> DataFrame:
    """Inner join with ``right``, whose ``keys`` are unique and whose ``count`` column says
    how many of the ``total`` left rows have them.

    Hot keys are fewer than HOT_SHARE, so they are broadcast; the others are shuffled, and
    none of them has more than 1/HOT_SHARE of the rows; they are merged at every size. Where
    all keys are of one kind there is one join, and nothing is planned or broadcast for the
    other kind: which that is says a first look at ``count`` in ``counts`` (``right``, if that
    is cheap to read, or what it was made from). ``count`` is dropped.
    """
    most = max(1, total // HOT_SHARE)
    least, greatest = (right if counts is None else counts).agg(F.min(count), F.max(count)).first()
    if greatest is None or greatest <= most:
        return left.join(right.drop(count).hint("merge"), keys)
    if least > most:
        return left.join(F.broadcast(right.drop(count)), keys)
    hot = right.where(F.col(count) > most).drop(count)
    cold = right.where(F.col(count) <= most).drop(count)
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys))
