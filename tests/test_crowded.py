"""Overlap on crowded pages and ink boxes from strips, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import binary as B
from pagewright.operators import margins, overlap

SHAPE = "doc_id int, page int, n int, x double, y double, width double, height double"


def loop(left, right, least=1.0):
    side = lambda a, b, at: min(a[at] + a[at + 2], b[at] + b[at + 2]) - max(a[at], b[at])
    whole = [r for r in left if None not in r[3:]], [r for r in right if None not in r[3:]]
    return sorted((a[2], b[2]) for a in whole[0] for b in whole[1] if a[:2] == b[:2] and side(a, b, 3) > least and side(a, b, 4) > least)


def rectangles(seed, n, sides):
    r = random.Random(seed)
    made = [(r.randint(1, 2), r.randint(1, 2), k, r.uniform(-900, 900), r.uniform(-900, 900), r.choice(sides) * r.random(), r.choice(sides) * r.random()) for k in range(n)]
    return made + [(1, 1, n, 10.0, 10.0, None, 5.0), (1, 1, n + 1, 0.0, 0.0, 0.5, 9.0), (1, 1, n + 2, 0.0, 0.0, 1e6, 1e6), (1, 1, n + 3, -16.0, -16.0, 32.0, 32.0), (1, 1, n + 4, -16.0, -16.0, 32.0, 32.0)]


@pytest.mark.parametrize("sides", [(3, 20), (10, 100, 1000, 5000, 50000)])
def test_pairs_are_those_of_the_nested_loop(spark, sides):
    left, right = rectangles(1, 300, sides), rectangles(2, 200, sides)
    a, b = spark.createDataFrame(left, SHAPE), spark.createDataFrame(right, SHAPE).withColumn("more", F.lit("m"))
    want = loop(left, right)
    assert sorted((r["l"]["n"], r["r"]["n"]) for r in overlap.pairs(a, b).collect()) == want and want
    met = {x for x, _ in want}
    assert sorted(r["n"] for r in overlap.meeting(a, b).collect()) == sorted(met)
    assert sorted(r["n"] for r in overlap.apart(a, b).collect()) == sorted(r[2] for r in left if r[2] not in met)
    assert overlap.apart(a, b).columns == a.columns


def test_pairs_of_odd_rectangles(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, 1, k, *v) for k, v in enumerate([(0.0, 0.0, inf, 9.0), (-inf, 0.0, 9.0, 9.0), (nan, 0.0, 9.0, 9.0), (0.0, 0.0, -9.0, 9.0), (0.0, 0.0, 9.0, 9.0), (-0.0, 0.0, 9.0, 9.0), (0.0, 0.0, 9.0, 9.0)])]
    rows = spark.createDataFrame(odd, SHAPE)
    assert sorted(r["n"] for r in overlap.meeting(rows, rows).collect()) == [4, 5, 6]
    assert overlap.pairs(rows, rows.limit(0)).collect() == [] and overlap.apart(rows, rows.limit(0)).count() == 7


def test_a_crowded_page_is_many_keys(spark):
    """102,400 characters and 10,000 regions of one page: no task has twice the mean of the pairs."""
    grid = lambda across, step, side: spark.range(across * across).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("n"), (F.col("id") % across * step).cast("double").alias("x"), (F.floor(F.col("id") / across) * step).cast("double").alias("y"), F.lit(side).alias("width"), F.lit(side).alias("height"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = overlap.pairs(grid(320, 10, 8.0), grid(100, 32, 20.0))
        per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    along = sum(min(c + 8, r + 20) - max(c, r) > 1 for r in range(0, 3200, 32) for c in range(0, 3200, 10))
    assert sum(per_task) == along**2 and len(per_task) == 4 and max(per_task) < 2 * sum(per_task) / 4


def raster(seed, width, height):
    rng = np.random.default_rng(seed)
    pixels = np.full((height, width, 4), 255, np.uint8)
    for _ in range(rng.integers(0, 4)):
        y, x = rng.integers(0, height), rng.integers(0, width)
        pixels[y : y + rng.integers(1, 6), x : x + rng.integers(1, 6), rng.integers(0, 3)] = 30
    return pixels


CUTS = "doc_id int, page int, y0 int, rows int, width int, height int, page_w double, page_h double, pixels binary"


def test_boxes_of_strips_are_those_of_whole_rasters(spark):
    """Every cut of rasters of up to 7 rows, and random cuts of larger ones."""
    rows, want, k = [], {}, 0
    for seed in range(60):
        width, height = 3 + seed % 9, 1 + seed % 7 if seed < 40 else 20 + seed
        pixels = raster(seed, width, height)
        cuts = range(2 ** (height - 1)) if height <= 7 else [random.Random(seed).getrandbits(height - 1) for _ in range(4)]
        for cut in cuts:
            ends = [i + 1 for i in range(height - 1) if cut >> i & 1] + [height]
            rows += [(k, 1, a, b - a, width, height, 2.0 * width, 3.0 * height, pixels[a:b].tobytes()) for a, b in zip([0, *ends], ends)]
            want[k] = B.ink_box(pixels.tobytes(), width)
            k += 1
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r for r in margins.ink_boxes(spark.createDataFrame(rows, CUTS)).collect()}
    assert {k: list(r["box"]) if r["box"] else None for k, r in got.items()} == want
    assert all(r["error"] is None for r in got.values()) and any(want.values()) and not all(want.values())
    sizes = {r[0]: r[5] for r in rows}
    for k, r in got.items():
        if r["box"]:
            x0, y0, x1, y1 = r["box"]
            assert list(r["ink"]) == pytest.approx([2 * x0, 3 * (sizes[k] - y1), 2 * x1, 3 * (sizes[k] - y0)])


def test_strips_that_are_not_a_page(spark):
    white = bytes([255]) * 40
    strip = lambda doc, y0, pixels=white, rows=2, height=4, width=5, page_w=1.0: (doc, 1, y0, rows, width, height, page_w, 1.0, pixels)
    rows = [strip(1, 0), strip(1, 2), strip(2, 0), strip(3, 0), strip(3, 0), strip(4, 0), strip(4, 1), strip(5, 0), strip(5, 2, None), strip(6, 0), strip(6, 2, white[:-1]), strip(7, 0), strip(7, 2, page_w=2.0), strip(8, 0, width=None), strip(9, None), strip(10, 0), strip(10, 2), strip(10, 4)]
    frame = spark.createDataFrame(rows, CUTS).withColumn("error", F.lit("clash"))
    got = {r["doc_id"]: (r["box"], r["error"]) for r in margins.ink_boxes(frame).collect()}
    assert got == {1: (None, None)} | {k: (None, e) for k, e in {2: "strips", 3: "strips", 4: "strips", 5: "pixels", 6: "pixels", 7: "size", 8: "size", 9: "pixels", 10: "strips"}.items()}
    assert margins.ink_boxes(frame.limit(0)).collect() == []
