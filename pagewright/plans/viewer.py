"""Arithmetic of the viewer: zoom, visible pages, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import viewer as V
from .registry import Book, table

book = Book()

@book.query("SELECT p_partkey AS k, CAST(list_min(list_filter([10, 25, 50, 75, 100, 125, 150, 200, 300, 400], lambda z: z > p_size * 8)) AS INTEGER) AS up, CAST(list_max(list_filter([10, 25, 50, 75, 100, 125, 150, 200, 300, 400], lambda z: z < p_size * 8)) AS INTEGER) AS down FROM part")
def f06_zoom_step(spark, sf_dir):
    zoom = F.col("p_size") * 8
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), V.zoom_in(zoom).alias("up"), V.zoom_out(zoom).alias("down"))


@book.query("SELECT p_partkey AS k, list_sort(list_distinct(list_append([10, 25, 50, 75, 100, 125, 150, 200, 300, 400], p_size))) AS presets FROM part")
def f08_preset_merge(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), V.presets_with(F.col("p_size")).alias("presets"))


@book.query("SELECT l_orderkey AS k, min(l_linenumber) AS top FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey")
def f07_top_visible_page(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("k")).agg(V.top_visible(F.col("l_linenumber")).alias("top"))


@book.query("SELECT l_orderkey AS k, CAST(ceil(900.0::DOUBLE / (sum(CAST(l_quantity AS BIGINT)) / CAST(count(*) AS DOUBLE) * 1.5::DOUBLE + 12.0::DOUBLE)) AS BIGINT) AS visible FROM lineitem GROUP BY l_orderkey")
def d19_visible_pages(spark, sf_dir):
    average = F.sum(F.col("l_quantity").cast("long")) / F.count("*").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(V.visible_pages(average, 1.5, 12.0, 900.0).alias("visible"))


@book.query("SELECT l_orderkey AS k, l_linenumber AS page FROM lineitem WHERE abs(l_linenumber - 4) <= greatest(2, l_orderkey % 4 + 1)")
def e16_render_window(spark, sf_dir):
    near = V.in_render_window(F.col("l_linenumber"), F.lit(4), F.col("l_orderkey") % 4)
    return table(spark, sf_dir, "lineitem").where(near).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page"))


@book.query("SELECT p_partkey AS k, CAST(least(greatest(p_size * 9 + 12, 10), 400) AS INTEGER) AS zoom_in, CAST(least(greatest(p_size * 9 - 12, 10), 400) AS INTEGER) AS zoom_out FROM part")
def h77_wheel_zoom(spark, sf_dir):
    zoom = F.col("p_size") * 9
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), V.wheel(zoom, 1).alias("zoom_in"), V.wheel(zoom, -1).alias("zoom_out"))


@book.query("SELECT p_partkey AS k, ratio, ratio < 0.3 AS jump FROM (SELECT p_partkey, greatest(least(p_size * 10.0::DOUBLE + 100.0::DOUBLE, 400.0::DOUBLE) - greatest(p_size * 10.0::DOUBLE, 50.0::DOUBLE), 0.0::DOUBLE) / 100.0::DOUBLE AS ratio FROM part)")
def h78_visible_ratio(spark, sf_dir):
    """The part of a slot of height 100 that is in a window from 50 to 400."""
    ratio = V.visible_ratio(F.col("p_size") * 10.0, F.lit(100.0), F.lit(50.0), F.lit(400.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), ratio.alias("ratio"), (ratio < V.JUMP_BELOW).alias("jump"))


@book.query("SELECT user_id AS k, arg_min(CAST(event_id AS BIGINT), ts) AS size_before, arg_max(CAST(event_id AS BIGINT), ts) AS size_after FROM events GROUP BY user_id HAVING count(DISTINCT ts) = count(*)")
def d15_run_totals(spark, sf_dir):
    """What the first step found and the last one left."""
    first, last = V.run_totals(F.col("event_id"), F.col("event_id"), F.col("ts"))
    steps = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(first.alias("size_before"), last.alias("size_after"), F.count("*").alias("n"), F.count_distinct("ts").alias("m"))
    return steps.where("n = m").select("k", "size_before", "size_after")
