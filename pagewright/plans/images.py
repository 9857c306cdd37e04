"""Image inventory. Images are parts, placements are line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images as I
from .labels import _pick, _pick_sql
from .registry import Book, table

book = Book()

_FILTERS = ("DCTDecode", "FlateDecode", "JPXDecode", "CCITTFaxDecode", "LZWDecode", "FlateDecode", "Crypt")
_SPACES = ("DeviceRGB", "DeviceGray", "Indexed", "DeviceCMYK", "CalRGB")

_IMAGES = f"(SELECT p_partkey AS id, p_size * 40 AS width, p_size % 17 * 60 AS height, CAST(p_retailprice * 10 AS BIGINT) AS stored, CASE WHEN p_size % 9 = 0 THEN 1 ELSE 8 END AS bits, {_pick_sql('p_partkey', _FILTERS)} AS filter, {_pick_sql('p_partkey', _SPACES)} AS space, p_partkey % 11 <> 0 AS readable, p_size % 6 = 0 AS predictor, p_size % 10 = 0 AS odd, CAST(p_retailprice * 10 AS BIGINT) * (p_size % 5) // 4 AS encoded FROM part)"
_PLACED = "(SELECT l_partkey AS id, max(l_quantity * 12.0::DOUBLE) AS displayed, list_sort(list(DISTINCT l_linenumber)) AS pages FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY l_partkey)"


def images(spark, sf_dir) -> DataFrame:
    size = F.col("p_size")
    stored = (F.col("p_retailprice") * 10).cast("decimal(20,4)")
    stored = F.round(F.col("p_retailprice") * 10).cast("long")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (size * 40).alias("width"),
        (size % 17 * 60).alias("height"),
        stored.alias("stored"),
        F.when(size % 9 == 0, 1).otherwise(8).alias("bits"),
        _pick("p_partkey", _FILTERS).alias("filter"),
        F.array(_pick("p_partkey", _SPACES)).alias("space"),
        (F.col("p_partkey") % 11 != 0).alias("readable"),
        F.when(size % 6 == 0, F.array(F.lit(15))).alias("predictor"),
        F.when(size % 10 == 0, F.array(F.struct(F.lit(1.0).alias("lo"), F.lit(0.0).alias("hi")))).alias("decode_pairs"),
        F.floor(stored * (size % 5) / 4).cast("long").alias("encoded"),
    )


def placements(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_partkey % 4 <> 0").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 12.0).alias("placed"))


def placed_images(spark, sf_dir) -> DataFrame:
    drawn = placements(spark, sf_dir).groupBy("id").agg(F.max("placed").alias("displayed"))
    return images(spark, sf_dir).join(drawn, "id", "left")


@book.query(f"SELECT i.id, width, coalesce(pages, []::INTEGER[]) AS pages, width * 72.0::DOUBLE / displayed AS dpi FROM {_IMAGES} i LEFT JOIN {_PLACED} p ON i.id = p.id WHERE width > 0 AND height > 0")
def c04_inspect_images(spark, sf_dir):
    return I.inventory(images(spark, sf_dir), placements(spark, sf_dir)).select("id", "width", "pages", "dpi")


@book.query(f"SELECT id, displayed, pages FROM {_PLACED}")
def d03_measure_placements(spark, sf_dir):
    return placements(spark, sf_dir).groupBy("id").agg(F.max("placed").alias("displayed"), F.array_sort(F.collect_set("page")).alias("pages"))


@book.query(f"SELECT i.id FROM {_IMAGES} i LEFT JOIN {_PLACED} p ON i.id = p.id WHERE width > 0 AND height > 0 ")
def f03_image_order(spark, sf_dir):
    return I.inventory(images(spark, sf_dir), placements(spark, sf_dir)).select("id")


_PLAN = f"""(SELECT id, CASE WHEN reason IS NOT NULL THEN 'skip' ELSE o END AS outcome, reason FROM (SELECT *, CASE WHEN width <= 0 OR height <= 0 THEN 'decode' WHEN bits < 8 THEN 'bilevel' WHEN space = 'Indexed' THEN 'indexed' WHEN displayed IS NULL THEN 'unreferenced'
    WHEN at_target AND filter <> 'DCTDecode' THEN NULL WHEN filter = 'FlateDecode' AND (space = 'DeviceCMYK' OR bits <> 8) THEN 'colorspace' WHEN filter = 'FlateDecode' AND predictor THEN 'predictor' WHEN filter = 'FlateDecode' AND odd THEN 'decode_array'
    WHEN filter IN ('FlateDecode', 'DCTDecode') AND NOT readable THEN 'decode' WHEN filter = 'CCITTFaxDecode' THEN 'ccitt' WHEN filter = 'JPXDecode' THEN 'jpx' WHEN filter = 'Crypt' THEN 'crypt' WHEN filter = 'LZWDecode' THEN 'unsupported_filter' END AS reason,
    CASE WHEN at_target AND filter <> 'DCTDecode' THEN 'at_target' WHEN encoded >= CASE WHEN at_target THEN floor(stored * 0.9::DOUBLE) ELSE CASE WHEN greatest(floor(width * (100.0::DOUBLE / (width * 72.0::DOUBLE / displayed)) + 0.5::DOUBLE), 1) = width AND greatest(floor(height * (100.0::DOUBLE / (width * 72.0::DOUBLE / displayed)) + 0.5::DOUBLE), 1) = height THEN floor(stored * 0.9::DOUBLE) ELSE stored END END THEN 'no_win' ELSE 'replace' END AS o
    FROM (SELECT i.*, displayed, width * 72.0::DOUBLE / displayed <= 100.0 AS at_target FROM {_IMAGES} i LEFT JOIN {_PLACED} p ON i.id = p.id)))"""


@book.query(f"SELECT id, outcome, reason FROM {_PLAN}")
def b22_plan_images(spark, sf_dir):
    outcome, reason = I.plan(100.0, True)
    return placed_images(spark, sf_dir).select("id", outcome.alias("outcome"), reason.alias("reason"))


@book.query(f"SELECT outcome, reason, CAST(count(*) AS BIGINT) AS n FROM {_PLAN} GROUP BY ALL")
def d04_image_tally(spark, sf_dir):
    outcome, reason = I.plan(100.0, True)
    return I.tally(placed_images(spark, sf_dir).select(outcome.alias("outcome"), reason.alias("reason")))


@book.query(f"SELECT reason, CAST(count(*) AS BIGINT) AS n FROM {_PLAN} WHERE outcome = 'skip' GROUP BY reason")
def d05_skipped_report(spark, sf_dir):
    outcome, reason = I.plan(100.0, True)
    planned = placed_images(spark, sf_dir).select(outcome.alias("outcome"), reason.alias("reason"))
    return I.tally(planned).where("outcome = 'skip'").select("reason", "n")


@book.query(f"SELECT CAST(count(*) FILTER (dpi > 100) AS BIGINT) AS above, CAST(count(*) FILTER (dpi <= 100) AS BIGINT) AS at_target, CAST(count(*) FILTER (filter = 'DCTDecode') AS BIGINT) AS reencodable, CAST(count(*) FILTER (dpi <= 100 AND filter <> 'DCTDecode') AS BIGINT) AS untouched, CAST(count(*) FILTER (dpi IS NULL) AS BIGINT) AS unmeasurable FROM (SELECT filter, width * 72.0::DOUBLE / displayed AS dpi FROM {_IMAGES} i LEFT JOIN {_PLACED} p ON i.id = p.id)")
def d16_inspector_counts(spark, sf_dir):
    df = placed_images(spark, sf_dir)
    return I.inspector_counts(df.select("filter", I.dpi(F.col("width"), F.col("displayed")).alias("dpi")), 100.0)


@book.query("SELECT p_partkey AS id FROM part WHERE p_type LIKE '%STEEL%' OR p_size > 25")
def b17_image_objects(spark, sf_dir):
    subtype = F.when(F.contains("p_type", F.lit("STEEL")) | (F.col("p_size") > 25), "Image").when(F.col("p_size") > 5, "Form")
    return I.image_objects(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), subtype.alias("subtype"))).select("id")


@book.query(f"SELECT id, CASE WHEN space = 'DeviceGray' THEN 'gray' WHEN space IN ('DeviceRGB', 'CalRGB') THEN 'rgb' ELSE 'other' END AS kind FROM {_IMAGES}")
def b18_color_kind(spark, sf_dir):
    return images(spark, sf_dir).select("id", I.color_kind(F.get("space", F.lit(0))).alias("kind"))


@book.query(f"SELECT id, space = 'Indexed' AS indexed FROM {_IMAGES}")
def b19_is_indexed(spark, sf_dir):
    return images(spark, sf_dir).select("id", I.is_indexed(F.col("space")).alias("indexed"))


@book.query(f"SELECT id, odd FROM {_IMAGES}")
def b20_odd_decode(spark, sf_dir):
    return images(spark, sf_dir).select("id", I.odd_decode(F.col("decode_pairs")).alias("odd"))


@book.query(f"SELECT id, predictor FROM {_IMAGES}")
def b21_has_predictor(spark, sf_dir):
    return images(spark, sf_dir).select("id", I.has_predictor(F.col("predictor")).alias("predictor"))


_LABELS = ("Gray (ICC)", "RGB (ICC)", "CMYK (ICC)", "ICC", "Indexed", "Separation", "DeviceN", "Gray (Cal)", "Lab", "unknown", "CMYK", "unknown")


@book.query(f"SELECT p_partkey AS id, {_pick_sql('p_partkey', _LABELS)} AS label FROM part")
def b23_describe_color_space(spark, sf_dir):
    shapes = [["ICCBased", "1"], ["ICCBased", "3"], ["ICCBased", "4"], ["ICCBased", "2"], ["I", "x"], ["Separation", "x"], ["DeviceN", "x"], ["CalGray", "x"], ["Lab", "x"], ["Odd", "x"], ["CMYK"], ["Pattern"]]
    space = F.element_at(F.array(*[F.array(*[F.lit(x) for x in s]) for s in shapes]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), I.describe_color_space(space, F.get(space, F.lit(1)).try_cast("int")).alias("label"))


@book.query(f"SELECT id, stored FROM {_IMAGES} WHERE stored > 9000")
def g29_drop_empty_streams(spark, sf_dir):
    streams = images(spark, sf_dir).withColumn("length", F.greatest(F.col("stored") - 9000, F.lit(0)))
    return I.without_empty(streams).select("id", "stored")


@book.query("SELECT p_partkey AS k, CAST(CASE WHEN p_size % 2 = 0 THEN octet_length(encode(p_name)) ELSE 0 END AS BIGINT) AS size FROM part")
def d14_serialized_size(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), I.serialized_size(F.when(F.col("p_size") % 2 == 0, F.col("p_name"))).alias("size"))


@book.query(f"SELECT 'drop_empty' AS step, (SELECT CAST(sum(stored) AS BIGINT) FROM {_IMAGES}) AS size_before, (SELECT CAST(sum(stored) AS BIGINT) FROM {_IMAGES} WHERE height > 0) AS size_after UNION ALL SELECT 'recompress', (SELECT CAST(sum(stored) AS BIGINT) FROM {_IMAGES} WHERE height > 0), (SELECT CAST(sum(least(stored, encoded)) AS BIGINT) FROM {_IMAGES} WHERE height > 0)")
def g32_optimization_steps(spark, sf_dir):
    """An ordered chain of steps with the size before and after each."""
    steps = [("drop_empty", lambda df: df.where("height > 0")), ("recompress", lambda df: df.withColumn("stored", F.least("stored", "encoded")))]
    now, report = images(spark, sf_dir).select("height", "stored", "encoded"), None
    for name, step in steps:
        after = now.transform(step)
        row = now.agg(F.sum("stored").alias("size_before")).crossJoin(after.agg(F.sum("stored").alias("size_after"))).select(F.lit(name).alias("step"), "size_before", "size_after")
        now, report = after, row if report is None else report.unionByName(row)
    return report


@book.query(f"SELECT i.id, CAST(CASE WHEN outcome = 'replace' THEN encoded ELSE stored END AS BIGINT) AS stored FROM {_IMAGES} i JOIN {_PLAN} p ON i.id = p.id")
def g31_recompress_images(spark, sf_dir):
    """All images are planned before any is replaced."""
    outcome, _ = I.plan(100.0, True)
    return placed_images(spark, sf_dir).select("id", F.when(outcome == "replace", F.col("encoded")).otherwise(F.col("stored")).alias("stored"))
