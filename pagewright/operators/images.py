"""Image inventory and the decision what to do with each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A re-encoded image of unchanged size must be smaller than this share of the old one.
LEAST_WIN = 0.9


def color_kind(name: Column) -> Column:
    """B18"""
    return F.when(name.isin("DeviceGray", "CalGray", "G"), "gray").when(name.isin("DeviceRGB", "CalRGB", "RGB"), "rgb").otherwise("other")


def is_indexed(space: Column) -> Column:
    """By the first entry of a colour space array (a plain name is an array of one)."""
    return F.coalesce(F.get(space, F.lit(0)).isin("Indexed", "I"), F.lit(False))


def odd_decode(pairs: Column) -> Column:
    """Any (lo, hi) other than (0, 1); null is the default mapping."""
    return F.coalesce(F.exists(pairs, lambda p: (p["lo"] != 0) | (p["hi"] != 1)), F.lit(False))


def has_predictor(parms: Column) -> Column:
    """B21"""
    return F.coalesce(F.exists(parms, lambda p: p > 1), F.lit(False))


def describe_color_space(space: Column, components: Column) -> Column:
    """A label for a colour space array; a plain name is an array of one."""
    head = F.get(space, F.lit(0))
    plain = F.when(head.isin("DeviceGray", "CalGray", "G"), "Gray").when(head.isin("DeviceRGB", "CalRGB", "RGB"), "RGB").when(head.isin("DeviceCMYK", "CMYK"), "CMYK").otherwise("unknown")
    icc = F.when(components == 1, "Gray (ICC)").when(components == 3, "RGB (ICC)").when(components == 4, "CMYK (ICC)").otherwise("ICC")
    array = (
        F.when(head == "ICCBased", icc)
        .when(head.isin("Indexed", "I"), "Indexed")
        .when(head.isin("Separation", "DeviceN", "Lab"), head)
        .when(head == "CalGray", "Gray (Cal)")
        .when(head == "CalRGB", "RGB (Cal)")
        .otherwise("unknown")
    )
    return F.when(space.isNull(), "unknown").when(F.size(space) == 1, plain).otherwise(array)


def dpi(width: Column, displayed: Column) -> Column:
    """Pixels per inch as drawn; null for an image that isn't drawn."""
    return F.when(displayed > 0, width * 72.0 / displayed)


def plan(target_dpi: float, at_target_too: bool) -> tuple[Column, Column]:
    """Outcome (replace, at_target, no_win, skip) and reason of images (width, height, bits,
    space, components, displayed, filter, predictor, decode_pairs, readable, stored, encoded).
    The first test that applies decides."""
    c = F.col
    current = dpi(c("width"), c("displayed"))
    at_target = current <= target_dpi
    scale = F.least(F.lit(target_dpi) / current, F.lit(1.0))
    size = lambda n: F.greatest(F.floor(c(n) * scale + 0.5), F.lit(1))
    same_size = (size("width") == c("width")) & (size("height") == c("height"))
    flate, kind = c("filter") == "FlateDecode", color_kind(F.get(c("space"), F.lit(0)))
    other = {"CCITTFaxDecode": "ccitt", "JPXDecode": "jpx", "JBIG2Decode": "jbig2", "Crypt": "crypt"}
    steps: list[tuple[Column, str, str | None]] = [
        ((c("width") <= 0) | (c("height") <= 0), "skip", "decode"),
        (c("bits") < 8, "skip", "bilevel"),
        (is_indexed(c("space")), "skip", "indexed"),
        (current.isNull(), "skip", "unreferenced"),
        (at_target & F.lit(not at_target_too), "at_target", None),
        (at_target & (c("filter") != "DCTDecode"), "at_target", None),
        (flate & ((kind == "other") | (c("bits") != 8)), "skip", "colorspace"),
        (flate & has_predictor(c("predictor")), "skip", "predictor"),
        (flate & odd_decode(c("decode_pairs")), "skip", "decode_array"),
        (c("filter").isin("FlateDecode", "DCTDecode") & ~c("readable"), "skip", "decode"),
        *[(c("filter") == name, "skip", reason) for name, reason in other.items()],
        (~c("filter").isin("FlateDecode", "DCTDecode"), "skip", "unsupported_filter"),
        (c("encoded") >= F.when(same_size, F.floor(c("stored") * LEAST_WIN)).otherwise(c("stored")), "no_win", None),
    ]
    outcome, reason = F.lit("replace"), F.lit(None).cast("string")
    for test, what, why in reversed(steps):
        outcome = F.when(test, what).otherwise(outcome)
        reason = F.when(test, F.lit(why)).otherwise(reason)
    return outcome, reason


def inventory(images: DataFrame, placements: DataFrame) -> DataFrame:
    """Each image (id, width, height, stored) with the pages it is on, its greatest
    width as drawn and its resolution; without pixels left out; in order of first page (never
    drawn last) and falling size."""
    placed = placements.groupBy("id").agg(F.max("placed").alias("displayed"), F.array_sort(F.collect_set("page")).alias("pages"))
    rows = images.where("width > 0 AND height > 0").join(placed, "id", "left")
    rows = rows.select("id", "width", "height", "stored", F.coalesce("pages", F.array().cast("array<int>")).alias("pages"), dpi(F.col("width"), F.col("displayed")).alias("dpi"))
    return rows.orderBy(F.get("pages", F.lit(0)).asc_nulls_last(), F.desc("stored"), "id")


def tally(planned: DataFrame) -> DataFrame:
    """Number of images of each outcome and reason."""
    return planned.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


def inspector_counts(images: DataFrame, target: float) -> DataFrame:
    """D16"""
    known = F.col("dpi").isNotNull()
    return images.agg(
        F.count_if(known & (F.col("dpi") > target)).alias("above"),
        F.count_if(known & (F.col("dpi") <= target)).alias("at_target"),
        F.count_if(F.col("filter") == "DCTDecode").alias("reencodable"),
        F.count_if(known & (F.col("dpi") <= target) & (F.col("filter") != "DCTDecode")).alias("untouched"),
        F.count_if(~known).alias("unmeasurable"),
    )


def image_objects(objects: DataFrame) -> DataFrame:
    """Streams (subtype, ...) that are images."""
    return objects.where(F.col("subtype") == "Image")


def image_names(resources: DataFrame, known: DataFrame) -> DataFrame:
    """Resources (page, name, id) that stand for an image of ``known`` (id)."""
    return resources.join(known.select("id"), "id", "left_semi").select("page", "name", "id")


def without_empty(streams: DataFrame) -> DataFrame:
    """Streams with anything in them (length)."""
    return streams.where(F.col("length") > 0)


def serialized_size(content: Column) -> Column:
    """Bytes of what a step gave; 0 where it failed."""
    return F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
