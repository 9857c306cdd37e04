"""Bytes: compressed streams, tables, nested values and pixels, made from the test tables."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions import binary as B
from ..operators import margins as M
from ..shipping import ship
from .registry import Book, table

book = Book()


def _documents(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))


@book.query("SELECT doc_id, text AS inflated FROM documents")
def h44_inflate(spark, sf_dir):
    """Texts deflated, and inflated again by the parser."""
    deflate = B.over(zlib.compress, "binary")
    return _documents(spark, sf_dir).select("doc_id", B.over(B.inflate, "binary")(deflate("raw")).alias("b")).select("doc_id", F.decode("b", "UTF-8").alias("inflated"))


@book.query("SELECT doc_id, CAST(octet_length(encode(text)) + CASE WHEN octet_length(encode(text)) < 128 THEN 2 WHEN octet_length(encode(text)) < 256 THEN 3 WHEN octet_length(encode(text)) < 65536 THEN 4 ELSE 5 END AS INTEGER) AS total FROM documents")
def h45_ber_total_length(spark, sf_dir):
    n = F.octet_length("raw")
    hexed = F.hex(n.cast("long"))
    hexed = F.when(F.length(hexed) % 2 == 1, F.concat(F.lit("0"), hexed)).otherwise(hexed)
    head = F.when(n < 128, hexed).otherwise(F.concat(F.lpad(F.hex(F.lit(128) + (F.length(hexed) / 2).cast("int")), 2, "0"), hexed))
    value = F.concat(F.unhex(F.lit("04")), F.unhex(head), F.col("raw"), F.unhex(F.lit("FF")))
    return _documents(spark, sf_dir).select("doc_id", B.over(B.ber_end, "int")(value).alias("total"))


@book.query("SELECT n_nationkey AS k, CAST(length(n_name) + 8 AS INTEGER) AS ends FROM nation")
def h46_ber_end(spark, sf_dir):
    """A value of indefinite length with an octet string inside."""
    ship(spark)
    inner = F.concat(F.unhex(F.lit("04")), F.unhex(F.lpad(F.hex(F.length("n_name")), 2, "0")), F.encode("n_name", "UTF-8"))
    value = F.concat(F.unhex(F.lit("3080")), inner, F.unhex(F.lit("0500")), F.unhex(F.lit("0000")), F.unhex(F.lit("77")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), B.over(B.ber_end, "int")(value).alias("ends"))


@book.query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS contents FROM nation")
def h47_octet_string(spark, sf_dir):
    ship(spark)
    tag = F.when(F.col("n_nationkey") % 2 == 0, "04").otherwise("0C")
    value = F.concat(F.unhex(tag), F.unhex(F.lpad(F.hex(F.length("n_name")), 2, "0")), F.encode("n_name", "UTF-8"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.decode(B.over(B.octets, "binary")(value), "UTF-8").alias("contents"))


def _jpegs(spark, sf_dir):
    """Heads of JPEG files with fill bytes, a marker without contents, a table 1, a table 0 whose
    entries are the part's size plus their place, and another table 0."""
    ship(spark)
    entry = lambda i: F.lpad(F.hex((F.col("p_size") + i).cast("long")), 2, "0")
    entries = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), entry), "")
    head = F.concat(F.lit("FFD8FFE00004AAAA" + "00FFFFFFD0" + "FFDB008401" + "07" * 64 + "00"), entries, F.lit("FFDB004300" + "09" * 64 + "FFDA0002"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.unhex(head).alias("jpeg"))


#: Places row by row of the stored order, for SQL: diagonal by diagonal, up and down in turn.
_PLACES = "(SELECT r, c, row_number() OVER (ORDER BY r + c, CASE WHEN (r + c) % 2 = 1 THEN r ELSE c END) - 1 AS i FROM (SELECT unnest(range(8)) AS r), (SELECT unnest(range(8)) AS c))"


@book.query(f"SELECT p_partkey AS k, list(CAST(p_size + i AS INTEGER) ORDER BY r, c) AS entries FROM part, {_PLACES} GROUP BY p_partkey")
def h42_luminance_table(spark, sf_dir):
    return _jpegs(spark, sf_dir).select("k", B.over(B.luminance_table, "array<int>")("jpeg").alias("entries"))


@book.query(f"SELECT p_partkey AS k, CASE WHEN p_size % 3 <> 2 THEN list(CAST(CASE WHEN p_size % 3 = 0 THEN p_size + i ELSE 256 * p_size + i END AS INTEGER) ORDER BY r, c) END AS entries FROM part, {_PLACES} GROUP BY p_partkey, p_size")
def h43_quantisation_table(spark, sf_dir):
    """Segments of entries of one byte, of two bytes, and cut off."""
    ship(spark)
    wide, cut = F.col("p_size") % 3 == 1, F.col("p_size") % 3 == 2
    entry = lambda i: F.when(wide, F.concat(F.lpad(F.hex("p_size"), 2, "0"), F.lpad(F.hex(i.cast("long")), 2, "0"))).otherwise(F.lpad(F.hex((F.col("p_size") + i).cast("long")), 2, "0"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), entry), "")
    segment = F.concat(F.when(wide, "10").otherwise("00"), F.when(cut, F.substring(body, 1, 126)).otherwise(body))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), B.over(B.quantisation_table, "array<int>")(F.unhex(segment)).alias("entries"))


_STANDARD = "[" + ", ".join(map(str, B.STANDARD_LUMINANCE)) + "]"


@book.query(f"""WITH s AS (SELECT p_partkey AS k, avg((100.0::DOUBLE * (p_size + i) - 50.0::DOUBLE) / ({_STANDARD})[CAST(r * 8 + c + 1 AS INTEGER)]) FILTER (p_size + i BETWEEN 2 AND 254) AS scale FROM part, {_PLACES} GROUP BY p_partkey)
    SELECT k, round(least(greatest(CASE WHEN scale <= 100 THEN (200 - scale) / 2 ELSE 5000 / scale END, 1), 100), 6) AS quality FROM s""")
def d10_jpeg_quality(spark, sf_dir):
    return _jpegs(spark, sf_dir).select("k", F.round(B.over(B.jpeg_quality, "double")("jpeg"), 6).alias("quality"))


_PIXELS = "list_transform(range(64), lambda i: [(n_nationkey * 7 + i) % 256, (i * 3) % 256, 255 - i, 255])"


def _pixels(spark, sf_dir):
    """8 x 8 pixels of four channels for each nation."""
    ship(spark)
    channel = lambda i: F.concat(*[F.lpad(F.hex(c.cast("long")), 2, "0") for c in ((F.col("n_nationkey") * 7 + i) % 256, (i * 3) % 256, 255 - i, F.lit(255))])
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), channel), "")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.unhex(text).alias("pixels"))


_PIXEL = "lpad(hex((n_nationkey * 7 + i) % 256), 2, '0') || lpad(hex((i * 3) % 256), 2, '0') || lpad(hex(255 - i), 2, '0') || 'FF'"


@book.query("SELECT n_nationkey AS k, array_to_string(list_transform(range(64), lambda i: lpad(hex(255 - i), 2, '0') || lpad(hex((i * 3) % 256), 2, '0') || lpad(hex((n_nationkey * 7 + i) % 256), 2, '0') || 'FF'), '') AS pixels FROM nation")
def h69_swap_channels(spark, sf_dir):
    ship(spark)
    return _pixels(spark, sf_dir).select("k", F.hex(B.over(B.swap_red_blue, "binary")("pixels")).alias("pixels"))


@book.query(f"SELECT n_nationkey AS k, array_to_string(list_transform(list_filter(range(64), lambda i: i % 8 BETWEEN 2 AND 3 AND i // 8 BETWEEN 1 AND 3), lambda i: {_PIXEL}), '') AS pixels FROM nation")
def h27_crop(spark, sf_dir):
    """Columns 2 and 3 of rows 1 to 3."""
    ship(spark)
    cropped = B.over(lambda p: B.crop(p, 8, (2, 1, 4, 4)), "binary")("pixels")
    return _pixels(spark, sf_dir).select("k", F.hex(cropped).alias("pixels"))


@book.query(f"SELECT n_nationkey AS k, array_to_string(list_transform(range(64), lambda i: CASE WHEN (i % 8 BETWEEN 1 AND 2 AND i // 8 < 2) OR (i % 8 >= 6 AND i // 8 BETWEEN 5 AND 6) THEN '000000FF' ELSE {_PIXEL} END), '') AS pixels FROM nation")
def h26_burn_regions(spark, sf_dir):
    """Two windows of eight by eight pixels are black, the others as they were."""
    ship(spark)
    burnt = B.over(lambda p: B.burn(p, 8, [(1, 0, 3, 2), (6, 5, 8, 7)]), "binary")("pixels")
    return _pixels(spark, sf_dir).select("k", F.hex(burnt).alias("pixels"))


@book.query("SELECT n_nationkey AS k, [n_nationkey % 5, n_nationkey // 5, n_nationkey % 5 + 2 + n_nationkey % 2, n_nationkey // 5 + 3]::INTEGER[] AS box FROM nation")
def d06_ink_box(spark, sf_dir):
    """White pictures of 8 x 8 pixels with a dark rectangle somewhere, and, in most, a dark pixel alone."""
    ship(spark)
    x, y, k = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5), F.col("n_nationkey")
    dark = lambda i: ((i % 8).between(x, x + 1 + k % 2) & F.floor(i / 8).between(y, y + 2)) | (i == F.when((x >= 2) & (y >= 2), 0).when((x <= 3) & (y <= 2), 63).otherwise(-1))
    pixels = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(dark(i), "FF40FFFF").otherwise("FFFFFFFF")), "")
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), F.unhex(pixels).alias("pixels"))
    return rows.select("k", B.over(lambda p: B.ink_box(p, 8), "array<int>")("pixels").alias("box"))


#: Strips of G24: per part a page of 12 x 24 pixels in three strips, white but for a dark rectangle.
_INK = "(SELECT p_partkey AS k, p_size % 7 AS x0, p_size % 5 AS w, p_partkey % 17 AS y0, p_partkey % 8 AS h FROM part)"


@book.query(f"SELECT k, CASE WHEN h > 1 AND w > 1 THEN [x0, y0, x0 + w, y0 + h]::INTEGER[] END AS box, CASE WHEN h > 1 AND w > 1 THEN [x0 * 50.0, 792.0 - (y0 + h) * 33.0, (x0 + w) * 50.0, 792.0 - y0 * 33.0]::DOUBLE[] END AS ink FROM {_INK}")
def g24_margins(spark, sf_dir):
    """Ink boxes of pages from partial results of strips; rectangles cross strips or lie within one,
    and lines of a single pixel are no ink."""
    ship(spark)
    k, size = F.col("p_partkey"), F.col("p_size")
    x0, w, y0, h = size % 7, size % 5, k % 17, k % 8
    white, dark = "FFFFFFFF", "FF40FFFF"
    inked = F.concat(F.repeat(F.lit(white), x0), F.repeat(F.lit(dark), w), F.repeat(F.lit(white), 12 - x0 - w))
    above = F.least(F.greatest(y0 - F.col("y0"), F.lit(0)), F.lit(8))
    upto = F.least(F.greatest(y0 + h - F.col("y0"), F.lit(0)), F.lit(8))
    blank = lambda n: F.repeat(F.lit(white * 12), n.cast("int"))
    pixels = F.concat(blank(above), F.repeat(inked, (upto - above).cast("int")), blank(8 - upto))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, (0, 8, 16)))).alias("y0"))
    strips = parts.select(k.alias("doc_id"), F.lit(1).alias("page"), "y0", F.lit(8).alias("rows"), F.lit(12).alias("width"), F.lit(24).alias("height"), F.lit(600.0).alias("page_w"), F.lit(792.0).alias("page_h"), F.unhex(pixels).alias("pixels"))
    sides = lambda b, t: F.when(F.col(b).isNotNull(), F.array(*[F.col(f"{b}.{c}") for c in ("x0", "y0", "x1", "y1")])).cast(t)
    return M.ink_boxes(strips).select(F.col("doc_id").alias("k"), sides("box", "array<int>").alias("box"), F.transform(sides("ink", "array<double>"), lambda v: F.round(v, 6)).alias("ink"))


@book.query("SELECT n_nationkey AS k, 2.0::DOUBLE * (n_nationkey + 1) AS width FROM nation")
def e10_displayed_width(spark, sf_dir):
    """q, a scaling, an image, Q, the image again at its natural size."""
    ship(spark)
    drawn = B.over(lambda s: B.displayed_widths([("q", []), ("cm", [2.0 * s, 0, 0, 1, 5, 5]), ("Do im", []), ("Q", []), ("Do im", [])])["im"], "double")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), drawn(F.col("n_nationkey") + 1).alias("width"))
