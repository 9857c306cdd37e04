"""Geometry over rectangles made of line items: quantity, part, discount and tax as coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .registry import Book, table

book = Book()

#: Pages that are on screen at a time, at most.
MOST_BOXES = 100
RECTS = "(SELECT l_orderkey AS k, l_linenumber AS n, l_quantity * 10.0::DOUBLE AS x, CAST(l_partkey % 700 AS DOUBLE) AS y, l_discount * 1000.0::DOUBLE + 4.0::DOUBLE AS width, l_tax * 300.0::DOUBLE + 6.0::DOUBLE AS height, CAST((l_suppkey % 5) * 90 - 90 AS INTEGER) AS rot FROM lineitem)"


def rects(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
        (F.col("l_quantity") * 10.0).alias("x"),
        F.pmod(F.col("l_partkey"), F.lit(700)).cast("double").alias("y"),
        (F.col("l_discount") * 1000.0 + 4.0).alias("width"),
        (F.col("l_tax") * 300.0 + 6.0).alias("height"),
        (F.pmod(F.col("l_suppkey"), F.lit(5)) * 90 - 90).cast("int").alias("rot"),
    )


def r_():
    return G.rect(F.col("x"), F.col("y"), F.col("width"), F.col("height"))


def b_():
    return G.box(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"))


def page_w():
    return F.lit(612.0)


def page_h():
    return F.lit(792.0)


def keyed(df: DataFrame, *columns) -> DataFrame:
    return df.select("k", "n", *columns)


@book.query(f"SELECT k, n, x, 792.0::DOUBLE - (y + height) AS y, width, height FROM {RECTS}")
def flip_rects(spark, sf_dir):
    return keyed(rects(spark, sf_dir).withColumn("r", G.flip_y(r_(), page_h())), "r.x", "r.y", "r.width", "r.height")


@book.query(f"SELECT k, n, x * (612.0::DOUBLE / 1700.0::DOUBLE) AS x, 792.0::DOUBLE - (y + height) * (792.0::DOUBLE / 2200.0::DOUBLE) AS y FROM {RECTS}")
def h22_pixels_to_points(spark, sf_dir):
    r = G.pixels_to_points(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"), F.lit(1700.0), F.lit(2200.0), page_w(), page_h())
    return keyed(rects(spark, sf_dir).withColumn("r", r), "r.x", "r.y")


@book.query(f"SELECT k, list(x * (612.0::DOUBLE / 1700.0::DOUBLE) ORDER BY n, x, y) AS xs FROM {RECTS} GROUP BY k")
def h23_map_words(spark, sf_dir):
    words = rects(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y", "width", "height"))).alias("words"))
    place = lambda w: G.pixels_to_points(w["x"], w["y"], w["x"] + w["width"], w["y"] + w["height"], F.lit(1700.0), F.lit(2200.0), page_w(), page_h())["x"]
    return words.select("k", F.transform("words", place).alias("xs"))


@book.query(f"""SELECT k, n, x0, y0, x1, y1 FROM (SELECT k, n, CAST(greatest(floor((x - 1.0::DOUBLE) * (1275.0::DOUBLE / 612.0::DOUBLE)), 0) AS BIGINT) AS x0, CAST(greatest(floor((y - 1.0::DOUBLE) * (1650.0::DOUBLE / 792.0::DOUBLE)), 0) AS BIGINT) AS y0,
    CAST(least(ceil((x + width + 1.0::DOUBLE) * (1275.0::DOUBLE / 612.0::DOUBLE)), 1275) AS BIGINT) AS x1, CAST(least(ceil((y + height + 1.0::DOUBLE) * (1650.0::DOUBLE / 792.0::DOUBLE)), 1650) AS BIGINT) AS y1 FROM {RECTS}) WHERE x1 > x0 AND y1 > y0""")
def h25_region_to_pixels(spark, sf_dir):
    b = G.points_to_pixels(r_(), 1.0, F.lit(1275.0), F.lit(1650.0), page_w(), page_h())
    return keyed(rects(spark, sf_dir).withColumn("b", b).where("b IS NOT NULL"), "b.x0", "b.y0", "b.x1", "b.y1")


def m1():
    return G.matrix(F.col("x"), F.col("y"), 2, F.col("width"), 1, F.col("height"))


def m2():
    return G.matrix(1, F.col("width"), F.col("height"), 3, F.col("x"), 5)


@book.query(f"SELECT k, n, x * 1.0::DOUBLE + y * height AS a, x * width + y * 3.0::DOUBLE AS b, 2.0::DOUBLE * 1.0::DOUBLE + width * height AS c, 2.0::DOUBLE * width + width * 3.0::DOUBLE AS d, 1.0::DOUBLE * 1.0::DOUBLE + height * height + x AS e, 1.0::DOUBLE * width + height * 3.0::DOUBLE + 5.0::DOUBLE AS f FROM {RECTS}")
def h34_compose(spark, sf_dir):
    return keyed(rects(spark, sf_dir).withColumn("m", G.compose(m1(), m2())), "m.*")


@book.query(f"SELECT k, n, round(width / (x * width - y * 2.0::DOUBLE), 9) AS a, round(-y / (x * width - y * 2.0::DOUBLE), 9) + 0.0::DOUBLE AS b FROM {RECTS} WHERE x * width - y * 2.0::DOUBLE <> 0")
def h35_invert(spark, sf_dir):
    df = rects(spark, sf_dir).withColumn("m", G.invert(m1())).where("m.a IS NOT NULL")
    return keyed(df, F.round("m.a", 9).alias("a"), (F.round("m.b", 9) + 0.0).alias("b"))


@book.query(f"SELECT k, n, x * 3.0::DOUBLE + 2.0::DOUBLE * 7.0::DOUBLE + 1.0::DOUBLE AS px, y * 3.0::DOUBLE + width * 7.0::DOUBLE + height AS py FROM {RECTS}")
def h36_apply(spark, sf_dir):
    return keyed(rects(spark, sf_dir), G.apply_x(m1(), F.lit(3.0), F.lit(7.0)).alias("px"), G.apply_y(m1(), F.lit(3.0), F.lit(7.0)).alias("py"))


@book.query(f"SELECT k, n, (612.0::DOUBLE - 1.5::DOUBLE * ((x + width) - x)) / 2.0::DOUBLE - 1.5::DOUBLE * x AS e, (792.0::DOUBLE - 18.0::DOUBLE) - 1.5::DOUBLE * (y + height) AS f FROM {RECTS}")
def h37_display_fit(spark, sf_dir):
    return keyed(rects(spark, sf_dir).withColumn("m", G.display_fit(page_w(), page_h(), b_(), F.lit(1.5), 18.0)), "m.e", "m.f")


@book.query(f"""SELECT k, n, CASE (rot + 360) % 360 WHEN 90 THEN -y WHEN 180 THEN x + width WHEN 270 THEN y + height ELSE -x END AS e, CASE (rot + 360) % 360 WHEN 90 THEN x + width WHEN 180 THEN y + height WHEN 270 THEN -x ELSE -y END AS f,
    CASE (rot + 360) % 360 WHEN 0 THEN 1.0::DOUBLE WHEN 180 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS a FROM {RECTS}""")
def h38_user_to_display(spark, sf_dir):
    return keyed(rects(spark, sf_dir).withColumn("m", G.user_to_display(F.col("rot"), b_())), "m.e", "m.f", "m.a")


@book.query(f"SELECT k, n, round(1.5::DOUBLE, 6) AS a, CASE (rot + 360) % 360 WHEN 0 THEN round(20.0::DOUBLE + x * 0.5::DOUBLE * -1.0::DOUBLE + 0.0::DOUBLE, 6) END AS e FROM {RECTS}")
def h39_user_fit(spark, sf_dir):
    """Scaling by 1.5 about the box corner and a shift of 20 points, seen from page space."""
    m = G.user_fit(G.matrix(1.5, 0, 0, 1.5, 20, 0), F.col("rot"), b_())
    return keyed(rects(spark, sf_dir).withColumn("m", m), F.round("m.a", 6).alias("a"), F.when(F.pmod("rot", F.lit(360)) == 0, F.round("m.e", 6)).alias("e"))


@book.query(f"SELECT k, n, CASE WHEN n % 3 = 0 THEN x WHEN n % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x0, CASE WHEN n % 3 = 0 THEN x + width WHEN n % 3 = 1 THEN 500.0::DOUBLE ELSE 612.0::DOUBLE END AS x1 FROM {RECTS}")
def h40_effective_box(spark, sf_dir):
    media = G.box(F.lit(1.0), F.lit(2.0), F.lit(500.0), F.lit(700.0))
    b = G.effective_box(F.when(F.col("n") % 3 == 0, b_()), F.when(F.col("n") % 3 == 1, media))
    return keyed(rects(spark, sf_dir).withColumn("b", b), "b.x0", "b.x1")


@book.query(f"SELECT k, n, CASE WHEN n % 2 = 0 THEN x ELSE 0.0::DOUBLE END AS ox, CASE WHEN n % 2 = 0 THEN y ELSE 0.0::DOUBLE END AS oy FROM {RECTS}")
def h72_page_origin(spark, sf_dir):
    b = F.coalesce(F.when(F.col("n") % 2 == 0, b_()), G.box(*[F.lit(0.0)] * 4))
    return keyed(rects(spark, sf_dir).withColumn("b", b), F.col("b.x0").alias("ox"), F.col("b.y0").alias("oy"))


@book.query(f"SELECT k, n, round(sqrt(x * x + y * y), 6) AS displayed FROM {RECTS}")
def h41_displayed_width(spark, sf_dir):
    return keyed(rects(spark, sf_dir), F.round(F.hypot("x", "y"), 6).alias("displayed"))


@book.query(f"SELECT k, n, least(x * -2.0::DOUBLE + 0.0::DOUBLE * y + 10.0::DOUBLE, (x + width) * -2.0::DOUBLE + 10.0::DOUBLE) AS x0, greatest(x * -2.0::DOUBLE + 10.0::DOUBLE, (x + width) * -2.0::DOUBLE + 10.0::DOUBLE) AS x1, 3.0::DOUBLE * y - 5.0::DOUBLE AS y0 FROM {RECTS}")
def g25_transform_rects(spark, sf_dir):
    return keyed(rects(spark, sf_dir).withColumn("b", G.map_rect(b_(), G.matrix(-2, 0, 0, 3, 10, -5))), "b.x0", "b.x1", "b.y0")


@book.query(f"SELECT k, n, abs(x - 10.0::DOUBLE) < 0.5 AND y < 0.5 AND (rot + 360) % 360 = 0 AS simple FROM {RECTS}")
def b24_geometry_is_simple(spark, sf_dir):
    return keyed(rects(spark, sf_dir), G.is_simple(F.col("x") - 10.0, F.col("y"), F.col("rot")).alias("simple"))


@book.query(f"SELECT k, min(least(576.0::DOUBLE / ((x + width) - x), 756.0::DOUBLE / ((y + height) - y))) AS scale FROM {RECTS} GROUP BY k")
def d01_uniform_scale(spark, sf_dir):
    return rects(spark, sf_dir).groupBy("k").agg(F.min(G.ink_scale(page_w(), page_h(), b_(), 18.0)).alias("scale"))


@book.query(f"SELECT k, min(x) AS l, min(612.0::DOUBLE - (x + width)) AS r, min(y) AS b, min(792.0::DOUBLE - (y + height)) AS t FROM {RECTS} GROUP BY k")
def d02_smallest_margins(spark, sf_dir):
    b = rects(spark, sf_dir).withColumn("b", b_())
    return b.groupBy("k").agg(F.min("b.x0").alias("l"), F.min(page_w() - F.col("b.x1")).alias("r"), F.min("b.y0").alias("b"), F.min(page_h() - F.col("b.y1")).alias("t"))


@book.query(f"SELECT k, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM {RECTS} GROUP BY k")
def d07_union_rect(spark, sf_dir):
    x, y = F.min("x"), F.min("y")
    return rects(spark, sf_dir).groupBy("k").agg(x.alias("x"), y.alias("y"), (F.max(G.right(r_())) - x).alias("width"), (F.max(G.bottom(r_())) - y).alias("height"))


@book.query(f"SELECT k, n, s AS scale, (612.0::DOUBLE - s * ((x + width) - x)) / 2.0::DOUBLE - s * x AS dx FROM {RECTS} CROSS JOIN (SELECT min(least(576.0::DOUBLE / ((x + width) - x), 756.0::DOUBLE / ((y + height) - y))) AS s FROM {RECTS})")
def g23_expand_margins(spark, sf_dir):
    """One scale for all pages, as a single broadcast row, then each page's matrix."""
    df = rects(spark, sf_dir)
    scale = df.agg(F.min(G.ink_scale(page_w(), page_h(), b_(), 18.0)).alias("scale"))
    return keyed(df.crossJoin(F.broadcast(scale)).withColumn("m", G.display_fit(page_w(), page_h(), b_(), F.col("scale"), 18.0)), "scale", F.col("m.e").alias("dx"))


@book.query(f"SELECT k, n, x * 1.25::DOUBLE + 3.0::DOUBLE AS x, 12.0::DOUBLE * 1.25::DOUBLE AS font_size FROM {RECTS}")
def g26_transform_note(spark, sf_dir):
    return keyed(rects(spark, sf_dir), (F.col("x") * 1.25 + 3.0).alias("x"), (F.lit(12.0) * 1.25).alias("font_size"))


@book.query(f"SELECT k, n, least(x, 300.0::DOUBLE) AS x, 792.0::DOUBLE - greatest(y, 400.0::DOUBLE) AS y, abs(300.0::DOUBLE - x) AS width FROM {RECTS}")
def h71_widget_rect(spark, sf_dir):
    r = G.corner_rect(F.col("x"), F.col("y"), F.lit(300.0), F.lit(400.0), page_h())
    return keyed(rects(spark, sf_dir).withColumn("r", r), "r.x", "r.y", "r.width")


@book.query(f"""SELECT k, n, (greatest(x, 50.0::DOUBLE) - 50.0::DOUBLE) / 1.5::DOUBLE AS x, (least(x + width, 450.0::DOUBLE) - greatest(x, 50.0::DOUBLE)) / 1.5::DOUBLE AS width FROM {RECTS}
    WHERE (least(x + width, 450.0::DOUBLE) - greatest(x, 50.0::DOUBLE)) / 1.5::DOUBLE >= 2 AND (least(y + height, 620.0::DOUBLE) - greatest(y, 20.0::DOUBLE)) / 1.5::DOUBLE >= 2""")
def c31_clip_region(spark, sf_dir):
    page = G.rect(F.lit(50.0), F.lit(20.0), F.lit(400.0), F.lit(600.0))
    df = rects(spark, sf_dir).withColumn("r", G.clip_region(r_(), page, F.lit(150.0))).where("r IS NOT NULL")
    return keyed(df, "r.x", "r.width")


@book.query(f"SELECT k, n, p, (greatest(x, p * 200.0::DOUBLE) - p * 200.0::DOUBLE) / 1.0::DOUBLE AS x FROM {RECTS}, (SELECT CAST(r_regionkey AS DOUBLE) AS p FROM region) WHERE least(x + width, p * 200.0::DOUBLE + 180.0::DOUBLE) - greatest(x, p * 200.0::DOUBLE) >= 2 AND least(y + height, 700.0::DOUBLE) - greatest(y, 0.0::DOUBLE) >= 2")
def c32_selection_regions(spark, sf_dir):
    """Selected rectangles on every page box on screen: a handful, which are counted."""
    boxes = [r["p"] for r in table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("double").alias("p")).limit(MOST_BOXES + 1).collect()]
    if len(boxes) > MOST_BOXES:
        raise ValueError(f"more than {MOST_BOXES} pages on screen")
    df = rects(spark, sf_dir).withColumn("p", F.explode(F.array(*[F.lit(p) for p in boxes])))
    page = G.rect(F.col("p") * 200.0, F.lit(0.0), F.lit(180.0), F.lit(700.0))
    return df.withColumn("r", G.clip_region(r_(), page, F.lit(100.0))).where("r IS NOT NULL").select("k", "n", "p", "r.x")


@book.query(f"SELECT k, n, least(x, y) AS x, abs(y - x) AS width FROM {RECTS} WHERE abs(y - x) >= 2 AND abs(height - width) >= 2")
def c33_drag_region(spark, sf_dir):
    r = G.drag_region(F.col("x"), F.col("width"), F.col("y"), F.col("height"))
    return keyed(rects(spark, sf_dir).withColumn("r", r).where("r IS NOT NULL"), "r.x", "r.width")


@book.query(f"SELECT k, n, (x + width / 2) * 1.25::DOUBLE - greatest(width * 1.25::DOUBLE + 6.0::DOUBLE, 6.0::DOUBLE) / 2 AS \"left\", greatest(height * 1.25::DOUBLE + 6.0::DOUBLE, 14.0::DOUBLE) AS height FROM {RECTS}")
def h68_highlight_box(spark, sf_dir):
    return keyed(rects(spark, sf_dir).withColumn("h", G.highlight_box(r_(), F.lit(1.25))), "h.left", "h.height")


@book.query(f"SELECT k, n, CASE WHEN 100.0::DOUBLE + y * 1.5::DOUBLE >= 300 AND 100.0::DOUBLE + y * 1.5::DOUBLE + height * 1.5::DOUBLE <= 300.0::DOUBLE + 500.0::DOUBLE THEN NULL ELSE greatest(((100.0::DOUBLE + y * 1.5::DOUBLE) + (100.0::DOUBLE + y * 1.5::DOUBLE + height * 1.5::DOUBLE)) / 2 - 500.0::DOUBLE / 2, 0.0::DOUBLE) END AS target FROM {RECTS}")
def h67_scroll_target(spark, sf_dir):
    return keyed(rects(spark, sf_dir), G.scroll_target(F.lit(100.0), r_(), F.lit(150.0), F.lit(300.0), F.lit(500.0)).alias("target"))


@book.query(f"""SELECT k, n, CAST(CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN greatest(least(floor((900.0::DOUBLE - 40.0::DOUBLE) / (x + 10.0::DOUBLE) * 100 + 0.5::DOUBLE), 400), 10)
    WHEN 2 THEN greatest(least(floor((900.0::DOUBLE - 40.0::DOUBLE) / (x + 10.0::DOUBLE) * 100 * 0.9::DOUBLE + 0.5::DOUBLE), 400), 10) ELSE greatest(least(floor((700.0::DOUBLE - 40.0::DOUBLE) / (y + 10.0::DOUBLE) * 100 + 0.5::DOUBLE), 400), 10) END AS BIGINT) AS zoom FROM {RECTS}""")
def h66_fit_zoom(spark, sf_dir):
    mode = F.element_at(F.array(*[F.lit(m) for m in ("numeric", "fit-width", "fit-width-90", "fit-page")]), F.col("n") % 4 + 1)
    return keyed(rects(spark, sf_dir), G.fit_zoom(mode, F.col("x") + 10.0, F.col("y") + 10.0, F.lit(900.0), F.lit(700.0), 40.0).cast("long").alias("zoom"))


@book.query(f"SELECT k, n, x, y, row_number() OVER (PARTITION BY k ORDER BY y, x, n, width, height) AS position FROM {RECTS}")
def f01_rect_order(spark, sf_dir):
    """The rectangles of each page from the top, then from the left, with their place."""
    place = F.row_number().over(Window.partitionBy("k").orderBy("y", "x", "n", "width", "height")).cast("long")
    return keyed(rects(spark, sf_dir), "x", "y", place.alias("position"))


@book.query(f"SELECT k, n, x, y, row_number() OVER (PARTITION BY k ORDER BY y DESC, x, n, width, height) AS position FROM {RECTS}")
def f02_word_order(spark, sf_dir):
    """The words of each page, whose origin is below, from the top, then from the left, with their place."""
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("y"), "x", "n", "width", "height")).cast("long")
    return keyed(rects(spark, sf_dir), "x", "y", place.alias("position"))


@book.query(f"SELECT k, n, greatest(x - 25.0::DOUBLE, 0.0::DOUBLE) AS x, greatest(width - 20.0::DOUBLE, 24.0::DOUBLE) AS width, greatest(height - 5.0::DOUBLE, 16.0::DOUBLE) AS height FROM {RECTS}")
def h76_move_resize(spark, sf_dir):
    floor = lambda c, by, least: F.greatest(F.col(c) - by, F.lit(least)).alias(c)
    return keyed(rects(spark, sf_dir), floor("x", 25.0, 0.0), floor("width", 20.0, 24.0), floor("height", 5.0, 16.0))


@book.query(f"SELECT k, n, least(greatest((x - 100.0::DOUBLE) / 300.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS u, least(greatest((y - 50.0::DOUBLE) / 400.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS v FROM {RECTS}")
def h74_normalised_point(spark, sf_dir):
    unit = lambda c, lo, size: F.least(F.greatest((F.col(c) - lo) / size, F.lit(0.0)), F.lit(1.0))
    return keyed(rects(spark, sf_dir), unit("x", 100.0, 300.0).alias("u"), unit("y", 50.0, 400.0).alias("v"))

book.queries["h70_uniform_scale"], book.sql["h70_uniform_scale"] = d01_uniform_scale, book.sql["d01_uniform_scale"]
