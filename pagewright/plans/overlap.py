"""Overlap and membership joins. Characters and regions are line items of the same order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import fields as O
from ..operators import images as I
from ..operators import notes as N
from ..operators import overlap as V
from ..operators import pages as P
from .geometry import RECTS, r_, rects
from .registry import Book, table

book = Book()

_OVER = "least(c.x + c.width, r.x + r.width) - greatest(c.x, r.x) > 1.0 AND least(c.y + c.height, r.y + r.height) - greatest(c.y, r.y) > 1.0"


def _sides(spark, sf_dir):
    df = rects(spark, sf_dir).withColumns({"y": F.col("y") % 60, "page": F.lit(1)}).withColumnRenamed("k", "doc_id")
    sides = df.select("doc_id", "page", "n", "x", "y", "width", "height")
    return sides.where("n = 1"), sides.where("n > 1")


_SIDES = f"WITH a AS (SELECT k, n, x, fmod(y, 60) AS y, width, height FROM {RECTS}), r AS (SELECT * FROM a WHERE n = 1), c AS (SELECT * FROM a WHERE n > 1)"


@book.query(f"{_SIDES} SELECT c.k, c.n FROM c JOIN r ON c.k = r.k AND {_OVER}")
def c05_overlapping_pairs(spark, sf_dir):
    """Each pair once, found in the cells of the page that both lie in."""
    regions, chars = _sides(spark, sf_dir)
    return V.pairs(chars, regions).select(F.col("doc_id").alias("k"), "l.n")


@book.query(f"{_SIDES} SELECT r.k, r.x FROM r WHERE EXISTS (SELECT 1 FROM c WHERE c.k = r.k AND {_OVER})")
def c07_leaking_regions(spark, sf_dir):
    """Each region that still has characters under it, once."""
    regions, chars = _sides(spark, sf_dir)
    return V.meeting(regions, chars).select(F.col("doc_id").alias("k"), "x")


@book.query(f"{_SIDES} SELECT r.k, CAST(count(c.n) AS BIGINT) AS leaks, count(c.n) = 0 AS verified FROM r LEFT JOIN c ON c.k = r.k AND {_OVER} GROUP BY r.k")
def d24_verify_regions(spark, sf_dir):
    """Leaks per document, and whether there are none."""
    regions, chars = _sides(spark, sf_dir)
    leaks = V.pairs(chars, regions).groupBy("doc_id").agg(F.count("*").alias("leaks"))
    rows = regions.select("doc_id").distinct().join(leaks, "doc_id", "left").select(F.col("doc_id").alias("k"), F.coalesce("leaks", F.lit(0)).alias("leaks"))
    return rows.withColumn("verified", F.col("leaks") == 0)


@book.query(f"SELECT k, list(n ORDER BY n) AS regions FROM {RECTS} GROUP BY k")
def d11_regions_by_page(spark, sf_dir):
    return rects(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list("n")).alias("regions"))


@book.query(f"SELECT k, CAST(count(*) AS BIGINT) AS n_regions FROM {RECTS} GROUP BY k")
def d12_checked_regions(spark, sf_dir):
    """A region without area fails the job."""
    df = rects(spark, sf_dir).where(F.assert_true((F.col("width") > 0) & (F.col("height") > 0), "region without area").isNull())
    return df.groupBy("k").agg(F.count("*").alias("n_regions"))


@book.query(f"SELECT k, min(n) AS hit FROM {RECTS} WHERE 205.0 BETWEEN x AND x + width AND 20.0 BETWEEN fmod(y, 60) AND fmod(y, 60) + height GROUP BY k")
def c30_hit_test(spark, sf_dir):
    """The first note, by number, that a point is in."""
    df = rects(spark, sf_dir).withColumn("y", F.col("y") % 60)
    return df.where(G.contains_point(r_(), F.lit(205.0), F.lit(20.0))).groupBy("k").agg(F.min("n").alias("hit"))


_ON = "(SELECT l_suppkey AS doc_id, l_partkey AS widget, min(l_linenumber) AS page FROM lineitem WHERE l_linenumber > 1 GROUP BY l_suppkey, l_partkey)"


def _annotations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("widget"), F.col("l_linenumber").alias("page"))


@book.query(f"SELECT doc_id, widget, page FROM {_ON}")
def c01_widget_pages(spark, sf_dir):
    return O.widget_pages(_annotations(spark, sf_dir))


@book.query(f"SELECT doc_id, widget, page FROM (SELECT w.doc_id, w.widget, coalesce(p.page, w.own) AS page FROM (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS widget, CAST(CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 4 END AS INTEGER) AS own FROM lineitem) w LEFT JOIN {_ON} p USING (doc_id, widget)) WHERE page <> 0")
def c02_place_with_fallback(spark, sf_dir):
    """The page a widget is listed on, else its own note of it; 0 is no page."""
    own = F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 4).cast("int").alias("own_page")
    widgets = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("widget"), own).distinct()
    return O.placed(widgets, O.widget_pages(_annotations(spark, sf_dir)))


@book.query("SELECT l_orderkey AS page, l_linenumber AS name, l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def c03_known_images(spark, sf_dir):
    """Names of pages' resources that stand for a known image."""
    known = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    resources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("name"), F.col("l_partkey").alias("id"))
    return I.image_names(resources, known)


@book.query(f"SELECT doc_id, widget FROM {_ON}")
def c21_live_ids(spark, sf_dir):
    """Annotations that are on a page, each once."""
    return O.widget_pages(_annotations(spark, sf_dir)).select("doc_id", "widget")


@book.query("SELECT DISTINCT ref FROM (SELECT s_suppkey AS ref FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def c25_signature_union(spark, sf_dir):
    """Signatures that the form or the permissions refer to."""
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ref"))
    return O.referred(a, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ref")))


@book.query("SELECT DISTINCT l_suppkey AS ref FROM lineitem WHERE l_linenumber <> 2")
def c26_dedup_insert(spark, sf_dir):
    return O.referred(table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 2, F.col("l_suppkey")).alias("ref")))


@book.query("SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS note FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 4 + 1")
def c28_notes_on_pages(spark, sf_dir):
    """Notes on a page that isn't there are left out; here each document has one page."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 4 + 1).alias("page"))
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), F.col("l_partkey").alias("note"))
    return N.on_pages(notes, pages).withColumn("page", F.col("page").cast("int"))


@book.query("SELECT c_custkey AS doc_id, EXISTS (SELECT 1 FROM customer o WHERE o.c_nationkey = c.c_nationkey AND o.c_mktsegment = c.c_mktsegment AND o.c_custkey <> c.c_custkey) AS elsewhere FROM customer c")
def b26_open_elsewhere(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("path"))
    return P.open_elsewhere(docs).select("doc_id", "elsewhere")
