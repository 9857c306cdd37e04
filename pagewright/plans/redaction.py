"""Scrubbing and redaction. Documents are customers, pages their orders, words their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scrub as R
from .geometry import RECTS, rects
from .metadata import FIELDS, _INFO, _MATCHED, _QUERIES, info
from .registry import Book, table

book = Book()

#: A word that some line items have for a text.
_QUERY = "w7"


def _keyed(always: tuple[str, ...], some: tuple[tuple[str, str], ...]):
    """A map of keys that are always there, and of keys under a condition, to a value."""
    keys = F.concat(F.array(*[F.lit(k) for k in always]), *[F.when(F.expr(c), F.array(F.lit(k))).otherwise(F.array().cast("array<string>")) for k, c in some])
    return F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit("1")))


def _keyed_sql(always: tuple[str, ...], some: tuple[tuple[str, str], ...]) -> str:
    return "list_filter([" + ", ".join([*(f"'{k}'" for k in always), *(f"CASE WHEN {c} THEN '{k}' END" for k, c in some)]) + "], lambda k: k IS NOT NULL)"


_CATALOGUE = ("Type", "Pages"), (("Metadata", "c_nationkey % 2 = 0"), ("OpenAction", "c_nationkey % 3 = 0"), ("Outlines", "c_nationkey % 4 = 0"), ("OCProperties", "c_nationkey = 5"), ("AF", "c_nationkey = 11"), ("Lang", "c_nationkey % 5 = 0"))
_NAMES = ("Dests",), (("JavaScript", "c_nationkey % 3 = 1"), ("EmbeddedFiles", "c_nationkey % 4 = 1"))
_FORM = ("Fields",), (("XFA", "c_nationkey % 7 = 0"),)
_PAGE = ("Type", "Contents"), (("Thumb", "o_orderkey % 2 = 0"), ("Annots", "o_orderstatus = 'F'"), ("PieceInfo", "o_orderkey % 5 = 0"), ("Rotate", "o_orderkey % 3 = 0"))
_DOCS_SQL = f"(SELECT c_custkey AS doc_id, {_keyed_sql(*_CATALOGUE)} AS catalogue, {_keyed_sql(*_NAMES)} AS names, {_keyed_sql(*_FORM)} AS form FROM customer)"
_PAGES_SQL = f"(SELECT o_custkey AS doc_id, o_orderkey AS page, {_keyed_sql(*_PAGE)} AS keys FROM orders)"
#: A field per customer, with one below it per order; finished orders have a widget.
_FIELDS_SQL = "(SELECT c_custkey AS doc_id, 'f' || c_custkey AS node FROM customer UNION ALL SELECT o_custkey, 'k' || o_orderkey FROM orders)"
_LIVE_SQL = "(SELECT o_custkey AS doc_id, 'k' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, 'f' || o_custkey FROM orders WHERE o_orderstatus = 'F')"


def documents(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumns({"catalogue": _keyed(*_CATALOGUE), "names": _keyed(*_NAMES), "form": _keyed(*_FORM)})
    return rows.select(F.col("c_custkey").alias("doc_id"), "catalogue", "names", "form").join(info(spark, sf_dir), "doc_id")


def pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), _keyed(*_PAGE).alias("keys"))


def fields(spark, sf_dir) -> DataFrame:
    top = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"))
    below = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")), F.concat(F.lit("f"), F.col("o_custkey").cast("string")))
    return top.union(below)


def annotations(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return rows.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("node"))


def words(spark, sf_dir) -> DataFrame:
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("doc_id"))
    text = F.concat(F.lit("w"), F.pmod(F.col("y"), F.lit(40)).cast("int").cast("string"))
    placed = rects(spark, sf_dir).join(owner, "k").withColumn("text", text).withColumn("y", F.col("y") % 60)
    return placed.select("doc_id", F.col("k").alias("page"), F.col("n").alias("ord"), "x", "y", "width", "height", "text")


_WORDS_SQL = f"(SELECT o_custkey AS doc_id, k AS page, n AS ord, x, fmod(y, 60) AS y, width, height, 'w' || CAST(CAST(y AS BIGINT) % 40 AS VARCHAR) AS text FROM {RECTS} JOIN orders ON k = o_orderkey)"


@book.query(f"SELECT d.doc_id, list_sort(list_filter(catalogue, lambda k: k NOT IN ('Metadata', 'OpenAction'))) AS keys, list_sort(list_filter(names, lambda k: k NOT IN ('JavaScript', 'EmbeddedFiles'))) AS names, p.n AS page_keys FROM {_DOCS_SQL} d JOIN (SELECT doc_id, CAST(sum(len(list_filter(keys, lambda k: k <> 'Thumb'))) AS BIGINT) AS n FROM {_PAGES_SQL} GROUP BY doc_id) p USING (doc_id)")
def g30_strip_extras(spark, sf_dir):
    """Named keys of the catalogue, two name trees and page thumbnails go, the rest stays."""
    docs, left = R.strip_extras(documents(spark, sf_dir), pages(spark, sf_dir))
    n = left.groupBy("doc_id").agg(F.sum(F.size("keys")).alias("page_keys"))
    return docs.join(n, "doc_id").select("doc_id", F.array_sort(F.map_keys("catalogue")).alias("keys"), F.array_sort(F.map_keys("names")).alias("names"), "page_keys")


_KEPT = " + ".join(f"({f} IS NOT NULL)::INT" for f in FIELDS)


@book.query(f"SELECT doc_id, CAST({_KEPT} - len({_MATCHED}) AS INTEGER) AS kept, true AS dropped FROM {_INFO}")
def g33_scrub_info(spark, sf_dir):
    """Entries without a query stay; without a query to look for the whole dictionary goes."""
    rows = info(spark, sf_dir)
    return rows.select("doc_id", F.size(R.scrub_info(F.col("info"), _QUERIES)).alias("kept"), R.scrub_info(F.col("info"), [" ", ""]).isNull().alias("dropped"))


@book.query(f"""SELECT d.doc_id, i.n AS info, list_sort(list_filter(catalogue, lambda k: k IN ('Type', 'Pages', 'Lang'))) AS keys, list_filter(names, lambda k: k = 'Dests') AS names, ['Fields'] AS form, coalesce(f.n, 0)::BIGINT AS fields
    FROM {_DOCS_SQL} d JOIN (SELECT doc_id, CAST({_KEPT} - len({_MATCHED}) AS INTEGER) AS n FROM {_INFO}) i USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM {_LIVE_SQL} GROUP BY doc_id) f USING (doc_id)""")
def g34_scrub_chain(spark, sf_dir):
    docs, _, left = R.scrub_leaks(documents(spark, sf_dir), pages(spark, sf_dir), fields(spark, sf_dir), annotations(spark, sf_dir), _QUERIES)
    n = left.groupBy("doc_id").agg(F.count("*").alias("fields"))
    keys = lambda c: F.array_sort(F.map_keys(c)).alias("keys" if c == "catalogue" else c)
    return docs.join(n, "doc_id", "left").select("doc_id", F.size("info").alias("info"), keys("catalogue"), keys("names"), keys("form"), F.coalesce("fields", F.lit(0).cast("long")).alias("fields"))


@book.query(f"""SELECT doc_id, 'Info field /' || unnest({_MATCHED}) || ' still contains a redacted term' AS violation FROM {_INFO}
    UNION ALL SELECT doc_id, 'catalog /' || unnest(list_filter(catalogue, lambda k: k NOT IN ('Type', 'Pages', 'Lang'))) || ' present' FROM {_DOCS_SQL}
    UNION ALL SELECT doc_id, 'name tree /' || unnest(list_filter(names, lambda k: k <> 'Dests')) || ' present' FROM {_DOCS_SQL}
    UNION ALL SELECT doc_id, 'flattened page ' || page || ': /' || unnest(list_filter(keys, lambda k: k IN ('Thumb', 'Annots', 'PieceInfo'))) || ' present' FROM {_PAGES_SQL} WHERE page % 4 = 0
    UNION ALL SELECT doc_id, 'form field without a widget (' || node || ')' FROM {_FIELDS_SQL} f WHERE NOT EXISTS (SELECT 1 FROM {_LIVE_SQL} l WHERE l.node = f.node)
    UNION ALL SELECT doc_id, 'AcroForm /XFA present' FROM {_DOCS_SQL} WHERE list_contains(form, 'XFA')""")
def g35_postconditions(spark, sf_dir):
    """Documents that weren't scrubbed: one row per forbidden thing that is still there."""
    sheets = pages(spark, sf_dir)
    return R.postconditions(documents(spark, sf_dir), sheets, fields(spark, sf_dir), annotations(spark, sf_dir), sheets.where("page % 4 = 0").select("doc_id", "page"), _QUERIES)


_MEET = "least(w.x + w.width, r.x + r.width) - greatest(w.x, r.x) > 1.0 AND least(w.y + w.height, r.y + r.height) - greatest(w.y, r.y) > 1.0"


@book.query(f"""WITH w AS (SELECT * FROM {_WORDS_SQL}), r AS (SELECT * FROM w WHERE ord = 1 AND page % 4 = 0),
    k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND r.page = w.page AND {_MEET})),
    l AS (SELECT doc_id, count(*) AS leaks FROM (SELECT DISTINCT doc_id, page FROM k WHERE contains(text, '{_QUERY}')) GROUP BY doc_id),
    d AS (SELECT doc_id, count(*) AS regions, count(DISTINCT page) AS pages_flattened FROM r GROUP BY doc_id)
    SELECT c_custkey AS doc_id, coalesce(regions, 0)::BIGINT AS regions, coalesce(pages_flattened, 0)::BIGINT AS pages_flattened, coalesce(leaks, 0)::BIGINT AS leaks, 0::BIGINT AS violations, leaks IS NULL AS verified
    FROM customer LEFT JOIN l ON l.doc_id = c_custkey LEFT JOIN d ON d.doc_id = c_custkey""")
def g37_apply_redactions(spark, sf_dir):
    """The first word of each fourth page is a region; a query is left wherever no region covers it."""
    ws = words(spark, sf_dir)
    regions = ws.where("ord = 1 AND page % 4 = 0").select("doc_id", "page", "x", "y", "width", "height")
    result, _ = R.redact(documents(spark, sf_dir), pages(spark, sf_dir), ws, fields(spark, sf_dir), annotations(spark, sf_dir), regions, [_QUERY])
    return result


@book.query("SELECT p_partkey AS k, list_filter(['Type', 'MediaBox', CASE WHEN p_size % 2 = 0 THEN 'Rotate' END], lambda x: x IS NOT NULL) AS keys FROM part")
def g36_replaced_page_keys(spark, sf_dir):
    """What is left of a page's dictionary when its content becomes one picture."""
    keys = F.array(*[F.lit(x) for x in ("Type", "MediaBox", *R.PAGE_KEYS)])
    keys = F.when(F.col("p_size") % 2 == 0, F.array_append(keys, F.lit("Rotate"))).otherwise(keys)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.map_keys(R.without(F.map_from_arrays(keys, keys), R.PAGE_KEYS)).alias("keys"))
