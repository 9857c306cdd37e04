"""Redaction of document tables: scrubbing, its postconditions, and the whole chain.

A document is a row (doc_id, info, catalogue, names, form: maps of string to string). Pages
are (doc_id, page, keys: map, width, height), words (doc_id, page, ord, x, y, width, height,
text), fields (doc_id, node, parent), annotations (doc_id, page, node): the widgets that are
on a page. Regions are (doc_id, page, x, y, width, height).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from . import trees

# Keys that go, by dictionary.
EXTRA_KEYS = ("Metadata", "OpenAction")
EXTRA_TREES = ("JavaScript", "EmbeddedFiles")
LEAK_KEYS = ("StructTreeRoot", "MarkInfo", "Outlines", "AF", "OCProperties")
FORBIDDEN_PAGE_KEYS = ("Annots", "Metadata", "PieceInfo", "Thumb", "AF")
#: Keys of a page that an image in its place makes void.
PAGE_KEYS = ("Annots", "Thumb", "BleedBox", "TrimBox", "ArtBox", "Group", "B", "AA", "StructParents", "Metadata", "PieceInfo", "AF")


def without(entries: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(*keys))


def strip_extras(docs: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without document metadata and opening action, scripts and embedded files, and
    thumbnails of pages; the rest of the name trees stays."""
    docs = docs.withColumns({"catalogue": without(F.col("catalogue"), EXTRA_KEYS), "names": without(F.col("names"), EXTRA_TREES)})
    return docs, pages.withColumn("keys", without(F.col("keys"), ("Thumb",)))


def scrub_info(info: Column, queries: list[str]) -> Column:
    """Information entries without a query in them; nothing at all (null) where there is no
    query to look for."""
    wanted = T.needles(queries)
    return F.map_filter(info, lambda _, v: ~T.contains_any(v, wanted)) if wanted else F.lit(None).cast("map<string,string>")


def live_fields(fields: DataFrame, annotations: DataFrame) -> DataFrame:
    """doc_id and node of the fields with a widget on a page, or above one."""
    key = F.struct("doc_id", "node")
    nodes = fields.select(key.alias("node"), F.when(F.col("parent").isNotNull(), F.struct("doc_id", F.col("parent").alias("node"))).alias("parent"))
    there = annotations.select(key.alias("node")).join(nodes, "node", "left_semi")
    return trees.with_live_descendant(nodes, there).select("node.doc_id", "node.node")


def scrub_leaks(docs: DataFrame, pages: DataFrame, fields: DataFrame, annotations: DataFrame, queries: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extras, information, the catalogue's text-bearing keys, the form's XML and the fields
    without a widget go; what nothing refers to any more is in none of the tables."""
    docs, pages = strip_extras(docs, pages)
    docs = docs.withColumns({"info": scrub_info(F.col("info"), queries), "catalogue": without(F.col("catalogue"), LEAK_KEYS), "form": without(F.col("form"), ("XFA",))})
    return docs, pages, fields.join(live_fields(fields, annotations), ["doc_id", "node"], "left_semi")


def postconditions(docs: DataFrame, pages: DataFrame, fields: DataFrame, annotations: DataFrame, flattened: DataFrame, queries: list[str]) -> DataFrame:
    """doc_id and violation, a row for each forbidden thing that is still there.
    ``flattened`` (doc_id, page) are the pages that became pictures."""
    wanted = T.needles(queries)
    if wanted:
        info = docs.select("doc_id", F.explode("info").alias("key", "value")).where(T.contains_any(F.col("value"), wanted))
        info = info.select("doc_id", F.concat(F.lit("Info field /"), "key", F.lit(" still contains a redacted term")).alias("violation"))
    else:
        info = docs.where(F.col("info").isNotNull()).select("doc_id", F.lit("document Info dictionary present").alias("violation"))

    def present(rows: DataFrame, column: str, keys: tuple[str, ...], what: Column) -> DataFrame:
        key = F.explode(F.array_intersect(F.array(*[F.lit(k) for k in keys]), F.map_keys(column))).alias("key")
        return rows.select("*", key).select("doc_id", F.concat(what, F.lit("/"), "key", F.lit(" present")).alias("violation"))

    page = F.concat(F.lit("flattened page "), F.col("page").cast("string"), F.lit(": "))
    bare = fields.join(live_fields(fields, annotations), ["doc_id", "node"], "left_anti")
    return (
        info.unionByName(present(docs, "catalogue", (*EXTRA_KEYS, *LEAK_KEYS), F.lit("catalog ")))
        .unionByName(present(docs, "names", EXTRA_TREES, F.lit("name tree ")))
        .unionByName(present(pages.join(flattened.distinct(), ["doc_id", "page"], "left_semi"), "keys", FORBIDDEN_PAGE_KEYS, page))
        .unionByName(bare.select("doc_id", F.concat(F.lit("form field without a widget ("), F.col("node").cast("string"), F.lit(")")).alias("violation")))
        .unionByName(present(docs, "form", ("XFA",), F.lit("AcroForm ")))
    )


def verified(docs: DataFrame, leaks: DataFrame, violations: DataFrame) -> DataFrame:
    """``docs`` with the numbers of leaks and violations (doc_id each) and whether there are none."""
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    rows = docs.join(count(leaks, "leaks"), "doc_id", "left").join(count(violations, "violations"), "doc_id", "left").na.fill(0, ["leaks", "violations"])
    return rows.withColumn("verified", (F.col("leaks") == 0) & (F.col("violations") == 0))


def checked_regions(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """The same regions; the job fails at one without area or on a page that isn't there."""
    known = pages.select("doc_id", "page", F.lit(True).alias("_there"))
    rows = regions.join(known, ["doc_id", "page"], "left")
    area = F.assert_true((F.col("width") > 0) & (F.col("height") > 0), "region without area").isNull()
    return rows.where(area).where(F.assert_true(F.coalesce("_there", F.lit(False)), "region on a page that isn't there").isNull()).drop("_there")


def box() -> Column:
    return G.rect(F.col("x"), F.col("y"), F.col("width"), F.col("height"))


def redact(docs: DataFrame, pages: DataFrame, words: DataFrame, fields: DataFrame, annotations: DataFrame, regions: DataFrame, queries: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One row per document with what was done and whether it is verified, and the
    tables of the redacted documents.

    A page with a region becomes a picture: its text is gone, but for words recognised in the
    picture, which are those that no region meets. Then documents are scrubbed. Verification
    looks at the result alone: a word that meets a region, or a page that still holds a query,
    is a leak; `postconditions` are violations. A document is verified if it has neither.
    Without regions there must be a query.
    """
    if not T.needles(queries) and regions.isEmpty():
        raise ValueError("there are neither regions nor queries")
    regions = checked_regions(regions, pages)
    flat = regions.select("doc_id", "page").distinct()
    pages = pages.join(flat.withColumn("_flat", F.lit(True)), ["doc_id", "page"], "left")
    pages = pages.withColumn("keys", F.when(F.col("_flat"), without(F.col("keys"), PAGE_KEYS)).otherwise(F.col("keys"))).drop("_flat")
    marks = regions.select("doc_id", "page", box().alias("region"))
    boxed = lambda rows: rows.withColumn("_box", box())
    met = lambda rows, how: boxed(rows).alias("w").join(marks.alias("r"), (F.col("w.doc_id") == F.col("r.doc_id")) & (F.col("w.page") == F.col("r.page")) & G.overlaps(F.col("w._box"), F.col("r.region")), how)
    words = met(words, "left_anti").select(*words.columns)
    docs, pages, fields = scrub_leaks(docs, pages, fields, annotations, queries)

    meets = marks.alias("r").join(boxed(words).alias("w"), (F.col("w.doc_id") == F.col("r.doc_id")) & (F.col("w.page") == F.col("r.page")) & G.overlaps(F.col("w._box"), F.col("r.region")), "left_semi")
    texts = words.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda w: w["text"]), " ").alias("text"))
    hits = texts.where(T.contains_any(F.col("text"), T.needles(queries)))
    leaks = meets.select("doc_id").unionByName(hits.select("doc_id"))
    done = regions.groupBy("doc_id").agg(F.count("*").alias("regions"), F.count_distinct("page").alias("pages_flattened"))
    rows = docs.select("doc_id").join(done, "doc_id", "left").na.fill(0)
    result = verified(rows, leaks, postconditions(docs, pages, fields, annotations, flat, queries))
    return result, {"docs": docs, "pages": pages, "words": words, "fields": fields}
