"""Sets of pages as tables (doc_id, page, ...): every edit gives a new, renumbered table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def renumber(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))


def delete_pages(pages: DataFrame, drop: DataFrame) -> DataFrame:
    """Without the listed pages (repeats count once). Unknown pages and deleting all raise."""
    listed = drop.select("doc_id", "page", F.lit(True).alias("listed")).distinct()
    marked = pages.join(listed, ["doc_id", "page"], "full_outer").withColumn("here", F.count("*").over(Window.partitionBy("doc_id")))
    kept = F.sum(F.when(F.col("listed").isNull(), 1).otherwise(0)).over(Window.partitionBy("doc_id"))
    return renumber(marked.withColumn("kept", kept).where(F.assert_true(F.col("kept") > 0, "every page would go").isNull()).where("listed IS NULL").drop("listed", "here", "kept"))


def rotate_pages(pages: DataFrame, turn: DataFrame, quarter_turns: int) -> DataFrame:
    """Listed pages turned clockwise, as often as they are listed; an odd number of
    quarter turns swaps width and height. Columns: rotation, width, height."""
    times = turn.groupBy("doc_id", "page").agg(F.count("*").alias("times"))
    rows = pages.join(times, ["doc_id", "page"], "left")
    turns = F.pmod(F.coalesce("times", F.lit(0)) * quarter_turns, F.lit(4))
    odd = turns % 2 == 1
    return rows.select(
        "doc_id",
        "page",
        F.pmod(F.col("rotation") + turns * 90, F.lit(360)).cast("int").alias("rotation"),
        F.when(odd, F.col("height")).otherwise(F.col("width")).alias("width"),
        F.when(odd, F.col("width")).otherwise(F.col("height")).alias("height"),
    )


def reorder_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """``order`` (doc_id, new_page, page) must list every page of a document once."""
    n = Window.partitionBy("doc_id")
    joined = pages.join(order, ["doc_id", "page"], "full_outer")
    whole = (F.count("*").over(n) == F.count("new_page").over(n)) & (F.size(F.collect_set("new_page").over(n)) == F.count("*").over(n)) & (F.min("new_page").over(n) == 1)
    return joined.withColumn("whole", whole).where(F.assert_true("whole", "not a permutation of the pages").isNull()).withColumn("page", F.col("new_page")).drop("new_page", "whole")


def gated(rows: DataFrame, verified: Column, *contents: str) -> DataFrame:
    """``rows`` with ``verified`` (never null), their contents only where it is true."""
    ok = F.coalesce(verified, F.lit(False))
    return rows.withColumns({"verified": ok, **{c: F.when(ok, F.col(c)) for c in contents}})


def assert_gated(rows: DataFrame, message: str) -> DataFrame:
    """The same rows; the job fails at the first that isn't ``verified``."""
    return rows.where(F.assert_true("verified", message).isNull())


#: Pages of a document that is put into others, at most.
MOST_MERGED = 100_000


def merge_pages(pages: DataFrame, source: DataFrame, after: int) -> DataFrame:
    """All pages of ``source`` (page, ...) after page ``after`` of every document. Each
    document gets every page of the source, which is one document: it is counted before it is
    broadcast, and more than MOST_MERGED pages raise."""
    n = source.count()
    if n > MOST_MERGED:
        raise ValueError(f"the source has more than {MOST_MERGED} pages")
    moved = pages.withColumn("page", F.when(F.col("page") > after, F.col("page") + n).otherwise(F.col("page")))
    rest = [c for c in pages.columns if c not in ("doc_id", "page")]
    added = pages.select("doc_id").distinct().crossJoin(F.broadcast(source)).select("doc_id", (F.col("page") + after).cast("int").alias("page"), *rest)
    return moved.unionByName(added)


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages first..last of every document, numbered from 1."""
    if not 1 <= first <= last:
        raise ValueError("the range must hold 1 <= first <= last")
    return pages.where(F.col("page").between(first, last)).withColumn("page", F.col("page") - (first - 1))


def move_page(page: Column, at: int, to: int) -> Column:
    """The place of each ordinal after one is taken out and put in elsewhere."""
    if at < to:
        shifted = F.when((page > at) & (page <= to), page - 1)
    else:
        shifted = F.when((page >= to) & (page < at), page + 1)
    return F.when(page == at, F.lit(to)).otherwise(F.coalesce(shifted, page))


def export_text(pages: DataFrame) -> DataFrame:
    """doc_id and one text of all its pages in order, each under its heading."""
    from ..functions.text import is_blank

    block = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.when(is_blank(F.col("text")), "[no extractable text]").otherwise(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("page", block.alias("block"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("exported"))


def page_runs(pages: DataFrame) -> DataFrame:
    """The pages of each key (key, page) as runs, such as p1, 3–5."""
    islands = pages.distinct().withColumn("island", F.col("page") - F.row_number().over(Window.partitionBy("key").orderBy("page")))
    runs = islands.groupBy("key", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda r: r["t"]), ", ")
    return runs.groupBy("key").agg(F.concat(F.lit("p"), joined).alias("runs"))


def document_heads(pages: DataFrame) -> DataFrame:
    """page_count and the sizes of all pages, in order, of each document."""
    size = F.struct("page", "width", "height")
    heads = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list(size)).alias("sizes"))
    return heads.select("doc_id", "page_count", F.transform("sizes", lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height"))).alias("page_dimensions"))


def page_sizes(heads: DataFrame) -> DataFrame:
    """doc_id, page, width and height again, from `document_heads`."""
    return heads.select("doc_id", F.posexplode("page_dimensions").alias("at", "s")).select("doc_id", (F.col("at") + 1).alias("page"), "s.width", "s.height")


def canonical_path(path: Column) -> Column:
    """A path without empty and single-dot steps, and with each double-dot step and the one
    before it gone; scheme and host, if any, stay as they are, query and fragment go."""
    head = F.regexp_extract(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|)", 0)
    rest = F.regexp_replace(F.substring(path, F.length(head) + 1, F.length(path)), r"[?#].*$", "")
    steps = F.filter(F.split(rest, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)))
    return F.concat(head, F.lit("/"), F.array_join(kept, "/"))


def stamped(docs: DataFrame, producer: str, at: Column | None = None) -> DataFrame:
    """A10: information entries with producer and date of change set; the date of creation and the
    others stay."""
    when = F.date_format(at if at is not None else F.current_timestamp(), "'D:'yyyyMMddHHmmss'Z'")
    stamp = F.create_map(F.lit("ModDate"), when, F.lit("Producer"), F.lit(producer))
    return docs.withColumn("info", F.map_concat(F.map_filter("info", lambda k, _: ~k.isin("ModDate", "Producer")), stamp))


def open_elsewhere(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, path) with elsewhere: another one has the same path. A count per
    path, not pairs."""
    return docs.join(docs.groupBy("path").agg(F.count("*").alias("_n")), "path").withColumn("elsewhere", F.col("_n") > 1).drop("_n")


def bytes_for_disk(entries: DataFrame) -> DataFrame:
    """What is written of each entry (plain, pending, protection): its bytes as they are, or
    what an earlier step encrypted for a protected one, which fails where that is missing. An
    entry with a redaction still to come is not to be written."""
    ready = F.assert_true(~F.coalesce("pending", F.lit(False)), "a redaction hasn't been carried out").isNull()
    known = F.assert_true(F.col("protection").isin("plaintext", "protected"), "unknown protection").isNull()
    locked = F.assert_true((F.col("protection") == "plaintext") | F.col("encrypted").isNotNull(), "nothing encrypted to write").isNull()
    return entries.where(ready).where(known).where(locked).withColumn("written", F.when(F.col("protection") == "protected", F.col("encrypted")).otherwise(F.col("plain")))


def added_turns(rotation: Column, turns: int) -> Column:
    """Quarter turns after some more."""
    return F.pmod((rotation / 90).cast("int") + turns, F.lit(4))
