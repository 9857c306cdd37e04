"""Search over pages with text recognised from images as a fallback."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..lineage import Rounds
from .folds import merge_runs

RESULTS_PER_PAGE = 20


def search_pages(pages: DataFrame, query: str, match_case: bool = False, whole_word: bool = False, use_regex: bool = False) -> DataFrame:
    """doc_id, page and n_matches of the pages (doc_id, page, text) with hits. In regex
    mode the other two options don't apply; an empty query has no hits; a bad pattern raises."""
    if not query:
        n = F.lit(0)
    elif use_regex:
        n = F.size(T.matches(F.col("text"), query))
    elif whole_word:
        n = T.count_words(F.col("text"), query, match_case)
    else:
        n = T.count_literal(F.col("text"), query, match_case)
    return pages.select("doc_id", "page", n.cast("long").alias("n_matches")).where("n_matches > 0")


def words_to_text(words: DataFrame) -> DataFrame:
    """Recognised words (doc_id, page, line, ord, text) with their spans in the page's
    text, in which words are joined by a space and lines by a line feed; either is one character."""
    order = Window.partitionBy("doc_id", "page").orderBy("line", "ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return words.withColumn("start", start.cast("long")).withColumn("end", (start + F.length("text")).cast("long"))


def words_of_matches(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """Each match (doc_id, page, match, m_start, m_end) with the words it overlaps."""
    return matches.join(spans, ["doc_id", "page"]).where((F.col("start") < F.col("m_end")) & (F.col("end") > F.col("m_start")))


def match_rows(pages: DataFrame, pattern: str) -> DataFrame:
    """doc_id, page, match (from 1), start and end (code points, end exclusive) of each match of
    a pattern in the pages' texts. Matches of nothing are no matches. A page's matches are rows,
    and their places running sums of the lengths of matches and of what is between them."""
    found = F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: m != "")
    gaps = F.split("text", pattern, -1)
    # The text behind the last match is left out; split gives one piece more than there are matches.
    pairs = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda g: F.length(g)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("size"))
    rows = pages.select("doc_id", "page", F.posexplode(pairs).alias("k", "p"))
    upto = Window.partitionBy("doc_id", "page").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(upto)
    return rows.select("doc_id", "page", (F.col("k") + 1).cast("long").alias("match"), (end - F.col("p.size")).cast("long").alias("start"), end.cast("long").alias("end"))


def words_of_pattern(spans: DataFrame, pattern: str) -> DataFrame:
    """The words that each match of a pattern meets in the text that `words_to_text` placed
    them in (doc_id, page, line, ord, text, start, end), with the number of the match."""
    order = F.array_sort(F.collect_list(F.struct("start", "line", "text")))
    gap = lambda a, b: F.when(a["line"] == b["line"], " ").otherwise("\n")
    glued = lambda w: F.array_join(F.transform(w, lambda x, i: F.concat(F.when(i > 0, gap(F.get(w, i - 1), x)).otherwise(""), x["text"])), "")
    pages = spans.groupBy("doc_id", "page").agg(order.alias("w")).select("doc_id", "page", glued(F.col("w")).alias("text"))
    found = match_rows(pages, T.line_regex(pattern)).select("doc_id", "page", "match", F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    return words_of_matches(spans, found)


#: Characters of a page that one key of the join with matches covers.
CHARS_PER_KEY = 512


def characters_of_matches(matches: DataFrame, characters: DataFrame) -> DataFrame:
    """Characters (doc_id, page, idx, x, y, width, height) within the matches (doc_id, page, match,
    start, end), with the number of the match. Both are met by stretches of the page's text, so
    a page with very many characters is many keys."""
    key = lambda c: F.floor(c / CHARS_PER_KEY)
    spans = matches.where(F.col("end") > F.col("start")).withColumn("_key", F.explode(F.sequence(key(F.col("start")), key(F.col("end") - 1))))
    placed = characters.withColumn("_key", key(F.col("idx")))
    met = placed.join(spans, ["doc_id", "page", "_key"]).where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end")))
    return met.select("doc_id", "page", "match", "idx", "x", "y", "width", "height")


def hit_rectangles(matches: DataFrame, characters: DataFrame) -> DataFrame:
    """doc_id, page, match, part (from 1), x, y, width and height of the boxes of each match: one
    per line, from the top. Characters that follow each other on a line are one stretch, by windows;
    stretches of a match that share a line are one box (E06), so what is merged in an array is the
    lines of one match. Characters without a box are passed over; a match without any has no row."""
    rows = characters_of_matches(matches, characters.where("x IS NOT NULL AND width IS NOT NULL AND y IS NOT NULL AND height IS NOT NULL"))
    keys = ["doc_id", "page", "match"]
    order = Window.partitionBy(*keys).orderBy("idx")
    box = G.rect(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    rows = rows.withColumn("_box", box)
    before = F.lag("_box").over(order)
    rows = rows.withColumn("_new", (before.isNotNull() & ~G.shares_line(before, F.col("_box"))).cast("long"))
    rows = rows.withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left, top = F.min("x"), F.min("y")
    stretches = rows.groupBy(*keys, "_stretch").agg(left.alias("x"), top.alias("y"), (F.max(F.col("x") + F.col("width")) - left).alias("width"), (F.max(F.col("y") + F.col("height")) - top).alias("height"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_stretch", box.alias("r")))), lambda s: s["r"])
    merged = stretches.groupBy(*keys).agg(ordered.alias("r")).select(*keys, F.posexplode(merge_runs(F.col("r"))).alias("_at", "r"))
    return merged.select(*keys, (F.col("_at") + 1).alias("part"), "r.x", "r.y", "r.width", "r.height")


def search_hits(pages: DataFrame, characters: DataFrame, query: str, match_case: bool = False, whole_word: bool = False, use_regex: bool = False) -> DataFrame:
    """`hit_rectangles` of all matches of a query in pages (doc_id, page, text); an empty
    query has none, a bad pattern raises."""
    pages = pages if query else pages.limit(0)
    return hit_rectangles(match_rows(pages, T.search_pattern(query, match_case, whole_word, use_regex)), characters)


def redaction_regions(pages: DataFrame, characters: DataFrame, queries: list[str], pad: float = 0.0) -> DataFrame:
    """doc_id, page, x, y, width and height of what a redaction of ``queries`` covers, each box
    once, as `scrub.redact` takes it; ``pad`` points are added on every side."""
    hits = [search_hits(pages, characters, q) for q in T.needles(queries)]
    every = functools.reduce(DataFrame.unionByName, hits) if hits else search_hits(pages, characters, "")
    grown = [(F.col(c) - pad).alias(c) for c in ("x", "y")] + [(F.col(c) + 2 * pad).alias(c) for c in ("width", "height")]
    return every.select("doc_id", "page", *grown).distinct()


#: Tokens of a query that are looked up together, and how many queries without so many are
#: tested against every text.
KEY_TOKENS, MOST_SHORT = 4, 1000
#: Bytes of queries that are sent to every task, each with so many for its keys.
MOST_BROADCAST, QUERY_BYTES = 32 << 20, 64


def holding(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """Each text (columns of ``texts``, with ``text``) with the item_id of each query
    (item_id, query) it holds, case aside.

    A text that holds a query holds its inner tokens in a row: the first few are looked up by
    hash, and what shares them is compared in full. Queries of up to MOST_BROADCAST bytes go to
    every task, so that no place of a text is shuffled. Shorter queries are tested against every
    text; they are counted first, and more than MOST_SHORT raise.
    """
    tokens = lambda s: F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    key = lambda a, i: F.xxhash64(F.slice(a, i, F.lit(KEY_TOKENS)))
    asked = queries.where(F.col("query") != "").withColumn("tokens", tokens(F.col("query")))
    # The first and last token may be the end and beginning of longer ones in a text.
    long = asked.where(F.size("tokens") >= KEY_TOKENS + 2).select("item_id", "query", key(F.col("tokens"), F.lit(2)).alias("key"))
    keyed = lambda rows: (
        rows.withColumn("tokens", tokens(F.col("text"))).where(F.size("tokens") >= KEY_TOKENS)
        .withColumn("key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("tokens") - KEY_TOKENS + 1), lambda i: key(F.col("tokens"), i)))))
    )
    if (long.agg(F.sum(F.octet_length("query") + QUERY_BYTES).alias("n")).first()["n"] or 0) <= MOST_BROADCAST:
        places = keyed(texts).join(F.broadcast(long), "key")
    else:
        # Places are met by number and key alone, and whole texts come to those that share a key.
        row = "_row"
        numbered, _ = Rounds(texts.sparkSession).keep(texts.withColumn(row, F.monotonically_increasing_id()))
        met = keyed(numbered.select(row, "text")).select(row, "key").join(long.select("key", "item_id"), "key").select(row, "item_id")
        places = met.join(numbered, row).join(long, "item_id")
    found = places.where(F.contains(F.lower("text"), F.lower("query"))).select(*texts.columns, "item_id")
    short = [(r["item_id"], r["query"]) for r in asked.where(F.size("tokens") < KEY_TOKENS + 2).select("item_id", "query").limit(MOST_SHORT + 1).collect()]
    if len(short) > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} queries of fewer than {KEY_TOKENS + 2} words")
    if not short:
        return found
    low = [(i, q.lower()) for i, q in short]
    hit = F.filter(F.array(*[F.when(F.contains(F.lower("text"), F.lit(q)), F.lit(i)) for i, q in low]), lambda x: x.isNotNull())
    return found.unionByName(texts.withColumn("item_id", F.explode(hit)))


def token_matches(words: DataFrame, query: str, whole_word: bool = False) -> DataFrame:
    """Recognised words that are, or contain, the query; case doesn't count."""
    low = F.lower("text")
    return words.where(low == query.lower() if whole_word else F.contains(low, F.lit(query.lower())))


def with_fallback(native: DataFrame, recognised: DataFrame) -> DataFrame:
    """Hits of the native text, and those of the recognised text on pages without native hits."""
    return native.unionByName(recognised.join(native.select("doc_id", "page"), ["doc_id", "page"], "left_anti"))


def page_text(pages: DataFrame, cache: DataFrame, override: DataFrame) -> DataFrame:
    """The text shown of each page: recognised text where it is forced and there, else
    native text, else recognised text, else nothing. ``cache`` has doc_id, page, words_text."""
    rows = pages.join(cache, ["doc_id", "page"], "left").join(override.select("doc_id", "page", F.lit(True).alias("forced")), ["doc_id", "page"], "left")
    native = ~T.is_blank(F.col("text"))
    return rows.select(
        "doc_id",
        "page",
        F.when(F.col("forced") & F.col("words_text").isNotNull(), "recognised").when(native, "native").when(F.col("words_text").isNotNull(), "recognised").otherwise("none").alias("origin"),
        F.when(F.col("forced") & F.col("words_text").isNotNull(), F.col("words_text")).when(native, F.col("text")).otherwise(F.coalesce("words_text", F.lit(""))).alias("shown"),
    )


def pages_without_text(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Number of blank pages that have no row in the cache (an empty one covers them)."""
    return pages.where(T.is_blank(F.col("text"))).join(cache.select("doc_id", "page"), ["doc_id", "page"], "left_anti").agg(F.count("*").alias("n_pages"))


def results_page(results: DataFrame, number: int, size: int = RESULTS_PER_PAGE) -> DataFrame:
    """page ``number`` (from 0) of results in order of document and page."""
    return results.orderBy("doc_id", "page").offset(number * size).limit(size)
