"""Search queries. Pages of text are turns of conversations; words of a page are its tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from .registry import Book, table

book = Book()

_PAGES = "(SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations)"
#: Pages whose text counts as recognised, of which some are forced.
_CACHE = "(SELECT conv_id AS doc_id, turn + 1 AS page, 'seen ' || text AS words_text FROM conversations WHERE turn % 3 <> 1)"
_WORDS = r"(SELECT doc_id, page, ord, word AS text, (ord - 1) // 8 AS line FROM (SELECT conv_id AS doc_id, turn + 1 AS page, unnest(w) AS word, generate_subscripts(w, 1) AS ord FROM (SELECT *, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS w FROM conversations)))"


def pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")


def blanked(spark, sf_dir) -> DataFrame:
    """Pages of which every fourth has only white space."""
    return pages(spark, sf_dir).withColumn("text", F.when(F.col("page") % 4 == 0, " \n\t").otherwise(F.col("text")))


_BLANKED = "(SELECT conv_id AS doc_id, turn + 1 AS page, CASE WHEN (turn + 1) % 4 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END AS text FROM conversations)"


def cache(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("turn % 3 <> 1").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.concat(F.lit("seen "), "text").alias("words_text"))


def words(spark, sf_dir) -> DataFrame:
    """doc_id, page, ord, text and line (eight words each) of every word."""
    found = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    rows = pages(spark, sf_dir).select("doc_id", "page", F.posexplode(found).alias("at", "text"))
    return rows.select("doc_id", "page", (F.col("at") + 1).cast("long").alias("ord"), "text", F.floor(F.col("at") / 8).cast("long").alias("line"))


@book.query(f"SELECT doc_id, page, CAST((length(text) - length(replace(lower(text), 'than', ''))) // 4 AS BIGINT) AS n_matches FROM {_PAGES} WHERE contains(lower(text), 'than')")
def b05_search_literal(spark, sf_dir):
    return S.search_pages(pages(spark, sf_dir), "Than")


@book.query(rf"SELECT doc_id, page, CAST(len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+')) AS BIGINT) AS n_matches FROM {_PAGES} WHERE regexp_matches(text, '(?m)^[A-Z][a-z]+')")
def b06_search_regex(spark, sf_dir):
    return S.search_pages(pages(spark, sf_dir), "^[A-Z][a-z]+", use_regex=True)


@book.query(rf"""WITH m AS (SELECT doc_id, page, text, unnest(regexp_extract_all(text, 'th[a-z]+')) AS hit, generate_subscripts(regexp_extract_all(text, 'th[a-z]+'), 1) AS k FROM {_PAGES}),
    g AS (SELECT doc_id, page, k, hit, length(string_split_regex(text, 'th[a-z]+')[k]) AS gap FROM m)
    SELECT doc_id, page, k AS match, CAST(sum(gap) OVER w + sum(length(hit)) OVER w - length(hit) AS BIGINT) AS "start", CAST(sum(gap) OVER w + sum(length(hit)) OVER w AS BIGINT) AS "end"
    FROM g WINDOW w AS (PARTITION BY doc_id, page ORDER BY k)""")
def b07_match_spans(spark, sf_dir):
    return S.match_rows(pages(spark, sf_dir), T.line_regex("th[a-z]+"))


#: Every character of a page in a box of its own, forty a line.
_COLUMNS = 40


def characters(spark, sf_dir) -> DataFrame:
    rows = pages(spark, sf_dir).where("text <> ''").select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("idx"))
    column, line = F.col("idx") % _COLUMNS, F.floor(F.col("idx") / _COLUMNS)
    return rows.select("doc_id", "page", "idx", (column * 6.0).alias("x"), (line * 12.0).alias("y"), F.lit(6.0).alias("width"), F.lit(10.0).alias("height"))


_HITS = rf"""m AS (SELECT doc_id, page, unnest(regexp_extract_all(text, '{{p}}')) AS hit, generate_subscripts(regexp_extract_all(text, '{{p}}'), 1) AS k, string_split_regex(text, '{{p}}') AS gaps FROM {_PAGES}),
    s AS (SELECT doc_id, page, k AS match, CAST(sum(length(gaps[k]) + length(hit)) OVER (PARTITION BY doc_id, page ORDER BY k) AS BIGINT) AS e, length(hit) AS n FROM m),
    l AS (SELECT doc_id, page, match, e - n AS s, e, unnest(range((e - n) // {_COLUMNS}, (e - 1) // {_COLUMNS} + 1)) AS line FROM s),
    b AS (SELECT doc_id, page, match, line, greatest(s, line * {_COLUMNS}) AS f, least(e, (line + 1) * {_COLUMNS}) AS t FROM l)"""


@book.query(rf"""WITH {_HITS.format(p="[a-z]+ th[a-z]+")} SELECT doc_id, page, match, CAST(row_number() OVER (PARTITION BY doc_id, page, match ORDER BY line) AS INTEGER) AS part, CAST(f % {_COLUMNS} * 6 AS DOUBLE) AS x, CAST(line * 12 AS DOUBLE) AS y, CAST((t - f) * 6 AS DOUBLE) AS width, 10.0::DOUBLE AS height FROM b""")
def b05_hit_rectangles(spark, sf_dir):
    """Boxes of matches of two words, of which some go over the end of a line."""
    return S.search_hits(pages(spark, sf_dir), characters(spark, sf_dir), "[a-z]+ th[a-z]+", use_regex=True)


@book.query(rf"""WITH {_HITS.format(p="(?i)and the")} SELECT DISTINCT doc_id, page, CAST(f % {_COLUMNS} * 6 - 1 AS DOUBLE) AS x, CAST(line * 12 - 1 AS DOUBLE) AS y, CAST((t - f) * 6 + 2 AS DOUBLE) AS width, 12.0::DOUBLE AS height FROM b""")
def b11_redaction_regions(spark, sf_dir):
    """What a redaction of a phrase covers: its hits, a point wider on every side."""
    return S.redaction_regions(pages(spark, sf_dir), characters(spark, sf_dir), [" and THE", ""], 1.0)


@book.query(rf"SELECT doc_id, page, CAST(len(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w = 'the')) AS BIGINT) AS n_matches FROM {_PAGES} WHERE len(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w = 'the')) > 0")
def b08_search_whole_word(spark, sf_dir):
    return S.search_pages(pages(spark, sf_dir), "the", whole_word=True)


_EDGES = r"list_filter(range(1, length(t) + 1), lambda i: substr(t, i, {n}) = '{q}' AND NOT regexp_matches(substr(' ' || t, i, 1), '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(substr(t || ' ', i + {n}, 1), '[\p{{L}}\p{{N}}]'))"


@book.query(f"SELECT * FROM (SELECT doc_id, page, CAST(len({_EDGES.format(n=6, q='of the')}) AS BIGINT) + CAST(len({_EDGES.format(n=4, q='the ')}) AS BIGINT) AS n_matches FROM (SELECT doc_id, page, lower(text) AS t FROM {_PAGES})) WHERE n_matches > 0")
def b08_search_whole_phrase(spark, sf_dir):
    """Queries of several words and with punctuation; what they begin or end in the middle of doesn't count."""
    found = [S.search_pages(pages(spark, sf_dir), q, whole_word=True) for q in ("of the", "The ")]
    return found[0].unionByName(found[1]).groupBy("doc_id", "page").agg(F.sum("n_matches").alias("n_matches"))


@book.query(rf"""WITH s AS (SELECT doc_id, page, ord, text, sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY line, ord) - length(text) - 1 AS a FROM {_WORDS}),
    j AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY ord) AS t FROM {_WORDS} GROUP BY doc_id, page),
    m AS (SELECT doc_id, page, i, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS match FROM (SELECT doc_id, page, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 3) = 'e t')) AS i FROM j))
    SELECT doc_id, page, match, ord, text FROM s JOIN m USING (doc_id, page) WHERE a < i + 2 AND a + length(text) > i - 1""")
def b09_words_of_match(spark, sf_dir):
    """The words that each match of a pattern in the page's recognised text meets: the last
    letter of a word, the blank and the first letter of the next."""
    spans = S.words_to_text(words(spark, sf_dir))
    return S.words_of_pattern(spans, "e[ \n]t").select("doc_id", "page", "match", "ord", "text")


@book.query(f"SELECT doc_id, page, ord, text FROM {_WORDS} WHERE contains(lower(text), 'ou')")
def b10_token_contains(spark, sf_dir):
    return S.token_matches(words(spark, sf_dir), "OU").select("doc_id", "page", "ord", "text")


@book.query(f"SELECT doc_id, page, ord, text FROM {_WORDS} WHERE lower(text) = 'the'")
def b10_token_equals(spark, sf_dir):
    return S.token_matches(words(spark, sf_dir), "The", whole_word=True).select("doc_id", "page", "ord", "text")


@book.query(f"SELECT doc_id, page, ord AS match, CAST(ord * 7 % 500 AS DOUBLE) AS x, CAST(length(text) * 6 AS DOUBLE) AS width FROM {_WORDS} WHERE lower(text) = 'and'")
def b11_region_rows(spark, sf_dir):
    rect = F.struct((F.col("ord") * 7 % 500).cast("double").alias("x"), (F.length("text") * 6).cast("double").alias("width"))
    hit = words(spark, sf_dir).where(F.lower("text") == "and").withColumn("match", F.col("ord"))
    nested = hit.groupBy("doc_id", "page").agg(F.collect_list(F.struct("match", F.array(rect).alias("rects"))).alias("matches"))
    flat = nested.select("doc_id", "page", F.explode("matches").alias("m")).select("doc_id", "page", "m.match", F.explode("m.rects").alias("rect"))
    return flat.select("doc_id", "page", "match", "rect.x", "rect.width")


@book.query(f"SELECT count(*) AS n_pages FROM {_BLANKED} p WHERE regexp_matches(text, '^\\s*$') AND NOT EXISTS (SELECT 1 FROM {_CACHE} c WHERE c.doc_id = p.doc_id AND c.page = p.page)")
def b12_pages_without_text(spark, sf_dir):
    return S.pages_without_text(blanked(spark, sf_dir), cache(spark, sf_dir))


@book.query(rf"""WITH native AS (SELECT doc_id, page, 'native' AS origin FROM {_BLANKED} WHERE contains(lower(text), 'tion')),
    found AS (SELECT doc_id, page, 'recognised' AS origin FROM {_CACHE} WHERE contains(lower(words_text), 'tion'))
    SELECT * FROM native UNION ALL SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM native n WHERE n.doc_id = f.doc_id AND n.page = f.page)""")
def b09_search_with_fallback(spark, sf_dir):
    native = S.search_pages(blanked(spark, sf_dir), "tion").select("doc_id", "page", F.lit("native").alias("origin"))
    found = S.search_pages(cache(spark, sf_dir).withColumnRenamed("words_text", "text"), "tion").select("doc_id", "page", F.lit("recognised").alias("origin"))
    return S.with_fallback(native, found)


@book.query(rf"""SELECT p.doc_id, p.page, CASE WHEN p.page % 5 = 0 AND c.words_text IS NOT NULL THEN 'recognised' WHEN NOT regexp_matches(p.text, '^\s*$') THEN 'native' WHEN c.words_text IS NOT NULL THEN 'recognised' ELSE 'none' END AS origin,
    CASE WHEN p.page % 5 = 0 AND c.words_text IS NOT NULL THEN c.words_text WHEN NOT regexp_matches(p.text, '^\s*$') THEN p.text ELSE coalesce(c.words_text, '') END AS shown
    FROM {_BLANKED} p LEFT JOIN {_CACHE} c USING (doc_id, page)""")
def c11_page_text(spark, sf_dir):
    forced = pages(spark, sf_dir).where("page % 5 = 0")
    return S.page_text(blanked(spark, sf_dir), cache(spark, sf_dir), forced)


@book.query(f"SELECT doc_id, page, words_text IS NOT NULL AS cached FROM {_PAGES} LEFT JOIN {_CACHE} USING (doc_id, page)")
def c09_cache_lookup(spark, sf_dir):
    return pages(spark, sf_dir).join(cache(spark, sf_dir), ["doc_id", "page"], "left").select("doc_id", "page", F.col("words_text").isNotNull().alias("cached"))


@book.query(f"SELECT doc_id, page FROM {_PAGES} p WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id AND l.quality = 1)")
def c10_override_members(spark, sf_dir):
    forced = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return pages(spark, sf_dir).join(forced, "doc_id", "left_semi").select("doc_id", "page")


@book.query(f"SELECT doc_id, page, ord, \"start\", \"end\" FROM (SELECT doc_id, page, ord, CAST(sum(length(text) + 1) OVER w - length(text) - 1 AS BIGINT) AS \"start\", CAST(sum(length(text) + 1) OVER w - 1 AS BIGINT) AS \"end\" FROM {_WORDS} WINDOW w AS (PARTITION BY doc_id, page ORDER BY line, ord))")
def e11_word_spans(spark, sf_dir):
    return S.words_to_text(words(spark, sf_dir)).select("doc_id", "page", "ord", "start", "end")


@book.query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0),
    d AS (SELECT doc_id, i, ch, CAST(sum(octet_length(encode(ch))) OVER (PARTITION BY doc_id ORDER BY i) - octet_length(encode(ch)) AS BIGINT) AS byte_start FROM c)
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS char_index, byte_start FROM d WHERE ch <> 'e'""")
def e09_char_offsets(spark, sf_dir):
    """Undecodable characters (here: the letter e) are left out of the text but keep their index.
    Read from the bytes that begin a character."""
    byte = lambda raw, b: F.substring(raw, b + 1, F.lit(1))
    begins = lambda raw: F.filter(F.sequence(F.lit(0), F.octet_length(raw) - 1), lambda b: ~byte(raw, b).between(F.unhex(F.lit("80")), F.unhex(F.lit("BF"))))
    # As a variable of a lambda the bytes are made once a text, not once a byte.
    kept = lambda raw: F.filter(F.transform(begins(raw), lambda b, i: F.struct(i.cast("long").alias("char_index"), b.cast("long").alias("byte_start"), byte(raw, b).alias("byte"))), lambda c: c["byte"] != F.encode(F.lit("e"), "UTF-8"))
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    chars = docs.select("doc_id", F.explode(F.transform(F.array(F.encode("text", "UTF-8")), kept)).alias("c")).select("doc_id", F.explode("c").alias("c"))
    return chars.select("doc_id", "c.char_index", "c.byte_start")


@book.query(f"""WITH s AS (SELECT doc_id, page, ord - 1 AS idx, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY doc_id, page ORDER BY ord) - octet_length(encode(text)) - 1 AS b FROM {_WORDS})
    SELECT doc_id, page, CAST(min(idx) AS BIGINT) AS "start", CAST(max(idx) - min(idx) + 1 AS BIGINT) AS n FROM s WHERE b >= 30 AND b < 90 GROUP BY doc_id, page""")
def c27_byte_range_to_index(spark, sf_dir):
    """Which items begin within bytes 30 to 90 of their page."""
    before = Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    at = words(spark, sf_dir).withColumn("b", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)))
    inside = at.where("b >= 30 AND b < 90").groupBy("doc_id", "page").agg(F.min("ord").alias("a"), F.max("ord").alias("z"))
    return inside.select("doc_id", "page", (F.col("a") - 1).cast("long").alias("start"), (F.col("z") - F.col("a") + 1).cast("long").alias("n"))


_HITS = f"(SELECT doc_id, page, CAST(length(text) - length(replace(lower(text), 'e', '')) AS BIGINT) AS n FROM {_PAGES} WHERE contains(lower(text), 'e'))"


def hits(spark, sf_dir) -> DataFrame:
    return S.search_pages(pages(spark, sf_dir), "e").withColumnRenamed("n_matches", "n")


@book.query(f"SELECT doc_id, page, n FROM {_HITS} ORDER BY doc_id, page LIMIT 20 OFFSET 40")
def f05_results_page(spark, sf_dir):
    return S.results_page(hits(spark, sf_dir), 2)


@book.query(f"SELECT doc_id, CAST(sum(n) AS BIGINT) AS total FROM {_HITS} GROUP BY doc_id")
def d17_total_matches(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("doc_id").agg(F.sum("n").alias("total"))


@book.query(f"SELECT doc_id, page, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY page) - n AS BIGINT) AS first_index FROM {_HITS}")
def e12_first_match_index(spark, sf_dir):
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return hits(spark, sf_dir).select("doc_id", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first_index"))


def _located(df: DataFrame, index) -> DataFrame:
    """Page that holds a global match index of each document."""
    upto = Window.partitionBy("doc_id").orderBy("page")
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    rows = df.withColumn("upto", F.sum("n").over(upto)).withColumn("at", index(total))
    return rows.where("at >= upto - n AND at < upto").select("doc_id", F.col("at").cast("long").alias("match"), "page")


def _located_sql(index: str) -> str:
    return f"""WITH r AS (SELECT doc_id, page, n, sum(n) OVER (PARTITION BY doc_id ORDER BY page) AS upto, sum(n) OVER (PARTITION BY doc_id) AS total FROM {_HITS}), a AS (SELECT *, CAST({index} AS BIGINT) AS place FROM r)
    SELECT doc_id, place AS match, page FROM a WHERE place >= upto - n AND place < upto"""


@book.query(_located_sql("(doc_id * 37 + 1) % total"))
def e13_next_match(spark, sf_dir):
    return _located(hits(spark, sf_dir), lambda total: F.pmod(F.col("doc_id") * 37 + 1, total))


@book.query(_located_sql("(doc_id % total - 1 + total) % total"))
def e14_previous_match(spark, sf_dir):
    return _located(hits(spark, sf_dir), lambda total: F.pmod(F.pmod(F.col("doc_id"), total) - 1, total))


@book.query(f"SELECT doc_id, page, ord FROM (SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS k FROM {_WORDS} WHERE contains(lower(text), 'e')) WHERE k = 6")
def e15_active_match(spark, sf_dir):
    """The sixth match (index 5) of each document."""
    order = Window.partitionBy("doc_id").orderBy("page", "ord")
    return S.token_matches(words(spark, sf_dir), "e").withColumn("k", F.row_number().over(order)).where("k = 6").select("doc_id", "page", "ord")


@book.query("SELECT d.doc_id, b.item_id FROM documents d, (SELECT item_id, text FROM benchmark UNION ALL SELECT -1, 'thin' UNION ALL SELECT -2, 'e th') b WHERE contains(lower(d.text), lower(b.text))")
def c08_surviving_queries(spark, sf_dir):
    """Every query, a whole benchmark text or a short one, that a document still holds."""
    short = spark.createDataFrame([(-1, "thin"), (-2, "e th")], "item_id long, query string")
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query")).unionByName(short)
    return S.holding(table(spark, sf_dir, "documents").select("doc_id", "text"), queries).select("doc_id", "item_id")


@book.query(f"SELECT doc_id, list_sort(list(DISTINCT page)) AS pages FROM {_HITS} GROUP BY doc_id")
def d18_hit_pages(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))


@book.query(f"SELECT doc_id, CAST(count(*) FILTER (n > 0) AS BIGINT) AS gained FROM (SELECT p.doc_id, p.page, length(c.words_text) AS n FROM {_BLANKED} p LEFT JOIN {_CACHE} c USING (doc_id, page) WHERE regexp_matches(p.text, '^\\s*$')) GROUP BY doc_id")
def d22_recognised_pages(spark, sf_dir):
    blank = blanked(spark, sf_dir).where(T.is_blank(F.col("text"))).drop("text").join(cache(spark, sf_dir), ["doc_id", "page"], "left")
    return blank.groupBy("doc_id").agg(F.count_if(F.length("words_text") > 0).alias("gained"))


@book.query(rf"""WITH s AS (SELECT doc_id, page, ord, text, sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY line, ord) - length(text) - 1 AS a FROM {_WORDS})
    SELECT doc_id, page, 1 AS match, ord, text FROM s WHERE a < 40 AND a + length(text) > 25""")
def c06_interval_overlap(spark, sf_dir):
    """Words that the characters 25 to 40 of a page meet."""
    spans = S.words_to_text(words(spark, sf_dir))
    found = pages(spark, sf_dir).select("doc_id", "page", F.lit(1).alias("match"), F.lit(25).alias("m_start"), F.lit(40).alias("m_end"))
    return S.words_of_matches(spans, found).select("doc_id", "page", "match", "ord", "text")


@book.query(f"SELECT doc_id, page, CASE WHEN page % 5 = 0 THEN 'unsupported' ELSE 'layered' END AS outcome FROM {_BLANKED} p WHERE regexp_matches(text, '^\\s*$') AND EXISTS (SELECT 1 FROM {_CACHE} c WHERE c.doc_id = p.doc_id AND c.page = p.page) AND page <= 8")
def g22_text_layer_pages(spark, sf_dir):
    """Pages of a subset without native text but with recognised text get a layer, unless their geometry isn't simple."""
    from ..functions.geometry import is_simple

    subset = pages(spark, sf_dir).where("page <= 8").select("doc_id", "page")
    bare = blanked(spark, sf_dir).where(T.is_blank(F.col("text"))).join(subset, ["doc_id", "page"], "left_semi")
    known = bare.join(cache(spark, sf_dir).select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    simple = is_simple(F.lit(0.0), F.lit(0.0), F.when(F.col("page") % 5 == 0, 90).otherwise(0))
    return known.select("doc_id", "page", F.when(simple, "layered").otherwise("unsupported").alias("outcome"))


@book.query(f"SELECT doc_id, page, ord, text, CAST((ord - 1) * 10 AS DOUBLE) AS x FROM {_WORDS}")
def j01_recognised_words(spark, sf_dir):
    """Words of page images by a pluggable engine; here one that reads them from the bytes."""
    from ..sources.recognise import WordsInBytes, recognise

    images = pages(spark, sf_dir).select("doc_id", "page", F.encode("text", "UTF-8").alias("image"))
    return recognise(images, WordsInBytes()).select("doc_id", "page", "ord", "text", "x")


@book.query(f"SELECT doc_id, page, ord, text, CAST((ord - 1) * 10 AS DOUBLE) AS x, false AS failed FROM {_WORDS} WHERE page % 4 <> 0 UNION ALL SELECT doc_id, page, 0, '', -1, true FROM (SELECT conv_id AS doc_id, turn + 1 AS page FROM conversations) WHERE page % 4 = 0")
def j01_recognition_in_sql(spark, sf_dir):
    """The same as a table function of SQL; every fourth page's image is none."""
    from ..sources.recognise import WordsInBytes, register

    register(spark, WordsInBytes())
    image = F.when(F.col("page") % 4 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.encode("text", "UTF-8"))
    images = pages(spark, sf_dir).select("doc_id", "page", image.alias("image"))
    rows = spark.sql("SELECT * FROM recognise(TABLE({images}) PARTITION BY (doc_id, page))", images=images)
    said = (F.coalesce(c, F.lit(none)).alias(c) for c, none in (("ord", 0), ("text", ""), ("x", -1.0)))
    return rows.select("doc_id", "page", *said, F.col("error").isNotNull().alias("failed"))
