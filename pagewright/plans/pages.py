"""Page-set edits. Documents are conversations, pages their turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..sources import pdf
from .registry import Book, table

book = Book()

_PAGES = "(SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, CAST((turn * 90) % 360 AS INTEGER) AS rotation, CAST(600 + turn AS DOUBLE) AS width, CAST(800 + conv_id AS DOUBLE) AS height, text FROM conversations)"


def pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page"),
        F.pmod(F.col("turn") * 90, F.lit(360)).cast("int").alias("rotation"),
        (F.col("turn") + 600).cast("double").alias("width"),
        (F.col("conv_id") + 800).cast("double").alias("height"),
        "text",
    )


@book.query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS page, width FROM {_PAGES} WHERE page NOT IN (2, 4)")
def g01_delete_pages(spark, sf_dir):
    df = pages(spark, sf_dir)
    return P.delete_pages(df, df.where("page IN (2, 4)").select("doc_id", "page")).select("doc_id", "page", "width")


@book.query(f"SELECT doc_id, page, CAST((rotation + CASE page WHEN 1 THEN 90 WHEN 2 THEN 180 ELSE 0 END) % 360 AS INTEGER) AS rotation, CASE WHEN page = 1 THEN height ELSE width END AS width, CASE WHEN page = 1 THEN width ELSE height END AS height FROM {_PAGES}")
def g02_rotate_pages(spark, sf_dir):
    """Page 1 is listed once, page 2 twice."""
    df = pages(spark, sf_dir)
    listed = df.where("page = 1").unionByName(df.where("page = 2")).unionByName(df.where("page = 2")).select("doc_id", "page")
    return P.rotate_pages(df, listed, 1)


@book.query(f"SELECT doc_id, CAST(count(*) OVER (PARTITION BY doc_id) + 1 - page AS INTEGER) AS page, width FROM {_PAGES}")
def g03_reorder_pages(spark, sf_dir):
    df = pages(spark, sf_dir)
    order = df.select("doc_id", "page", (F.count("*").over(Window.partitionBy("doc_id")) + 1 - F.col("page")).cast("int").alias("new_page"))
    return P.reorder_pages(df, order).select("doc_id", "page", "width")


@book.query(f"SELECT doc_id, CAST(CASE WHEN page > 1 THEN page + 5 ELSE page END AS INTEGER) AS page, width FROM {_PAGES} UNION ALL SELECT d.doc_id, CAST(r_regionkey + 2 AS INTEGER), CAST(r_regionkey AS DOUBLE) FROM (SELECT DISTINCT doc_id FROM {_PAGES}) d, region")
def g04_merge_document(spark, sf_dir):
    source = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("int").alias("page"), F.col("r_regionkey").cast("double").alias("width"))
    return P.merge_pages(pages(spark, sf_dir).select("doc_id", "page", "width"), source, 1)


@book.query(f"SELECT doc_id, page, width, height FROM {_PAGES}")
def g05_page_sizes(spark, sf_dir):
    """From the documents' heads, page by page."""
    return P.page_sizes(P.document_heads(pages(spark, sf_dir))).select("doc_id", "page", "width", "height")


@book.query(f"SELECT doc_id, page, CAST((rotation // 90 + 3) % 4 AS INTEGER) AS turns FROM {_PAGES}")
def g06_add_turns(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", "page", P.added_turns(F.col("rotation"), 3).alias("turns"))


@book.query(f"SELECT doc_id, CAST(page - 1 AS INTEGER) AS page, text FROM {_PAGES} WHERE page BETWEEN 2 AND 3")
def a11_split_document(spark, sf_dir):
    return P.page_range(pages(spark, sf_dir), 2, 3).select("doc_id", "page", "text")


@book.query(f"SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || CASE WHEN page % 3 = 0 THEN '[no extractable text]' ELSE text END, chr(10) || chr(10) ORDER BY page) AS exported FROM {_PAGES} GROUP BY doc_id")
def a05_export_text(spark, sf_dir):
    df = pages(spark, sf_dir).withColumn("text", F.when(F.col("page") % 3 == 0, " ").otherwise(F.col("text")))
    return P.export_text(df)


@book.query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS page_count, list([width, height] ORDER BY page) AS sizes FROM {_PAGES} GROUP BY doc_id")
def a02_document_head(spark, sf_dir):
    heads = P.document_heads(pages(spark, sf_dir))
    return heads.select("doc_id", "page_count", F.transform("page_dimensions", lambda s: F.array(s["width"], s["height"])).alias("sizes"))


@book.query(r"SELECT page_id AS k, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/b' || regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) || '/c' AS path FROM pages WHERE NOT regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '(^|/)[.]{0,2}(/|$)') OR regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) = ''".replace("|| '/b' ||", "|| '/b/' ||"))
def a03_canonical_path(spark, sf_dir):
    """Steps put into each address that cancel out: a/../b before it, ./c//d/.. behind it."""
    at = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    rest = F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1)
    plain = ~F.rlike(rest, F.lit(r"(^|/)[.]{0,2}(/|$)")) | (rest == "")
    path = F.concat(at, F.lit("/a/.././b/"), rest, F.lit("/./c//d/..?x=/y"))
    return table(spark, sf_dir, "pages").where(plain).select(F.col("page_id").alias("k"), P.canonical_path(path).alias("path"))


@book.query("SELECT doc_id, regexp_matches(substr(hex(encode(CASE WHEN doc_id % 3 = 0 THEN text || '/Linearized' ELSE substr(text, 1, 1000) || '/Linearized 1' || text END)), 1, 4096), '^(..)*2F4C696E656172697A6564') AS marked FROM documents")
def a13_marker_in_head(spark, sf_dir):
    """Each third document has the marker at its end, the others after 1000 characters."""
    late = F.col("doc_id") % 3 == 0
    content = F.when(late, F.concat("text", F.lit("/Linearized"))).otherwise(F.concat(F.substring("text", 1, 1000), F.lit("/Linearized 1"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.is_linearized(F.encode(content, "UTF-8")).alias("marked"))


@book.query("SELECT l.doc_id, l.quality = 1 AND l.toxic = 0 AS verified, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN d.n_chars END AS written FROM labels l JOIN documents d USING (doc_id)")
def a14_gated_rows(spark, sf_dir):
    """What may be written of each document: its size where it is verified, else nothing."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return P.gated(rows, (F.col("quality") == 1) & (F.col("toxic") == 0), "n_chars").select("doc_id", "verified", F.col("n_chars").alias("written"))


@book.query("SELECT doc_id, 'D:20240229120000Z' AS modified, 'pagewright' AS producer, 'D:' || doc_id AS created, CAST(CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END AS INTEGER) AS n FROM documents")
def a10_stamp(spark, sf_dir):
    """Every second document has an older producer, all a date of creation and a title."""
    own = F.create_map(F.lit("CreationDate"), F.concat(F.lit("D:"), F.col("doc_id").cast("string")), F.lit("ModDate"), F.lit("D:1999"))
    more = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("Title"), F.lit("t"), F.lit("Producer"), F.lit("other"))).otherwise(F.create_map().cast("map<string,string>"))
    docs = P.stamped(table(spark, sf_dir, "documents").select("doc_id", F.map_concat(own, more).alias("info")), "pagewright", F.lit("2024-02-29 12:00:00").cast("timestamp"))
    entry = lambda k, name: F.element_at("info", k).alias(name)
    return docs.select("doc_id", entry("ModDate", "modified"), entry("Producer", "producer"), entry("CreationDate", "created"), F.size("info").alias("n"))


@book.query("SELECT doc_id, octet_length(encode(CASE WHEN toxic = 1 THEN 'locked ' || doc_id ELSE 'plain ' || doc_id END)) AS n, toxic = 1 AS locked FROM labels")
def a09_bytes_for_disk(spark, sf_dir):
    """Toxic documents stand for protected ones; their encrypted bytes are given."""
    text = lambda word: F.encode(F.concat(F.lit(word), F.col("doc_id").cast("string")), "UTF-8")
    locked = F.col("toxic") == 1
    entries = table(spark, sf_dir, "labels").select("doc_id", text("plain ").alias("plain"), F.when(locked, text("locked ")).alias("encrypted"), F.when(locked, "protected").otherwise("plaintext").alias("protection"), F.lit(False).alias("pending"))
    return P.bytes_for_disk(entries).select("doc_id", F.octet_length("written").cast("long").alias("n"), F.startswith(F.decode("written", "UTF-8"), F.lit("locked")).alias("locked"))


def _islands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("page")).where("page <> 3")


@book.query("""WITH p AS (SELECT DISTINCT l_orderkey AS key, l_linenumber AS page FROM lineitem WHERE l_linenumber <> 3), i AS (SELECT *, page - row_number() OVER (PARTITION BY key ORDER BY page) AS g FROM p),
    r AS (SELECT key, min(page) AS a, max(page) AS b FROM i GROUP BY key, g) SELECT key, 'p' || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) AS runs FROM r GROUP BY key""")
def e02_page_runs(spark, sf_dir):
    return P.page_runs(_islands(spark, sf_dir))


@book.query("SELECT l_orderkey AS key, list_sort(list(DISTINCT l_linenumber)) AS pages FROM lineitem GROUP BY l_orderkey")
def f04_distinct_pages(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.array_distinct(F.collect_list("l_linenumber"))).alias("pages"))


@book.query(f"SELECT doc_id, page, CAST(CASE WHEN page = 1 THEN 3 WHEN page BETWEEN 2 AND 3 THEN page - 1 ELSE page END AS INTEGER) AS new_page FROM {_PAGES}")
def g44_move_page(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", "page", P.move_page(F.col("page"), 1, 3).alias("new_page"))


@book.query("SELECT n_nationkey AS tab, CAST(CASE WHEN n_nationkey = 7 THEN 2 WHEN n_nationkey BETWEEN 2 AND 6 THEN n_nationkey + 1 ELSE n_nationkey END AS INTEGER) AS new_tab FROM nation")
def g43_reorder_tabs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tab"), P.move_page(F.col("n_nationkey"), 7, 2).cast("int").alias("new_tab"))


@book.query(f"SELECT doc_id, page, CAST(count(*) OVER (PARTITION BY doc_id) + 1 - page AS INTEGER) AS cached_as FROM {_PAGES}")
def g41_permute_keys(spark, sf_dir):
    """Cache keys relabelled by a mapping old page to new page."""
    df = pages(spark, sf_dir).select("doc_id", "page")
    mapping = df.select("doc_id", "page", (F.count("*").over(Window.partitionBy("doc_id")) + 1 - F.col("page")).cast("int").alias("cached_as"))
    return df.join(mapping, ["doc_id", "page"]).select("doc_id", "page", "cached_as")


@book.query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS region, width FROM {_PAGES} WHERE page <> 2 UNION ALL SELECT DISTINCT doc_id, 0, 0.0::DOUBLE FROM {_PAGES}")
def g42_edit_regions(spark, sf_dir):
    """A region appended, one removed by its number, the rest numbered anew."""
    df = pages(spark, sf_dir)
    left = df.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where("n <> 2")
    left = left.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).cast("long").alias("region"), "width")
    return left.unionByName(df.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("region"), F.lit(0.0).alias("width")))


@book.query(f"SELECT a.doc_id, a.n AS first_parser, b.n AS second_parser FROM (SELECT doc_id, count(*) AS n FROM {_PAGES} GROUP BY doc_id) a FULL JOIN (SELECT doc_id, max(page)::BIGINT AS n FROM {_PAGES} GROUP BY doc_id) b USING (doc_id)")
def c29_parser_agreement(spark, sf_dir):
    """Two page counts of a document must agree, or the job fails."""
    df = pages(spark, sf_dir)
    a = df.groupBy("doc_id").agg(F.count("*").alias("first_parser"))
    b = df.groupBy("doc_id").agg(F.max("page").cast("long").alias("second_parser"))
    both = a.join(b, "doc_id", "full_outer")
    return both.where(F.assert_true(F.col("first_parser").eqNullSafe(F.col("second_parser")), "page counts differ").isNull())


#: A file for each customer: a page per order, half of them below a turned node, a size of their
#: own where the order's number is even.
_TREE = "(SELECT CAST(o_custkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS page, CASE WHEN o_orderkey % 2 = 0 THEN 300.0 + o_orderkey % 50 ELSE 200.0 END AS w, CASE WHEN o_orderkey % 2 = 0 THEN 100.0 ELSE 500.0 END AS h, o_orderkey % 2 = 1 AS turned FROM orders)"


@book.query(f"""SELECT path, CAST(page AS INTEGER) AS page, CAST(CASE WHEN turned THEN h ELSE w END AS DOUBLE) AS width, CAST(CASE WHEN turned THEN w ELSE h END AS DOUBLE) AS height, CAST(CASE WHEN turned THEN 90 ELSE 0 END AS INTEGER) AS rotation, CAST(path AS BIGINT) % 3 = 0 AS linearized, CAST(NULL AS VARCHAR) AS error FROM {_TREE} WHERE CAST(path AS BIGINT) % 7 > 1
    UNION ALL SELECT DISTINCT path, NULL, NULL, NULL, NULL, CAST(path AS BIGINT) % 3 = 0, CASE WHEN CAST(path AS BIGINT) % 7 = 0 THEN 'not a PDF file' ELSE 'PASSWORD_REQUIRED' END FROM {_TREE} WHERE CAST(path AS BIGINT) % 7 < 2""")
def a01_pages_of_files(spark, sf_dir):
    """Bytes of files written here and parsed by the source: plain, encrypted, and no PDF at all."""
    key, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    number = (key + 10).cast("string")
    size = F.when(even, F.concat(F.lit("/MediaBox [0 0 "), (key % 50 + 300).cast("string"), F.lit(" 100] "))).otherwise("")
    page = F.concat(number, F.lit(" 0 obj << /Type /Page /Parent "), F.when(even, "2").otherwise("3"), F.lit(" 0 R "), size, F.lit(">> endobj\n"))
    kid = F.struct(key.alias("key"), F.concat(number, F.lit(" 0 R")).alias("ref"))
    kids = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, kid))), lambda k: k["ref"]), " ")
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(page), "").alias("objects"), kids(even).alias("straight"), kids(~even).alias("turned"))
    owner = F.col("o_custkey")
    head = F.concat(F.when(owner % 7 == 0, "no file").otherwise("%PDF-1.7"), F.lit("\n"), F.when(owner % 3 == 0, "9 0 obj << /Linearized 1 >> endobj\n").otherwise(""))
    tree = F.concat(F.lit("1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /MediaBox [0 0 200 500] /Kids ["), "straight", F.lit(" 3 0 R] >> endobj\n3 0 obj << /Type /Pages /Rotate 90 /Kids ["), "turned", F.lit("] >> endobj\n"))
    tail = F.concat(F.lit("trailer << /Root 1 0 R "), F.when(owner % 7 == 1, "/Encrypt 8 0 R ").otherwise(""), F.lit(">>"))
    content = F.encode(F.concat(head, tree, F.col("objects"), tail), "UTF-8")
    return pdf.parse_pages(files.select(owner.cast("string").alias("path"), content.alias("content")))


@book.query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(string_agg('--- Page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS sha256 FROM {_PAGES} GROUP BY doc_id")
def a14_saved_documents(spark, sf_dir):
    """Exported texts in files, one a document, read back from the folder that was committed."""
    from ..lineage import Rounds
    from ..sources import text_files

    text_files.register(spark)
    folder = Rounds(spark).folder
    rows = P.export_text(pages(spark, sf_dir)).select("doc_id", F.col("exported").alias("content"), F.lit(True).alias("verified"))
    rows.write.format("document_files").mode("append").option("path", folder).save()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("doc_id"), F.sha2("content", 256).alias("sha256"))
