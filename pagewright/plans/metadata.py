"""Document information, declared standards and redaction of both. Info entries come from customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from ..operators import fields as O
from ..operators import scrub as R
from ..shipping import ship
from .labels import _pick, _pick_sql
from .registry import Book, table

book = Book()

FIELDS = ("Title", "Author", "Subject", "Keywords", "Creator")
_INFO = "(SELECT c_custkey AS doc_id, c_name AS Title, c_mktsegment AS Author, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment || ' report' ELSE '' END AS Subject, CAST(c_nationkey AS VARCHAR) AS Keywords, CASE WHEN c_nationkey % 3 = 0 THEN 'Press ' || c_nationkey END AS Creator FROM customer)"
_QUERIES = [" Building ", "press 3", "  "]


def info(spark, sf_dir) -> DataFrame:
    """doc_id and a map of Info entries; absent entries are not in the map."""
    nation = F.col("c_nationkey")
    subject = F.when(nation % 2 == 0, F.concat("c_mktsegment", F.lit(" report"))).otherwise("")
    values = F.array(F.col("c_name"), F.col("c_mktsegment"), subject, nation.cast("string"), F.when(nation % 3 == 0, F.concat(F.lit("Press "), nation.cast("string"))))
    full = F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), values)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.map_filter(full, lambda _, v: v.isNotNull()).alias("info"))


def _entry(key: str):
    return F.coalesce(F.try_element_at("info", F.lit(key)), F.lit(""))


@book.query(f"SELECT doc_id, Title AS title, Author AS author, Subject AS subject, Keywords AS keywords, coalesce(Creator, '') AS creator FROM {_INFO}")
def b01_metadata(spark, sf_dir):
    return info(spark, sf_dir).select("doc_id", *[_entry(f).alias(f.lower()) for f in FIELDS])


@book.query(f"SELECT doc_id, coalesce(Creator, '') AS text FROM {_INFO}")
def b02_info_text(spark, sf_dir):
    return info(spark, sf_dir).select("doc_id", _entry("Creator").alias("text"))


_HIT = "contains(lower({0}), 'building') OR contains(lower({0}), 'press 3')"
_MATCHED = "list_filter([" + ", ".join(f"CASE WHEN {_HIT.format(f'coalesce({x}, {chr(39) * 2})')} THEN '{x}' END" for x in FIELDS) + "], lambda x: x IS NOT NULL)"


@book.query(f"SELECT doc_id, {_MATCHED} AS fields FROM {_INFO}")
def b03_matching_fields(spark, sf_dir):
    wanted = T.needles(_QUERIES)
    fields = F.filter(F.array(*[F.when(T.contains_any(_entry(f), wanted), F.lit(f)) for f in FIELDS]), lambda f: f.isNotNull())
    return info(spark, sf_dir).select("doc_id", fields.alias("fields"))


@book.query(f"SELECT doc_id, unnest({_MATCHED}) AS field FROM {_INFO}")
def b04_matching_field_rows(spark, sf_dir):
    return b03_matching_fields(spark, sf_dir).select("doc_id", F.explode("fields").alias("field"))


@book.query(f"SELECT doc_id, Author <> 'BUILDING' OR coalesce(Creator, '') <> '' AS dirty FROM {_INFO}")
def b31_dirty(spark, sf_dir):
    """Edited so that the author is BUILDING and there is no creator."""
    edited = T.updated(F.col("info"), F.create_map(F.lit("Author"), F.lit("BUILDING"), F.lit("Creator"), F.lit("")))
    return info(spark, sf_dir).select("doc_id", T.differs(F.col("info"), edited, FIELDS).alias("dirty"))


@book.query(f"SELECT doc_id, 'New' AS title, Author AS author, coalesce(Creator, '') AS creator FROM {_INFO}")
def g14_write_metadata(spark, sf_dir):
    """New entries win, the others stay."""
    new = info(spark, sf_dir).withColumn("info", T.updated(F.col("info"), F.create_map(F.lit("Title"), F.lit("New"))))
    return new.select("doc_id", _entry("Title").alias("title"), _entry("Author").alias("author"), _entry("Creator").alias("creator"))


@book.query("SELECT conv_id AS doc_id, turn AS page, regexp_replace(text, '(?i)tion', '████', 'g') AS redacted, NOT regexp_matches(text, '(?i)tion') AS untouched FROM conversations")
def g37_redact_text(spark, sf_dir):
    """Matches blacked out; the result is searched again, and a hit fails the job."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.regexp_replace("text", "(?i)tion", "████").alias("redacted"), (~F.rlike("text", F.lit("(?i)tion"))).alias("untouched"))
    return rows.where(F.assert_true(~F.rlike("redacted", F.lit("(?i)tion")), "a query still has hits").isNull())


@book.query("SELECT doc_id, toxic = 0 AND quality = 1 AS verified FROM labels")
def d13_verified(spark, sf_dir):
    """No leaks and no violations."""
    labels = table(spark, sf_dir, "labels")
    return R.verified(labels.select("doc_id"), labels.where("toxic = 1").select("doc_id"), labels.where("quality = 0").select("doc_id")).select("doc_id", "verified")


_XMPS = (
    '<rdf pdfaid:part="2" pdfaid:conformance="B"/>',
    "<pdfaid:part> 3 </pdfaid:part><pdfaid:conformance>U</pdfaid:conformance>",
    '<x pdfxid:GTS_PDFXVersion="PDF/X-4"/>',
    "<pdfuaid:part>1</pdfuaid:part><pdfaid:part>1</pdfaid:part>",
    'xmlns:e="http://www.aiim.org/pdfe/ns/id/"',
    "<pdfeid:part>1</pdfeid:part> http://x/pdfz/ns/id/ http://x/pdfz/ns/id/ http://x/pdfa/ns/id/",
    '<y pdfaid:part=" "/> plain',
)


def _xmp(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), _pick("p_partkey", _XMPS).alias("xmp"))


def _answer(values) -> str:
    return f"SELECT p_partkey AS k, ([{', '.join('NULL' if v is None else repr(v) for v in values)}])[CAST(p_partkey % 7 + 1 AS INTEGER)] AS found FROM part"


@book.query(_answer(["2", "3", None, "1", None, None, None]))
def h01_xmp_value(spark, sf_dir):
    return _xmp(spark, sf_dir).select("k", T.xmp_value(F.col("xmp"), "pdfaid:part").alias("found"))


@book.query(_answer(["PDF/A-2b", "PDF/A-3u", None, "PDF/A-1", None, None, None]))
def h04_pdfa(spark, sf_dir):
    return _xmp(spark, sf_dir).select("k", T.pdfa(F.col("xmp")).alias("found"))


@book.query(_answer([None, None, "PDF/X-4", None, None, None, None]))
def h05_pdfx(spark, sf_dir):
    return _xmp(spark, sf_dir).select("k", T.pdfx(F.col("xmp")).alias("found"))


@book.query(_answer([None, None, None, None, "PDF/E", "PDF/E-1", None]))
def h06_pdfe(spark, sf_dir):
    return _xmp(spark, sf_dir).select("k", T.pdfe(F.col("xmp")).alias("found"))


@book.query(_answer([None, None, None, "PDF/UA-1", None, None, None]))
def h07_pdfua(spark, sf_dir):
    return _xmp(spark, sf_dir).select("k", T.pdfua(F.col("xmp")).alias("found"))


@book.query("SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 5 THEN ['pdfz'] ELSE []::VARCHAR[] END AS found FROM part")
def h03_unknown_schemas(spark, sf_dir):
    return _xmp(spark, sf_dir).select("k", T.unknown_schemas(F.col("xmp")).alias("found"))


@book.query("SELECT p_partkey AS k, ([['PDF/A-2b'], ['PDF/A-3u'], ['PDF/X-4'], ['PDF/A-1', 'PDF/UA-1'], ['PDF/E'], ['PDF/E-1', 'an unrecognized PDF standard (pdfz)'], []])[CAST(p_partkey % 7 + 1 AS INTEGER)] AS found FROM part")
def h02_claims(spark, sf_dir):
    return _xmp(spark, sf_dir).select("k", T.claims(F.col("xmp")).alias("found"))


@book.query("SELECT page_id AS k, nullif(trim(regexp_extract(html, 'href=\"([^\"]*)\"', 1)), '') AS found FROM pages")
def b29_property_of_page(spark, sf_dir):
    """The same extraction on real markup: the first link's target."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), T.xmp_value(F.col("html"), "href").alias("found"))


@book.query("SELECT p_partkey AS k, ([['PDF/A-2b'], ['PDF/A-3u'], ['PDF/X-4'], ['PDF/A-1'], [], [], []])[CAST(p_partkey % 7 + 1 AS INTEGER)] AS found FROM part")
def b27_breaking_claims(spark, sf_dir):
    return _xmp(spark, sf_dir).select("k", T.breaking_claims(T.claims(F.col("xmp"))).alias("found"))


@book.query("SELECT doc_id AS k, text AS decoded FROM documents")
def h08_decode_pdf_string(spark, sf_dir):
    """Written as UTF-16BE after a byte order mark, and read back."""
    raw = F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), T.pdf_string(raw).alias("decoded"))


@book.query("SELECT doc_id AS k, text = left(text, length(text)) AND octet_length(encode(text)) = length(text) AS ascii_only, text AS decoded FROM documents")
def h09_pdf_string(spark, sf_dir):
    raw = T.to_pdf_string(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), (F.hex(F.substring(raw, 1, 2)) != "FEFF").alias("ascii_only"), T.pdf_string(raw).alias("decoded"))


@book.query("SELECT n_nationkey AS k, n_name AS latin, n_name || 'x' AS marked FROM nation")
def h10_decode_form_string(spark, sf_dir):
    """Latin-1, and UTF-16BE with an odd last byte, which is left out."""
    latin = F.encode("n_name", "ISO-8859-1")
    odd = F.concat(F.unhex(F.lit("FEFF")), F.encode(F.concat("n_name", F.lit("x")), "UTF-16BE"), F.unhex(F.lit("00")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), T.pdf_string(latin).alias("latin"), T.pdf_string(odd).alias("marked"))


@book.query("SELECT n_nationkey AS k, n_name || 'A' AS decoded FROM nation")
def h73_decode_padded(spark, sf_dir):
    odd = F.concat(F.unhex(F.lit("FEFF")), F.encode("n_name", "UTF-16BE"), F.unhex(F.lit("41")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), T.pdf_string(odd, pad=True).alias("decoded"))


@book.query("SELECT doc_id, lower(sha256(unhex(substr(hex(encode(text)), 1, 100) || substr(hex(encode(text)), 161, 80)))) AS digest FROM documents WHERE octet_length(encode(text)) >= 120 UNION ALL SELECT doc_id, NULL FROM documents WHERE octet_length(encode(text)) < 120 OR text IS NULL")
def d23_digest_byte_range(spark, sf_dir):
    """Two spans of the bytes of every document; spans past the end have no digest."""
    ship(spark)
    digest = B.over(lambda raw: B.digest_spans(raw, [0, 50, 80, 40], "sha256"), "binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(digest(F.encode("text", "UTF-8")))).alias("digest"))


@book.query("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey + l_suppkey AS covered, l_partkey + l_suppkey < 300 AS appended FROM lineitem")
def h51_coverage_end(spark, sf_dir):
    spans = F.array(F.lit(0).cast("long"), F.lit(10).cast("long"), F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), O.coverage_end(spans).alias("covered"), O.appended(spans, F.lit(300)).alias("appended"))


@book.query("SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber <> 3 AND l_partkey - 50 >= 0 AS valid FROM lineitem")
def h50_read_byte_range(spark, sf_dir):
    numbers = F.array(F.lit(0).cast("long"), F.lit(10).cast("long"), F.col("l_partkey") - 50)
    numbers = F.when(F.col("l_linenumber") != 3, F.array_append(numbers, F.col("l_suppkey"))).otherwise(numbers)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), O.byte_range(numbers).isNotNull().alias("valid"))


_PATCH = "(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Set ' || doc_id END AS Title, CASE WHEN doc_id % 3 = 0 THEN '' END AS Subject FROM (SELECT c_custkey AS doc_id FROM customer))"


@book.query(f"SELECT i.doc_id, coalesce(p.Title, i.Title) AS title, i.Author AS author, coalesce(p.Subject, i.Subject) AS subject, coalesce(i.Creator, '') AS creator FROM {_INFO} i JOIN {_PATCH} p USING (doc_id)")
def g15_set_metadata(spark, sf_dir):
    """A table of changes applied by key: entries given win, also empty ones; the others stay."""
    key = F.col("c_custkey")
    given = F.map_from_arrays(F.array(F.lit("Title"), F.lit("Subject")), F.array(F.when(key % 2 == 0, F.concat(F.lit("Set "), key.cast("string"))), F.when(key % 3 == 0, "")))
    changes = table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.map_filter(given, lambda _, v: v.isNotNull()).alias("changes"))
    rows = info(spark, sf_dir).join(changes, "doc_id").withColumn("info", T.updated(F.col("info"), F.col("changes")))
    return rows.select("doc_id", *[_entry(f).alias(f.lower()) for f in ("Title", "Author", "Subject", "Creator")])


@book.query("SELECT page_id AS k, list_filter(['pdfa', 'pdfx', 'pdfe', 'pdfua'], lambda t: page_id % (2 + length(t)) = 0) AS known FROM pages")
def j03_known_families(spark, sf_dir):
    """Which of the known families' schemas a text names: those that are not unknown."""
    named = F.array(*[F.when(F.col("page_id") % (2 + len(t)) == 0, F.lit(t)) for t in T.FAMILIES])
    xmp = F.concat(F.lit("http://x/other/ns/id/ "), F.array_join(F.transform(F.filter(named, lambda t: t.isNotNull()), lambda t: F.concat(F.lit("http://x/"), t, F.lit("/ns/id/"))), " "))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), T.known_schemas(xmp).alias("known"), T.unknown_schemas(xmp).alias("unknown"))
    return rows.where(F.assert_true(F.array_join("unknown", ",") == "other").isNull()).select("k", "known")
