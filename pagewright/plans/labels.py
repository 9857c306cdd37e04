"""Labels and short texts from codes and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from .registry import Book, table

book = Book()


def _case(expr: str, table_: dict[str, str], default: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {expr} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table_.items()) + f" ELSE {default} END"


def _pick(column: str, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


def _pick_sql(column: str, values) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[CAST({column} % {len(values)} + 1 AS INTEGER)]"


_REASONS = (*L.REASONS, "something else")
_FILTERS = ("DCTDecode", "FlateDecode+DCTDecode", "", "JBIG2Decode", "Own+LZWDecode")
_CODES = ("PDF/A-2b", "PDF/X-4", "PDF/UA-1", "PDF/E-1", "ISO 1", "PDF/VT")
_STATES = ("verified", "modifiedAfter", "invalid", "unknown", "unsigned")
_COLORS = ("#000000", "#ffffff", "#ff8800", "#2a4b7c", "#c0ffee")
_DATES = ("D:20260710143005-04'00'", "D:2026", "D:20261301", "20240229", "not a date", "D:19991231235959Z", "D:202601021530+0530", "")


@book.query(f"SELECT p_partkey AS k, {_case(_pick_sql('p_partkey', _REASONS), L.REASONS, _pick_sql('p_partkey', _REASONS))} AS label FROM part")
def h58_reason_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.reason_label(_pick("p_partkey", _REASONS)).alias("label"))


@book.query(f"SELECT p_partkey AS k, CASE {_pick_sql('p_partkey', _FILTERS)} WHEN 'DCTDecode' THEN 'JPEG' WHEN 'FlateDecode+DCTDecode' THEN 'Flate + JPEG' WHEN '' THEN 'uncompressed' WHEN 'JBIG2Decode' THEN 'JBIG2' ELSE 'Own + LZW' END AS label FROM part")
def h57_filter_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.filter_label(_pick("p_partkey", _FILTERS)).alias("label"))


@book.query(f"SELECT p_partkey AS k, {_case(_pick_sql('p_partkey', _CODES), {'PDF/A-2b': 'PDF/A-2b (archiving)', 'PDF/X-4': 'PDF/X-4 (print)', 'PDF/UA-1': 'PDF/UA-1 (accessibility)', 'PDF/E-1': 'PDF/E-1 (engineering)'}, _pick_sql('p_partkey', _CODES))} AS label FROM part")
def h60_describe_claim(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.describe_claim(_pick("p_partkey", _CODES)).alias("label"))


@book.query(f"SELECT p_partkey AS k, {_case(_pick_sql('p_partkey', _STATES), {k: v[0] for k, v in L.BADGES.items()}, 'NULL')} AS text, {_case(_pick_sql('p_partkey', _STATES), {k: v[1] for k, v in L.BADGES.items()}, 'NULL')} AS kind FROM part")
def h62_signature_badge(spark, sf_dir):
    text, kind = L.signature_badge(_pick("p_partkey", _STATES))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.alias("text"), kind.alias("kind"))


_INTEGRITY = ("ok", "failed", "unknown", "ok")
_SIG = f"(SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'Signer ' || l_suppkey END AS signer, {_pick_sql('l_partkey', _INTEGRITY)} AS integrity, l_returnflag = 'R' AS modified FROM lineitem)"


def _signatures(spark, sf_dir):
    signer = F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("Signer "), F.col("l_suppkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), signer.alias("signer"), _pick("l_partkey", _INTEGRITY).alias("integrity"), (F.col("l_returnflag") == "R").alias("modified"))


_LINE = "'Signed by ' || CASE WHEN signer = '' THEN 'Unknown signer' ELSE signer END || ' — ' || CASE WHEN integrity = 'failed' THEN 'signature is invalid (document altered)' WHEN integrity = 'unknown' THEN 'present — not verified here' WHEN modified THEN 'intact, but modified after signing' ELSE 'intact' END"


@book.query(f"SELECT k, string_agg({_LINE}, '; ' ORDER BY n, {_LINE}) AS sentence FROM {_SIG} GROUP BY k")
def h61_describe_signatures(spark, sf_dir):
    line = L.describe_signature(F.col("signer"), F.col("integrity"), F.col("modified"))
    lines = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return _signatures(spark, sf_dir).groupBy("k").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "; ").alias("sentence"))


@book.query(f"SELECT o_orderkey AS k, CASE WHEN count(s.n) = 0 THEN 'unsigned' WHEN bool_or(integrity = 'failed') THEN 'invalid' WHEN bool_or(integrity = 'unknown') THEN 'unknown' WHEN bool_or(modified) THEN 'modifiedAfter' ELSE 'verified' END AS status FROM orders LEFT JOIN {_SIG} s ON o_orderkey = k GROUP BY o_orderkey")
def d09_aggregate_status(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    status = L.aggregate_status(F.count("n"), any_(F.col("integrity") == "failed"), any_(F.col("integrity") == "unknown"), any_(F.col("modified")))
    return docs.join(_signatures(spark, sf_dir), "k", "left").groupBy("k").agg(status.alias("status"))


@book.query("SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 OR p_size % 5 = 0 OR p_size % 7 = 0 THEN 'unknown' WHEN p_size % 3 = 0 THEN 'ok' ELSE 'failed' END AS integrity FROM part")
def h49_check_integrity(spark, sf_dir):
    size = F.col("p_size")
    algorithm = L.lookup(L.DIGESTS, F.when(size % 7 == 0, "1.2.3").otherwise("2.16.840.1.101.3.4.2.1"))
    state = L.integrity(F.when(size % 4 != 0, size), F.when(size % 5 != 0, F.when(size % 3 == 0, "a").otherwise("b")), F.lit("a"), algorithm)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), state.alias("integrity"))


_OIDS = (*L.DIGESTS, "1.2.3")


@book.query(f"SELECT p_partkey AS k, {_case(_pick_sql('p_partkey', _OIDS), L.DIGESTS, 'NULL')} AS algorithm FROM part")
def h48_digest_algorithm(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.lookup(L.DIGESTS, _pick("p_partkey", _OIDS)).alias("algorithm"))


@book.query("SELECT k, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.2f MB', n / 1048576.0::DOUBLE) END AS size FROM (SELECT o_orderkey AS k, CAST(o_custkey * o_custkey * 7 AS BIGINT) AS n FROM orders)")
def h55_format_bytes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), L.format_bytes(F.col("o_custkey") * F.col("o_custkey") * 7).alias("size"))


@book.query("SELECT o_orderkey AS k, CASE WHEN o_custkey % 50 <= 0 THEN '0%' ELSE printf('%.1f%%', sign(x) * floor(abs(x) * 10 + 0.5::DOUBLE) / 10) END AS reduction FROM (SELECT *, (o_custkey % 50 - o_custkey % 40) / CAST(nullif(o_custkey % 50, 0) AS DOUBLE) * 100 AS x FROM orders)")
def h56_percent_reduction(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), L.percent_reduction(F.col("o_custkey") % 50, F.col("o_custkey") % 40).alias("reduction"))


@book.query(r"SELECT page_id AS k, regexp_replace(url, '(?s)^(.+)\.[^.]*$', '\1') || '-compressed.pdf' AS name FROM pages")
def h59_suggest_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), L.suggest_name(F.col("url")).alias("name"))


_FAMILIES = ("Helvetica", "Times", "Courier", "Other")


@book.query(f"SELECT p_partkey AS k, {_case(_pick_sql('p_partkey', _FAMILIES), L.FONT_STACKS, repr('Arial, Helvetica, sans-serif'))} AS css FROM part")
def h82_font_stack(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.font_stack(_pick("p_partkey", _FAMILIES)).alias("css"))


@book.query(f"""SELECT p_partkey AS k, CASE f WHEN 'Times' THEN CASE WHEN b AND i THEN 'Times-BoldItalic' WHEN b THEN 'Times-Bold' WHEN i THEN 'Times-Italic' ELSE 'Times-Roman' END
    ELSE CASE WHEN f = 'Courier' THEN 'Courier' ELSE 'Helvetica' END || CASE WHEN b AND i THEN '-BoldOblique' WHEN b THEN '-Bold' WHEN i THEN '-Oblique' ELSE '' END END AS font
    FROM (SELECT p_partkey, {_pick_sql('p_partkey', _FAMILIES)} AS f, p_size % 2 = 0 AS b, p_size % 3 = 0 AS i FROM part)""")
def h54_base_font(spark, sf_dir):
    font = L.base_font(_pick("p_partkey", _FAMILIES), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), font.alias("font"))


_FONTS = ("Helv", "ArialMT", "TiRo", "Times-Bold", "CourierNew", "Zapf")


@book.query(f"SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'Helvetica, Arial, sans-serif' WHEN 1 THEN 'Helvetica, Arial, sans-serif' WHEN 2 THEN '''Times New Roman'', Times, serif' WHEN 3 THEN '''Times New Roman'', Times, serif' WHEN 4 THEN '''Courier New'', Courier, monospace' END AS family FROM part")
def h12_font_family(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.font_family(_pick("p_partkey", _FONTS)).alias("family"))


_HEX = "lower(lpad(to_hex(CAST(floor(least(greatest({0}, 0.0::DOUBLE), 1.0::DOUBLE) * 255 + 0.5::DOUBLE) AS BIGINT)), 2, '0'))"


@book.query(f"SELECT l_orderkey AS k, l_linenumber AS n, '#' || {_HEX.format('l_discount * 10')} || {_HEX.format('l_tax * 12')} || {_HEX.format('l_quantity / 50 - 0.1::DOUBLE')} AS color FROM lineitem")
def h13_rgb_hex(spark, sf_dir):
    color = L.rgb_hex(F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50 - 0.1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), color.alias("color"))


@book.query(f"SELECT l_orderkey AS k, l_linenumber AS n, '#' || {_HEX.format('l_tax * 12')} || {_HEX.format('l_tax * 12')} || {_HEX.format('l_tax * 12')} AS color FROM lineitem")
def h14_gray_hex(spark, sf_dir):
    v = F.col("l_tax") * 12
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), L.rgb_hex(v, v, v).alias("color"))


@book.query(f"SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 42 / 255.0::DOUBLE ELSE 192 / 255.0::DOUBLE END::DOUBLE AS red FROM part")
def h64_hex_rgb(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.element_at(L.hex_rgb(_pick("p_partkey", _COLORS)), 1).alias("red"))


@book.query(f"SELECT p_partkey AS k, CASE WHEN p_partkey % 5 IN (1, 2, 4) THEN '#1a1a1a' ELSE '#ffffff' END AS color FROM part")
def h65_contrast_color(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.contrast_color(_pick("p_partkey", _COLORS)).alias("color"))


@book.query("SELECT p_partkey AS k, CASE p_size % 4 WHEN 1 THEN 'center' WHEN 2 THEN 'right' ELSE 'left' END AS align FROM part")
def h15_quadding(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.quadding(F.col("p_size") % 4).alias("align"))


_SHOWN = ("July 10, 2026 at 14:30:05 UTC-04:00", "January 1, 2026", "D:20261301", "February 29, 2024", "not a date", "December 31, 1999 at 23:59:59 UTC", "January 2, 2026 at 15:30:00 UTC+05:30", "")


@book.query(f"SELECT p_partkey AS k, {_pick_sql('p_partkey', _SHOWN)} AS shown FROM part")
def h32_format_pdf_date(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.pdf_date(_pick("p_partkey", _DATES)).alias("shown"))


@book.query(f"SELECT p_partkey AS k, regexp_replace({_pick_sql('p_partkey', _DATES)}, '^D:', '') AS body FROM part")
def h33_date_body(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), L.date_body(_pick("p_partkey", _DATES)).alias("body"))


@book.query("SELECT event_id AS k, strftime(ts, 'D:%Y%m%d%H%M%S') || '+00''00''' AS stamp FROM events")
def h31_pdf_date(spark, sf_dir):
    stamp = F.date_format("ts", "'D:'yyyyMMddHHmmss")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.concat(stamp, F.lit("+00'00'")).alias("stamp"))


@book.query("SELECT p_partkey AS k, printf('%.2f', round(p_size / 72.0::DOUBLE, 2)) AS inches FROM part")
def h79_inches(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.format_string("%.2f", F.col("p_size") / 72.0).alias("inches"))


@book.query("SELECT p_partkey AS k, CAST(round((p_size / 25.0::DOUBLE - 1) * 100) AS BIGINT) AS gain, p_size / 25.0::DOUBLE > 1.005 AS applies FROM part")
def h80_gain_percent(spark, sf_dir):
    s = F.col("p_size") / 25.0
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round((s - 1) * 100).cast("long").alias("gain"), (s > 1.005).alias("applies"))


@book.query("SELECT p_partkey AS k, 160.0::DOUBLE AS width, greatest(p_size * 1.6::DOUBLE, 20.0::DOUBLE) AS height FROM part")
def h81_new_note(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit(160.0).alias("width"), F.greatest(F.col("p_size") * 1.6, F.lit(20.0)).alias("height"))

book.queries["h63_rgb_to_hex"], book.sql["h63_rgb_to_hex"] = h13_rgb_hex, book.sql["h13_rgb_hex"]
