"""Lines, runs and wrapping over words and rectangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds as O
from .geometry import RECTS, r_, rects
from .registry import Book, table
from .search import _WORDS, words

book = Book()


def _page_rects(spark, sf_dir, low: float = 40.0):
    """Rectangles of each order, close together; an order's lie in one task, as what follows takes them."""
    df = rects(spark, sf_dir).select("k", "n", "x", (F.col("y") % low).alias("y"), "width", "height").repartition("k")
    return df.groupBy("k", "n").agg(*[F.min(c).alias(c) for c in ("x", "y", "width", "height")])


_R = f"(SELECT k, n, min(x) AS x, min(fmod(y, 40)) AS y, min(width) AS width, min(height) AS height FROM {RECTS} GROUP BY k, n)"


@book.query(f"SELECT k, n, CAST(sum(apart) OVER (PARTITION BY k ORDER BY n) AS BIGINT) AS line FROM (SELECT k, n, CASE WHEN lag(y) OVER w IS NOT NULL AND NOT (y < lag(y + height) OVER w AND y + height > lag(y) OVER w) THEN 1 ELSE 0 END AS apart FROM {_R} WINDOW w AS (PARTITION BY k ORDER BY n))")
def e03_line_numbers(spark, sf_dir):
    return O.line_numbers(_page_rects(spark, sf_dir).withColumn("ord", F.col("n")), "k").select("k", "n", "line")


_FOLD = """WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC, x, n) AS i FROM {r}), f AS (SELECT k, i, n, x, y AS ay, height AS ah, 1 AS line FROM s WHERE i = 1
    UNION ALL SELECT s.k, s.i, s.n, s.x, CASE WHEN abs(f.ay - s.y) <= greatest(f.ah, s.height) * 0.5 THEN f.ay ELSE s.y END, CASE WHEN abs(f.ay - s.y) <= greatest(f.ah, s.height) * 0.5 THEN f.ah ELSE s.height END, CASE WHEN abs(f.ay - s.y) <= greatest(f.ah, s.height) * 0.5 THEN f.line ELSE f.line + 1 END
    FROM f JOIN s ON s.k = f.k AND s.i = f.i + 1)"""
_WORD = "struct<x:double,y:double,n:int,width:double,height:double,text:string>"


def _anchored(spark, sf_dir):
    word = F.struct("x", "y", "n", "width", "height", F.concat(F.lit("w"), F.col("n").cast("string")).alias("text"))
    pages = _page_rects(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(word), lambda a, b: a["n"] - b["n"]).alias("words"))
    return pages.select("k", O.anchored_lines(F.col("words"), _WORD).alias("lines"))


@book.query(f"{_FOLD.format(r=_R)} SELECT k, n, CAST(line AS INTEGER) AS line FROM f")
def e04_anchored_lines(spark, sf_dir):
    rows = _anchored(spark, sf_dir).select("k", F.posexplode("lines").alias("at", "line_words"))
    return rows.select("k", F.explode("line_words").alias("w"), (F.col("at") + 1).alias("line")).select("k", "w.n", "line")


@book.query(f"{_FOLD.format(r=_R)} SELECT k, string_agg(t, chr(10) ORDER BY line) AS text FROM (SELECT k, line, string_agg('w' || n, ' ' ORDER BY x, i) AS t FROM f GROUP BY k, line) GROUP BY k")
def h24_lines_text(spark, sf_dir):
    return _anchored(spark, sf_dir).select("k", O.line_text(F.col("lines")).alias("text"))


@book.query(f"{_FOLD.format(r=_R)} SELECT f.k, CAST(line AS INTEGER) AS line, min(r.x) AS x, max(r.x + r.width) - min(r.x) AS width, max(r.y + r.height) - min(r.y) AS height FROM f JOIN {_R} r ON f.k = r.k AND f.n = r.n GROUP BY f.k, line")
def d08_line_boxes(spark, sf_dir):
    rows = _anchored(spark, sf_dir).select("k", F.posexplode(O.line_boxes(F.col("lines"))).alias("at", "b"))
    return rows.select("k", (F.col("at") + 1).alias("line"), "b.x", "b.width", "b.height")


@book.query(f"SELECT a.k, a.n, b.n AS m FROM {_R} a JOIN {_R} b ON a.k = b.k AND b.n = a.n + 1 WHERE least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) > 0.5::DOUBLE * least(a.height, b.height)")
def e07_shares_line(spark, sf_dir):
    from ..functions.geometry import shares_line

    df = _page_rects(spark, sf_dir).select("k", "n", r_().alias("r"))
    nxt = df.select("k", (F.col("n") - 1).alias("n"), F.col("n").alias("m"), F.col("r").alias("s"))
    return df.join(nxt, ["k", "n"]).where(shares_line(F.col("r"), F.col("s"))).select("k", "n", "m")


@book.query()
def e06_merge_runs(spark, sf_dir):
    """Order-dependent with a growing state; held against a plain loop in the tests."""
    order = F.array_sort(F.collect_list(F.struct("n", r_().alias("r"))), lambda a, b: a["n"] - b["n"])
    pages = _page_rects(spark, sf_dir).groupBy("k").agg(F.transform(order, lambda p: p["r"]).alias("rects"))
    rows = pages.select("k", F.posexplode(O.merge_runs(F.col("rects"))).alias("at", "b"))
    return rows.select("k", "at", "b.x", "b.y", "b.width", "b.height")


@book.query()
def e05_text_runs(spark, sf_dir):
    """Order-dependent with a growing state; held against a plain loop in the tests."""
    char = F.struct(F.when(F.col("n") == 3, " ").otherwise(F.col("n").cast("string")).alias("text"), "x", "y", "width", "height", (F.col("height") / 2).alias("size"))
    order = F.array_sort(F.collect_list(F.struct("n", char.alias("c"))), lambda a, b: a["n"] - b["n"])
    pages = _page_rects(spark, sf_dir).groupBy("k").agg(F.transform(order, lambda p: p["c"]).alias("chars"))
    rows = pages.select("k", F.posexplode(O.text_runs(F.col("chars"))).alias("at", "r"))
    return rows.select("k", "at", "r.text", "r.x", "r.width")


@book.query(f"""SELECT doc_id, page, string_agg(CASE WHEN prev IS NULL THEN '' WHEN line <> prev THEN chr(10) WHEN ord * 10.0::DOUBLE + ord % 3 - prev_right > 12 * 0.2::DOUBLE THEN chr(9) ELSE '' END || text, '' ORDER BY ord) AS copied FROM (SELECT *, lag(line) OVER w AS prev, lag(ord * 10.0::DOUBLE + 9.0::DOUBLE) OVER w AS prev_right FROM {_WORDS} WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)) GROUP BY doc_id, page""")
def e08_copied_text(spark, sf_dir):
    placed = [(F.col("ord") * 10.0 + F.col("ord") % 3).alias("x"), (F.col("ord") * 10.0 + 9.0).alias("right"), F.lit(12.0).alias("size")]
    return O.copied_text(words(spark, sf_dir).select("doc_id", "page", "ord", "text", "line", *placed), "doc_id", "page")


@book.query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS idx, l_quantity >= 15 AS good FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity DESC)),
    n AS (SELECT *, lag(good) OVER w AND lag(idx) OVER w = idx - 1 AS p, lead(good) OVER w AND lead(idx) OVER w = idx + 1 AS q FROM c WINDOW w AS (PARTITION BY k ORDER BY idx))
    SELECT k, min(idx) AS "first", max(idx) AS "last" FROM n WHERE good AND (coalesce(p, false) OR coalesce(q, false)) GROUP BY k""")
def e01_run_extent(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("idx")).agg(F.max("l_quantity").alias("n"))
    return O.run_extent(counts, 15, "k")


@book.query()
def e17_wrapped_lines(spark, sf_dir):
    """Greedy with real widths; held against a plain loop in the tests."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(O.wrapped(F.col("text"), F.lit("Helvetica"), F.lit(12.0), F.lit(200.0))).alias("at", "line"))
    return pages


@book.query(r"SELECT conv_id, turn, CAST(length(regexp_replace(text, '[^\x20-\x7E\xA0-\xFF\x{152}\x{153}\x{20AC}]', '', 'g')) AS INTEGER) AS n FROM conversations")
def h19_encodable(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(T.encodable(F.col("text"))).alias("n"))


@book.query("SELECT k, pos, CAST(CASE WHEN code BETWEEN 32 AND 126 OR code BETWEEN 160 AND 255 THEN code WHEN code = 338 THEN 140 WHEN code = 339 THEN 156 WHEN code = 8364 THEN 128 WHEN code = 8217 THEN 146 END AS INTEGER) AS byte FROM (SELECT k, CAST(pos - 1 AS INTEGER) AS pos, unicode(ch) AS code FROM (SELECT item_id AS k, unnest(string_split(text || 'œ€’漢', '')) AS ch, generate_subscripts(string_split(text || 'œ€’漢', ''), 1) AS pos FROM benchmark))")
def h18_ansi_byte(spark, sf_dir):
    """Of every character of every text; null where it has none."""
    chars = F.filter(F.split(F.concat("text", F.lit("œ€’漢")), ""), lambda c: c != "")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.posexplode(chars).alias("pos", "ch"))
    return rows.select("k", "pos", T.ansi_byte(F.col("ch")).alias("byte"))


_W = "[" + ",".join(map(str, T.ASCII_WIDTHS)) + "]"


@book.query(f"SELECT n_nationkey AS k, list_transform(range(1, length(n_name) + 1), lambda i: ({_W})[unicode(substr(n_name, i, 1)) - 31]) AS widths FROM nation")
def h20_char_widths(spark, sf_dir):
    chars = F.filter(F.split("n_name", ""), lambda c: c != "")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.transform(chars, T.char_width).alias("widths"))


@book.query(f"SELECT p_partkey AS k, 12.0::DOUBLE * list_sum(list_transform(range(1, length(p_name) + 1), lambda i: ({_W})[unicode(substr(p_name, i, 1)) - 31]))::BIGINT / 1000.0::DOUBLE AS width FROM part")
def d20_natural_width(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.natural_width(F.col("p_name"), F.lit(12.0)).alias("width"))


@book.query("SELECT p_partkey AS k, 10.0::DOUBLE * (length(p_name) * 600) / 1000.0::DOUBLE AS width FROM part")
def d21_run_width(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.run_width(F.col("p_name"), F.lit("Courier"), F.lit(10.0)).alias("width"))


@book.query("SELECT p_partkey AS k, least(greatest(CAST(p_size AS DOUBLE) / (p_size % 7) * 100.0::DOUBLE, 1.0), 1000.0)::DOUBLE AS percent FROM part WHERE p_size % 7 > 0")
def h21_horizontal_scale(spark, sf_dir):
    df = table(spark, sf_dir, "part").where("p_size % 7 > 0")
    return df.select(F.col("p_partkey").alias("k"), T.horizontal_scale((F.col("p_size") % 7).cast("double"), F.col("p_size").cast("double")).alias("percent"))


#: How far Helvetica reaches above and below its baseline, in font sizes.
ASCENT, DESCENT = 0.905, 0.211


def text_operators(text, x, y, width, height):
    """Drawing operators of invisible text over a word; null where no character can be written."""
    shown = T.encodable(text)
    size = F.greatest(height, F.lit(1.0)) / (ASCENT + DESCENT)
    stretch = T.horizontal_scale(T.natural_width(text, size), width)
    literal = F.regexp_replace(shown, r"([\\()])", r"\\$1")
    return F.when(shown != "", F.concat(F.format_string("BT /F1 %.2f Tf 3 Tr %.2f Tz %.2f %.2f Td (", size, stretch, x, y + DESCENT * size), literal, F.lit(") Tj ET")))


@book.query(rf"SELECT doc_id, page, ord, contains(text, '(') AS has_paren FROM {_WORDS} WHERE regexp_matches(text, '[\x20-\x7E\xA0-\xFF\x{{152}}\x{{153}}\x{{20AC}}]')")
def h30_text_stream(spark, sf_dir):
    """Every word with a character that can be written is drawn once."""
    rows = words(spark, sf_dir)
    op = text_operators(F.col("text"), F.col("ord") * 10.0, F.lit(100.0), F.lit(50.0), F.lit(10.0))
    drawn = rows.withColumn("op", op).where(F.rlike("op", F.lit(r"^BT /F1 8\.96 Tf 3 Tr [\d.]+ Tz [\d.]+ 101\.89 Td \(.*\) Tj ET$")))
    return drawn.select("doc_id", "page", "ord", F.contains("op", F.lit("\\(")).alias("has_paren"))
