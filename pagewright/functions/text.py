"""Text of documents: needles, properties in markup, encodings, colours and fonts in strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at either end.
_ENDS = r"(?U)^\s+|\s+$"


def trim_unicode(s: Column) -> Column:
    return F.regexp_replace(s, _ENDS, "")


def is_blank(s: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(F.rlike(s, F.lit(r"(?U)^\s*$")), F.lit(True))


def count_literal(text: Column, needle: str, match_case: bool = False) -> Column:
    """Non-overlapping occurrences of a literal; none for an empty one."""
    if not needle:
        return F.lit(0)
    text, needle = (text, needle) if match_case else (F.lower(text), needle.lower())
    return F.size(F.split(text, _quoted(needle), -1)) - 1


def _quoted(needle: str) -> str:
    """A pattern that matches just the needle."""
    return r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"


def count_words(text: Column, query: str, match_case: bool = False) -> Column:
    """Non-overlapping occurrences of a query, of one word or several, that neither begin nor
    end inside a run of letters and digits."""
    if not query:
        return F.lit(0)
    text, query = (text, query) if match_case else (F.lower(text), query.lower())
    return F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}]){_quoted(query)}(?![\p{{L}}\p{{N}}])"))


def line_regex(pattern: str) -> str:
    """A pattern in the search's regex mode: ^ and $ also match at line ends (unless the
    pattern turns that off); case and whole-word options don't apply."""
    return "(?m)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(line_regex(pattern)), F.lit(0))


def search_pattern(query: str, match_case: bool = False, whole_word: bool = False, use_regex: bool = False) -> str:
    """The pattern that a search looks for; in regex mode the other two options don't apply."""
    if use_regex:
        return line_regex(query)
    word = rf"(?<![\p{{L}}\p{{N}}]){_quoted(query)}(?![\p{{L}}\p{{N}}])" if whole_word else _quoted(query)
    return word if match_case else "(?iu)" + word


def needles(queries: list[str]) -> list[str]:
    """Queries trimmed and lower-cased, blank ones dropped."""
    return [q for q in (q.strip().lower() for q in queries) if q]


def contains_any(value: Column, wanted: list[str]) -> Column:
    low = F.lower(value)
    found = F.lit(False)
    for n in wanted:
        found = found | F.contains(low, F.lit(n))
    return found


def xmp_value(xmp: Column, key: str) -> Column:
    """A property written as an attribute, else as an element; null when blank."""
    attribute = F.nullif(trim_unicode(F.regexp_extract(xmp, rf'{key}="([^"]*)"', 1)), F.lit(""))
    element = F.nullif(trim_unicode(F.regexp_extract(xmp, rf"(?s)<{key}[^>]*>(.*?)</{key}>", 1)), F.lit(""))
    return F.coalesce(attribute, element)


def pdfa(xmp: Column) -> Column:
    """H04"""
    return F.concat(F.lit("PDF/A-"), xmp_value(xmp, "pdfaid:part"), F.coalesce(F.lower(xmp_value(xmp, "pdfaid:conformance")), F.lit("")))


def pdfx(xmp: Column) -> Column:
    """H05"""
    return xmp_value(xmp, "pdfxid:GTS_PDFXVersion")


def pdfe(xmp: Column) -> Column:
    """With its part, or bare where only a flag or the schema is there."""
    marked = xmp_value(xmp, "pdfeid:isPDFE").isNotNull() | F.contains(xmp, F.lit("/pdfe/ns/id"))
    return F.coalesce(F.concat(F.lit("PDF/E-"), xmp_value(xmp, "pdfeid:part")), F.when(marked, "PDF/E"))


def pdfua(xmp: Column) -> Column:
    """H07"""
    return F.concat(F.lit("PDF/UA-"), xmp_value(xmp, "pdfuaid:part"))


#: Schema token and detector of each known family, in the order of the report.
FAMILIES = {"pdfa": pdfa, "pdfx": pdfx, "pdfe": pdfe, "pdfua": pdfua}


def known_schemas(xmp: Column) -> Column:
    """The known families whose schema is named, in their order."""
    return F.filter(F.array(*[F.lit(t) for t in FAMILIES]), lambda t: F.contains(xmp, F.concat(F.lit("/"), t, F.lit("/ns/id/"))))


def updated(entries: Column, changes: Column) -> Column:
    """A map with the entries of another put in or in place of its own."""
    return F.map_concat(F.map_filter(entries, lambda k, _: ~F.map_contains_key(changes, k)), changes)


def differs(entries: Column, edited: Column, keys: tuple[str, ...]) -> Column:
    """Any of the keys has another value; an absent one is empty."""
    value = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))
    return F.exists(F.array(*[value(entries, k) != value(edited, k) for k in keys]), lambda x: x)


def unknown_schemas(xmp: Column) -> Column:
    """Tokens before /ns/id/ of no known family, distinct, as first seen."""
    tokens = F.array_distinct(F.regexp_extract_all(xmp, F.lit("(?<=/)([^/]+)/ns/id/"), F.lit(1)))
    return F.array_except(tokens, F.array(*[F.lit(t) for t in FAMILIES]))


def claims(xmp: Column) -> Column:
    """Known families in order, then unrecognised schemas."""
    known = F.filter(F.array(*[detect(xmp) for detect in FAMILIES.values()]), lambda c: c.isNotNull())
    return F.concat(known, F.transform(unknown_schemas(xmp), lambda t: F.concat(F.lit("an unrecognized PDF standard ("), t, F.lit(")"))))


def breaking_claims(declared: Column) -> Column:
    """B27"""
    return F.filter(declared, lambda c: F.startswith(c, F.lit("PDF/A")) | F.startswith(c, F.lit("PDF/X")))


def pdf_string(raw: Column, pad: bool = False) -> Column:
    """H08, H10 (H73 with ``pad``): UTF-16BE after a byte order mark, else Latin-1. An odd last
    byte is left out, or gets a zero in front of it."""
    body = F.substring(raw, 3, 1 << 30)
    odd = F.octet_length(body) % 2 == 1
    trimmed = F.when(odd, F.substring(body, F.lit(1), F.octet_length(body) - 1)).otherwise(body)
    if pad:
        trimmed = F.when(odd, F.concat(F.substring(body, F.lit(1), F.octet_length(body) - 1), F.unhex(F.lit("00")), F.substring(body, F.octet_length(body), F.lit(1)))).otherwise(body)
    return F.when(F.hex(F.substring(raw, 1, 2)) == "FEFF", F.decode(trimmed, "UTF-16BE")).otherwise(F.decode(raw, "ISO-8859-1"))


def to_pdf_string(s: Column) -> Column:
    """ASCII as it is, else byte order mark and UTF-16BE."""
    ascii_only = F.rlike(s, F.lit(r"^\p{ASCII}*$"))
    return F.when(ascii_only, F.encode(s, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(s, "UTF-16BE")))


def is_linearized(content: Column) -> Column:
    """The marker within the first 2048 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"), F.lit("/Linearized")) > 0


# Characters of the Windows code page outside Latin-1, by byte.
ANSI_EXTRA = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030,
    0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}
# Helvetica widths of printable ASCII from the space on, in thousandths.
ASCII_WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
# Helvetica widths of other bytes, first and last byte and width.
OTHER_WIDTHS = (
    (0x85, 0x85, 1000), (0x91, 0x92, 222), (0x93, 0x94, 333), (0x95, 0x95, 350), (0x97, 0x97, 1000), (0xA0, 0xA0, 278), (0xC0, 0xC5, 667),
    (0xC6, 0xC6, 1000), (0xC7, 0xC7, 722), (0xC8, 0xCB, 667), (0xCC, 0xCF, 278), (0xD1, 0xD1, 722), (0xD2, 0xD6, 778), (0xD9, 0xDC, 722),
    (0xDD, 0xDD, 667), (0xDF, 0xDF, 611), (0xE6, 0xE6, 889), (0xE7, 0xE7, 500), (0xEC, 0xEF, 278), (0xFD, 0xFD, 500), (0xFF, 0xFF, 500),
)
DEFAULT_WIDTH, COURIER_WIDTH = 556, 600
_WIDTHS = dict(enumerate(ASCII_WIDTHS, 0x20)) | {b: w for lo, hi, w in OTHER_WIDTHS for b in range(lo, hi + 1)}

#: Widths of the characters that have a byte.
CHARACTER_WIDTHS = {chr(c): _WIDTHS.get(b, DEFAULT_WIDTH) for b, c in [*((b, b) for b in (*range(0x20, 0x7F), *range(0xA0, 0x100))), *ANSI_EXTRA.items()]}


def ansi_byte(char: Column) -> Column:
    """Byte of a character in the Windows code page, null where it has none."""
    code = F.ascii(char)
    extra = F.try_element_at(F.create_map(*[F.lit(x) for b, c in ANSI_EXTRA.items() for x in (c, b)]), code)
    return F.when(((code >= 0x20) & (code <= 0x7E)) | ((code >= 0xA0) & (code <= 0xFF)), code).otherwise(extra)


def encodable(text: Column) -> Column:
    """The text without characters that have no byte."""
    return F.array_join(F.filter(F.split(text, ""), lambda c: (c != "") & ansi_byte(c).isNotNull()), "")


def char_width(char: Column) -> Column:
    """Thousandths of the font size."""
    table = F.create_map(*[F.lit(x) for b, w in _WIDTHS.items() for x in (b, w)])
    return F.coalesce(F.try_element_at(table, ansi_byte(char)), F.lit(DEFAULT_WIDTH))


def natural_width(text: Column, size: Column) -> Column:
    """Width of a text in Helvetica."""
    total = F.aggregate(F.filter(F.split(text, ""), lambda c: (c != "") & ansi_byte(c).isNotNull()), F.lit(0), lambda acc, c: acc + char_width(c))
    return size * total / 1000.0


def run_width(text: Column, family: Column, size: Column) -> Column:
    """Courier is of one width, other families are measured as Helvetica."""
    return F.when(family == "Courier", size * (F.length(encodable(text)) * COURIER_WIDTH) / 1000.0).otherwise(natural_width(text, size))


def horizontal_scale(natural: Column, wanted: Column) -> Column:
    """Percent that makes a text as wide as its box."""
    return F.when((natural <= 0) | (wanted <= 0), 100.0).otherwise(F.least(F.greatest(wanted / natural * 100.0, F.lit(1.0)), F.lit(1000.0)))


def appearance_style(da: Column) -> Column:
    """Font, size and colour of a default appearance string; the last operator wins."""
    from .labels import font_family, rgb_hex

    tokens = F.filter(F.split(da, r"(?U)\s+"), lambda t: t != "")
    empty = F.struct(F.lit(None).cast("string").alias("font"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("string").alias("color"))

    def step(tokens: Column, acc: Column, i: Column) -> Column:
        t = lambda k: F.get(tokens, i - k)
        num = lambda k: t(k).try_cast("double")
        op = t(0)
        gray = rgb_hex(num(1), num(1), num(1))
        rgb = rgb_hex(num(3), num(2), num(1))
        cmyk = rgb_hex(*[(1 - num(k)) * (1 - num(1)) for k in (4, 3, 2)])
        is_font = (op == "Tf") & (i >= 2)
        known = lambda color, *ks: F.when(F.least(*[num(k).isNotNull() for k in ks], F.lit(True)), color)
        color = F.when((op == "g") & (i >= 1), known(gray, 1)).when((op == "rg") & (i >= 3), known(rgb, 1, 2, 3)).when((op == "k") & (i >= 4), known(cmyk, 1, 2, 3, 4))
        name = F.when(F.startswith(t(2), F.lit("/")), font_family(t(2)))
        return F.struct(F.when(is_font, name).otherwise(acc["font"]).alias("font"), F.when(is_font, num(1)).otherwise(acc["size"]).alias("size"), F.coalesce(color, acc["color"]).alias("color"))

    def folded(tokens: Column) -> Column:
        places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, empty, lambda acc, i: step(tokens, acc, i))

    # The string is split once: what a lambda refers to is computed anew at each step unless it has a name.
    return F.transform(F.array(tokens), folded)[0]
