"""Codes to labels, and numbers to short texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels.
REASONS = {
    "bilevel": "black & white",
    "indexed": "indexed color",
    "colorspace": "unsupported color",
    "predictor": "predictor",
    "decode_array": "custom decode array",
    "ccitt": "CCITT/fax",
    "jpx": "JPEG2000",
    "jbig2": "JBIG2",
    "crypt": "encrypted",
    "unsupported_filter": "unsupported filter",
    "decode": "unreadable",
    "unreferenced": "not displayed",
}
FILTERS = {"DCTDecode": "JPEG", "JPXDecode": "JPEG 2000", "FlateDecode": "Flate", "LZWDecode": "LZW", "CCITTFaxDecode": "CCITT fax", "JBIG2Decode": "JBIG2", "RunLengthDecode": "run-length"}
GLOSSES = {"PDF/A": "archiving", "PDF/X": "print", "PDF/UA": "accessibility", "PDF/E": "engineering"}
BADGES = {"verified": ("Verified Signed Document", "ok"), "modifiedAfter": ("Signed — modified after signing", "warn"), "invalid": ("Signed — signature is invalid", "warn"), "unknown": ("Signed — not verified here", "info")}
FONT_STACKS = {"Times": '"Times New Roman", Times, serif', "Courier": '"Courier New", Courier, monospace'}
DIGESTS = {
    "1.3.14.3.2.26": "sha1",
    "1.2.840.113549.1.1.5": "sha1",
    "2.16.840.1.101.3.4.2.1": "sha256",
    "1.2.840.113549.1.1.11": "sha256",
    "2.16.840.1.101.3.4.2.2": "sha384",
    "1.2.840.113549.1.1.12": "sha384",
    "2.16.840.1.101.3.4.2.3": "sha512",
    "1.2.840.113549.1.1.13": "sha512",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a literal table, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def reason_label(reason: Column) -> Column:
    """H58"""
    return F.coalesce(lookup(REASONS, reason), reason)


def filter_label(filters: Column) -> Column:
    """Filters joined by +; none is 'uncompressed'."""
    parts = F.transform(F.split(filters, r"\+"), lambda f: F.coalesce(lookup(FILTERS, f), f))
    return F.when(filters == "", "uncompressed").otherwise(F.array_join(parts, " + "))


def describe_claim(code: Column) -> Column:
    """H60"""
    out = code
    for prefix, gloss in reversed(GLOSSES.items()):
        out = F.when(F.startswith(code, F.lit(prefix)), F.concat(code, F.lit(f" ({gloss})"))).otherwise(out)
    return out


def signature_badge(status: Column) -> tuple[Column, Column]:
    """Text and kind, null for unsigned."""
    return tuple(lookup({k: v[i] for k, v in BADGES.items()}, status) for i in (0, 1))


def describe_signature(signer: Column, integrity: Column, modified: Column) -> Column:
    """H61, one signature."""
    state = F.when(integrity == "failed", "signature is invalid (document altered)").when(integrity == "unknown", "present — not verified here").when(modified, "intact, but modified after signing").otherwise("intact")
    who = F.when(F.coalesce(signer, F.lit("")) == "", "Unknown signer").otherwise(signer)
    return F.concat(F.lit("Signed by "), who, F.lit(" — "), state)


def aggregate_status(n: Column, failed: Column, unknown: Column, modified: Column) -> Column:
    """Of a document's signatures, from their number and whether any is so."""
    return F.when(n == 0, "unsigned").when(failed, "invalid").when(unknown, "unknown").when(modified, "modifiedAfter").otherwise("verified")


def integrity(byte_range: Column, sealed: Column, computed: Column, algorithm: Column) -> Column:
    """What can't be checked is unknown, never failed."""
    missing = byte_range.isNull() | sealed.isNull() | computed.isNull() | algorithm.isNull()
    return F.when(missing, "unknown").when(sealed == computed, "ok").otherwise("failed")


def format_bytes(n: Column) -> Column:
    """H55"""
    kb, mb = F.format_string("%.1f KB", n / 1024.0), F.format_string("%.2f MB", n / 1048576.0)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)


def percent_reduction(before: Column, after: Column) -> Column:
    """H56"""
    return F.when(before <= 0, "0%").otherwise(F.format_string("%.1f%%", (before - after) / F.nullif(before, F.lit(0)).cast("double") * 100))


def suggest_name(name: Column) -> Column:
    """The name without its last extension, unless that is all of it."""
    return F.concat(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1"), F.lit("-compressed.pdf"))


def font_stack(family: Column) -> Column:
    """H82"""
    return F.coalesce(lookup(FONT_STACKS, family), F.lit("Arial, Helvetica, sans-serif"))


def base_font(family: Column, bold: Column, italic: Column) -> Column:
    """One of the twelve base fonts."""
    name = F.when(family.isin("Times", "Courier"), family).otherwise("Helvetica")
    lean = F.when(italic, F.when(name == "Times", "Italic").otherwise("Oblique")).otherwise("")
    style = F.concat(F.when(bold, "Bold").otherwise(""), lean)
    return F.when(style != "", F.concat(name, F.lit("-"), style)).when(name == "Times", "Times-Roman").otherwise(name)


def font_family(name: Column) -> Column:
    """Null for an unknown font name."""
    n = F.lower(name)
    has = lambda *s: F.greatest(*[F.contains(n, F.lit(x)) for x in s]) if len(s) > 1 else F.contains(n, F.lit(s[0]))
    return F.when(has("helv", "arial"), "Helvetica, Arial, sans-serif").when(has("tiro", "times"), "'Times New Roman', Times, serif").when(has("cour"), "'Courier New', Courier, monospace")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """Each channel clamped to 0..1."""
    two = lambda v: F.lower(F.lpad(F.hex(F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5)), 2, "0"))
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def channel(hex_color: Column, at: int) -> Column:
    """The channel, 0..255, whose digits begin at place ``at`` of #rrggbb; null if it isn't one."""
    return F.try_to_number(F.conv(F.substring(hex_color, at, 2), 16, 10), F.lit("999")).cast("int")


def hex_rgb(color: Column) -> Column:
    """Three channels in 0..1, black for anything else."""
    plain = F.regexp_extract(F.trim(color), "(?i)^#?([0-9a-f]{6})$", 1)
    parts = F.array(*[F.conv(F.substring(plain, at, 2), 16, 10).cast("int") / 255.0 for at in (1, 3, 5)])
    return F.when(plain != "", parts).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def contrast_color(color: Column) -> Column:
    """Dark text on light colours."""
    v = [F.conv(F.substring(color, at, 2), 16, 10).cast("int") for at in (2, 4, 6)]
    return F.when((0.299 * v[0] + 0.587 * v[1] + 0.114 * v[2]) / 255 > 0.55, "#1a1a1a").otherwise("#ffffff")


def quadding(q: Column) -> Column:
    """H15"""
    return F.when(q == 1, "center").when(q == 2, "right").otherwise("left")


def pdf_date(raw: Column) -> Column:
    """A PDF date as text, its offset kept; anything else unchanged.

    A date is a year of four digits and up to five more numbers of two; what comes after them
    may be the offset from UTC: a sign or Z, hours, and minutes set off by apostrophes.
    """
    s = date_body(raw)
    digits = F.least(F.length(F.regexp_extract(s, "^[0-9]*", 0)), F.lit(14))
    numbers = F.floor((digits - 4) / 2).cast("int")  # after the year
    two = lambda at: F.substring(s, at, F.lit(2))
    number = lambda k, default: F.when(numbers >= k, two(F.lit(3 + 2 * k))).otherwise(default)
    month = number(1, "01").cast("int")
    day = F.concat(F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1), F.lit(" "), number(2, "01").cast("int").cast("string"), F.lit(", "), F.substring(s, 1, 4))
    after = 5 + 2 * numbers
    sign = F.substring(s, after, F.lit(1))
    whole = lambda x: F.rlike(x, F.lit("^[0-9]{2}$"))
    hours = F.when(whole(two(after + 1)), two(after + 1))
    rest = after + 1 + F.when(hours.isNull(), 0).otherwise(2)
    rest = rest + F.when(F.substring(s, rest, F.lit(1)) == "'", 1).otherwise(0)
    minutes = F.when(whole(two(rest)), two(rest))
    offset = F.concat(F.lit(" UTC"), sign, F.coalesce(hours, F.lit("00")), F.lit(":"), F.coalesce(minutes, F.lit("00")))
    zone = F.when(sign == "Z", " UTC").when(sign.isin("+", "-"), offset).otherwise("")
    clock = F.when(numbers >= 3, F.concat(F.lit(" at "), number(3, "00"), F.lit(":"), number(4, "00"), F.lit(":"), number(5, "00"), zone)).otherwise("")
    return F.when((digits < 4) | (month < 1) | (month > 12), raw).otherwise(F.concat(day, clock))


def date_body(s: Column) -> Column:
    """H33"""
    return F.regexp_replace(s, "^D:", "")
