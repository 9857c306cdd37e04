"""Signed messages and the verdict on them. Signers are suppliers; messages are written here byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cms import cms_facts
from ..operators import signatures as S
from ..shipping import ship
from .registry import Book, table

book = Book()

# Object identifiers as they are written, in hexadecimal.
_SIGNED, _DATA, _DIGEST_ATTRIBUTE, _NAME = "06092A864886F70D010702", "06092A864886F70D010701", "06092A864886F70D010904", "0603550403"
_SHA256, _UNKNOWN = "0609608648016503040201", "06082A864886F70D0205"


def _tlv(tag: str, *inside: Column | str, open_end: bool = False) -> Column:
    """A value in hexadecimal, of definite or open length."""
    body = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in inside])
    if open_end:
        return F.concat(F.lit(tag + "80"), body, F.lit("0000"))

    def sized(body: Column) -> Column:
        n = (F.length(body) / 2).cast("long")
        size = F.when(n < 128, F.lpad(F.hex(n), 2, "0")).when(n < 256, F.concat(F.lit("81"), F.lpad(F.hex(n), 2, "0"))).otherwise(F.concat(F.lit("82"), F.lpad(F.hex(n), 4, "0")))
        return F.concat(F.lit(tag), size, body)

    # As a variable of a lambda the contents are in the expression once.
    return F.get(F.transform(F.array(body), sized), F.lit(0))


def signatures(spark, sf_dir) -> DataFrame:
    """Every fourth message is of open length, every fifth was changed after it was signed, every
    seventh seals nothing, every eleventh is of an unknown algorithm, every thirteenth is cut."""
    ship(spark)
    key, name = F.col("s_suppkey"), F.col("s_name")
    content = F.concat(F.lit("0123456789"), name, F.lit("<hole>"), name, F.lit("tail"))
    n = F.length("s_name").cast("long")
    start = F.lit(10).cast("long")
    spans = F.when(key % 17 != 0, F.array(start, n, start + n + 6, n + F.when(key % 3 == 0, 4).otherwise(0)))
    signed = F.concat(name, name, F.when(key % 3 == 0, "tail").otherwise(""), F.when(key % 5 == 0, "changed").otherwise(""))
    algorithm = _tlv("30", F.when(key % 11 == 0, _UNKNOWN).otherwise(_SHA256), "0500")
    sealed = _tlv("30", _DIGEST_ATTRIBUTE, _tlv("31", _tlv("04", F.upper(F.sha2(signed, 256)))))
    attributes = F.when(key % 7 != 0, _tlv("A0", _tlv("30", "06092A864886F70D010903", _tlv("31", _DATA)), sealed)).otherwise("")
    person = lambda text: _tlv("30", _tlv("31", _tlv("30", _NAME, _tlv("0C", F.hex(F.encode(text, "UTF-8"))))))
    certificate = _tlv("30", _tlv("30", _tlv("A0", "020102"), "020101", algorithm, person(F.lit("Issuer")), _tlv("30", "170130", "170131"), person(name), _tlv("30", algorithm)), algorithm, "030100")
    signer = _tlv("30", "020101", _tlv("30", person(F.lit("Issuer")), "020101"), algorithm, attributes, algorithm, _tlv("04", "AABB"))
    body = lambda open_end: _tlv("30", _SIGNED, _tlv("A0", _tlv("30", "020101", _tlv("31", algorithm), _tlv("30", _DATA, open_end=open_end), _tlv("A0", certificate), _tlv("31", signer), open_end=open_end), open_end=open_end), open_end=open_end)
    blob = F.when(key % 4 == 0, body(True)).otherwise(body(False))
    blob = F.when(key % 13 == 0, F.substring(blob, F.lit(1), F.lit(120))).otherwise(F.concat(blob, F.lit("00000000")))
    return table(spark, sf_dir, "supplier").select(key.alias("doc_id"), F.encode(content, "UTF-8").alias("content"), spans.alias("spans"), F.unhex(blob).alias("blob"), F.concat(F.lit("own "), name).alias("name"))


_SIGNED_TEXT = "s_name || s_name || CASE WHEN s_suppkey % 3 = 0 THEN 'tail' ELSE '' END"


@book.query(f"SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN '1.2.840.113549.2.5' ELSE '2.16.840.1.101.3.4.2.1' END AS digest_oid, CASE WHEN s_suppkey % 13 > 0 AND s_suppkey % 7 > 0 THEN sha256({_SIGNED_TEXT} || CASE WHEN s_suppkey % 5 = 0 THEN 'changed' ELSE '' END) END AS sealed, CASE WHEN s_suppkey % 13 > 0 THEN s_name END AS signer FROM supplier")
def h53_parse_cms(spark, sf_dir):
    rows = signatures(spark, sf_dir).select("doc_id", cms_facts("blob").alias("f"))
    return rows.select("doc_id", "f.digest_oid", F.lower(F.hex("f.sealed")).alias("sealed"), "f.signer")


@book.query("""SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 13 = 0 THEN 'own ' || s_name ELSE s_name END AS signer,
    CASE WHEN s_suppkey % 17 = 0 OR s_suppkey % 13 = 0 OR s_suppkey % 11 = 0 OR s_suppkey % 7 = 0 THEN 'unknown' WHEN s_suppkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS integrity, s_suppkey % 17 > 0 AND s_suppkey % 3 > 0 AS modified_after FROM supplier""")
def h52_verify_signatures(spark, sf_dir):
    return S.verified(signatures(spark, sf_dir))
