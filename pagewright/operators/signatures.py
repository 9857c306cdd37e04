"""Signatures of documents as rows (doc_id, content, spans, blob, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.cms import cms_facts
from . import fields as O


def fresh_digest(algorithm, content, spans):
    """Digest of the two spans of the bytes, in hexadecimal; null past the end and for algorithms
    that aren't computed."""
    a, b, c, d = (F.element_at(spans, k) for k in (1, 2, 3, 4))
    part = lambda at, n: F.substring(content, (at + 1).cast("int"), n.cast("int"))
    covered = F.when((a + b <= F.octet_length(content)) & (c + d <= F.octet_length(content)), F.concat(part(a, b), part(c, d)))
    known = {"sha1": F.sha1(covered), **{f"sha{n}": F.sha2(covered, n) for n in (256, 384, 512)}}
    return F.coalesce(*[F.when(F.lower(F.replace(algorithm, F.lit("-"), F.lit(""))) == k, v) for k, v in known.items()])


def verified(signatures: DataFrame) -> DataFrame:
    """doc_id, signer, integrity and modified_after of each signature.

    Unknown wherever the check can't be made: no range of bytes, a message that isn't one, an
    algorithm that isn't computed, nothing sealed. Failed is only a digest that differs.
    """
    rows = signatures.withColumns({"spans": O.byte_range(F.col("spans")), "facts": cms_facts("blob")})
    algorithm = L.lookup(L.DIGESTS, F.col("facts.digest_oid"))
    sealed = F.lower(F.hex("facts.sealed"))
    fresh = fresh_digest(algorithm, F.col("content"), F.col("spans"))
    state = L.integrity(F.col("spans"), sealed, fresh, algorithm)
    after = F.coalesce(O.appended(F.col("spans"), F.octet_length("content")), F.lit(False))
    return rows.select("doc_id", F.coalesce("facts.signer", "name", F.lit("")).alias("signer"), state.alias("integrity"), after.alias("modified_after"))
