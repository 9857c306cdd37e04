"""Signed messages (CMS): what the integrity check needs of them, read from BER or DER bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import MOST_NESTING, ber_end

# Object identifiers.
SIGNED_DATA, MESSAGE_DIGEST, COMMON_NAME = "1.2.840.113549.1.7.2", "1.2.840.113549.1.9.4", "2.5.4.3"
#: Tags.
INTEGER, OCTETS, OID, SEQUENCE, SET, FIRST, SECOND = 0x02, 0x04, 0x06, 0x30, 0x31, 0xA0, 0xA1
#: Encodings of the kinds of text that names are written in, by tag.
TEXTS = {0x0C: "utf-8", 0x13: "ascii", 0x14: "latin-1", 0x16: "ascii", 0x1E: "utf-16-be"}
FACTS = "struct<digest_oid:string,sealed:binary,signer:string>"


def children(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Tag and contents of each value in a row of values; stops at one that isn't whole."""
    at = 0
    while at < len(data) and data[at : at + 2] != b"\0\0":
        end = ber_end(data, at)
        if end is None:
            return
        head = at + 1
        if data[at] & 31 == 31:  # a tag of several bytes: all but the last have the high bit
            while data[head] & 128:
                head += 1
            head += 1
        size, head = data[head], head + 1
        if size == 128:
            yield data[at], data[head : end - 2]
        else:
            yield data[at], data[head + (size & 127 if size > 128 else 0) : end]
        at = end


def oid(contents: bytes) -> str:
    """An object identifier in its dotted form."""
    numbers, n = [], 0
    for b in contents:
        n = n << 7 | b & 127
        if not b & 128:
            numbers.append(n)
            n = 0
    if not numbers:
        return ""
    top = min(numbers[0] // 40, 2)
    return ".".join(map(str, [top, numbers[0] - 40 * top, *numbers[1:]]))


def common_name(data: bytes, depth: int = 0) -> str | None:
    """The first common name in a row of values."""
    if depth > MOST_NESTING:
        return None
    inside = list(children(data))
    if len(inside) == 2 and inside[0][0] == OID and oid(inside[0][1]) == COMMON_NAME and inside[1][0] in TEXTS:
        return inside[1][1].decode(TEXTS[inside[1][0]], "replace")
    for tag, contents in inside:
        if tag & 32 and (found := common_name(contents, depth + 1)) is not None:
            return found
    return None


def subject_name(certificate: bytes) -> str | None:
    """Common name of a certificate's subject: the second of the names in its signed part, after
    the issuer's and the dates."""
    fields = [c for tag, c in children(next((c for tag, c in children(certificate) if tag == SEQUENCE), b"")) if tag == SEQUENCE]
    return common_name(fields[3]) if len(fields) > 3 else None


def facts(blob: bytes) -> dict | None:
    """Digest algorithm of the first signer, the digest its signed attributes seal, and the
    first common name of a certificate; None for what isn't a signed message. Bytes after the
    message are padding."""
    top = dict(list(children(blob))[:1]).get(SEQUENCE)
    if top is None:
        return None
    outer = list(children(top))
    if [t for t, _ in outer[:2]] != [OID, FIRST] or oid(outer[0][1]) != SIGNED_DATA:
        return None
    signed = [c for t, c in children(outer[1][1]) if t == SEQUENCE]
    if not signed:
        return None
    rows = list(children(signed[0]))
    sets = [c for t, c in rows if t == SET]
    signer = next((c for t, c in children(sets[-1]) if t == SEQUENCE), None) if len(sets) > 1 else None
    if signer is None:
        return None
    info = list(children(signer))
    # Version, who signed (a name and number, or a key), the digest's algorithm, attributes.
    algorithms = [c for t, c in info[2:] if t == SEQUENCE]
    digest = next((c for t, c in children(algorithms[0]) if t == OID), None) if algorithms else None
    if digest is None:
        return None
    sealed = None
    for tag, contents in info[3:4]:
        if tag == FIRST:
            for _, attribute in children(contents):
                values = list(children(attribute))
                if len(values) > 1 and values[0][0] == OID and oid(values[0][1]) == MESSAGE_DIGEST:
                    first = next(children(values[1][1]), None)
                    sealed = first[1] if first and first[0] == OCTETS else None
                    break
    certificates = next((c for t, c in rows if t == FIRST), b"")
    names = (subject_name(c) for t, c in children(certificates) if t == SEQUENCE)
    return {"digest_oid": oid(digest), "sealed": sealed, "signer": next((n for n in names if n is not None), None)}


def cms_facts(blob: Column | str) -> Column:
    """`facts` of each blob; null in, null out."""

    @F.arrow_udf(FACTS)
    def run(blobs: pa.Array) -> pa.Array:
        kind = pa.struct([("digest_oid", pa.string()), ("sealed", pa.binary()), ("signer", pa.string())])
        return pa.array([None if b is None else facts(b) for b in blobs.to_pylist()], kind)

    return run(blob)
