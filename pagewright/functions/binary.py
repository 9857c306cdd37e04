"""Parsers of bytes, as Arrow-batched functions over the standard library.

A parser takes bytes and returns a value or None for what it can't read; it never raises.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# Order in which a quantisation table is stored, as places row by row.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)
#: The standard luminance table, row by row.
STANDARD_LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
MOST_NESTING = 64


def over(f, returns: str):
    """A column function that applies ``f`` to each value; null in, null out."""

    @F.arrow_udf(returns)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], _ARROW[returns])

    return run


_ARROW = {"binary": pa.binary(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}


def inflate(data: bytes) -> bytes | None:
    """Zlib, else raw deflate."""
    for bits in (15, -15):
        try:
            return zlib.decompress(data, bits)
        except zlib.error:
            pass
    return None


def quantisation_table(segment: bytes, wanted: int = 0) -> list[int] | None:
    """The first table of that number in a segment, in row order; None if there is none
    before the segment ends or breaks off."""
    at = 0
    while at < len(segment):
        kind, number = divmod(segment[at], 16)
        body = segment[at + 1 : at + (129 if kind else 65)]
        if len(body) < (128 if kind else 64):
            return None
        if number == wanted:
            values = np.frombuffer(body, dtype=">u2" if kind else "u1")
            table = np.zeros(64, dtype=np.int64)
            table[list(ZIGZAG)] = values
            return table.tolist()
        at += 1 + len(body)
    return None


#: A marker of a JPEG with whatever stands before it: bytes that are none are passed over, and
#: any number of fill bytes may be in front of it.
_MARKER = re.compile(rb"\xff+([^\xff])", re.DOTALL)
#: Markers without contents, and those after which no table comes.
_ALONE, _LAST = {0x01, 0xD8, *range(0xD0, 0xD8)}, {0xD9, 0xDA}


def segments(jpeg: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and contents of the segments before the scan, as far as they are whole."""
    at = 2
    while found := _MARKER.search(jpeg, at):
        marker, at = found[1][0], found.end()
        if marker in _ALONE:
            continue
        size = int.from_bytes(jpeg[at : at + 2], "big")
        if marker in _LAST or size < 2 or at + size > len(jpeg):
            return
        yield marker, jpeg[at + 2 : at + size]
        at += size


def luminance_table(jpeg: bytes) -> list[int] | None:
    """The first table 0 of a JPEG."""
    if not jpeg.startswith(b"\xff\xd8"):
        return None
    tables = (quantisation_table(body) for marker, body in segments(jpeg) if marker == 0xDB)
    return next((t for t in tables if t is not None), None)


def jpeg_quality(jpeg: bytes) -> float | None:
    """The quality dial that scales the standard table to the one found. Entries are
    (standard * scale + 50) / 100, cut to 1..255; those that may have been cut tell nothing, and
    where there are no others there is no answer."""
    table = luminance_table(jpeg)
    scales = [(100.0 * t - 50.0) / s for t, s in zip(table or (), STANDARD_LUMINANCE) if 1 < t < 255]
    if not scales:
        return None
    scale = sum(scales) / len(scales)
    return min(100.0, max(1.0, (200.0 - scale) / 2.0 if scale <= 100.0 else 5000.0 / scale))


def ber_end(data: bytes, at: int = 0, depth: int = 0) -> int | None:
    """Where the value that starts at ``at`` ends; indefinite lengths are followed inside."""
    if depth > MOST_NESTING or at + 2 > len(data):
        return None
    first = data[at]
    at += 1
    if first & 31 == 31:
        while at < len(data) and data[at] & 128:
            at += 1
        at += 1
    if at >= len(data):
        return None
    size = data[at]
    at += 1
    if size == 128:
        if not first & 32:
            return None
        while data[at : at + 2] != b"\0\0":
            nxt = ber_end(data, at, depth + 1)
            if nxt is None:
                return None
            at = nxt
        return at + 2
    if size > 128:
        n = size & 127
        if at + n > len(data) or n > 8:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return at + size if at + size <= len(data) else None


def octets(data: bytes) -> bytes | None:
    """Contents of a whole octet string of definite length."""
    if data[:1] != b"\x04" or ber_end(data) != len(data):
        return None
    skip = 2 if data[1] < 128 else 2 + (data[1] & 127)
    return data[skip:]


def digest_spans(data: bytes, spans: list[int], algorithm: str) -> bytes | None:
    """Digest of two spans (offset, length, offset, length); None past the end."""
    a, b, c, d = spans
    if min(spans) < 0 or a + b > len(data) or c + d > len(data):
        return None
    return hashlib.new(algorithm, data[a : a + b] + data[c : c + d]).digest()


def swap_red_blue(pixels: bytes) -> bytes:
    """BGRA to RGBA."""
    p = np.frombuffer(pixels[: len(pixels) // 4 * 4], dtype=np.uint8).reshape(-1, 4)
    return p[:, [2, 1, 0, 3]].tobytes()


def crop(pixels: bytes, width: int, box: tuple[int, int, int, int]) -> bytes:
    """A window (x0, y0, x1, y1) of RGBA pixels."""
    x0, y0, x1, y1 = box
    return np.frombuffer(pixels, dtype=np.uint8).reshape(-1, width, 4)[y0:y1, x0:x1].tobytes()


def burn(pixels: bytes, width: int, boxes: list[tuple[int, int, int, int]]) -> bytes:
    """Windows of RGBA pixels made opaque black."""
    p = np.frombuffer(pixels, dtype=np.uint8).reshape(-1, width, 4).copy()
    for x0, y0, x1, y1 in boxes:
        p[y0:y1, x0:x1] = (0, 0, 0, 255)
    return p.tobytes()


def extent(counts: np.ndarray, least: int) -> tuple[int, int] | None:
    """First and last place that lie in two or more in a row of at least ``least``."""
    good = counts >= least
    pairs = np.flatnonzero(good[1:] & good[:-1])
    return (int(pairs[0]), int(pairs[-1]) + 1) if len(pairs) else None


#: A pixel is ink when its darkest channel is below DARK; a row or column has ink
#: when this share of it, one pixel at least, is.
DARK, SHARE = 200, 0.005


def enough(length: int, share: float = SHARE) -> int:
    """Pixels of ink that a row or column of so many pixels must have."""
    return max(1, int(np.ceil(length * share)))


def ink_box(pixels: bytes, width: int, dark: int = DARK, share: float = SHARE) -> list[int] | None:
    """Box of the rows and columns with enough pixels whose darkest channel is below ``dark``."""
    ink = np.frombuffer(pixels, dtype=np.uint8).reshape(-1, width, 4)[:, :, :3].min(axis=2) < dark
    height = ink.shape[0]
    rows = extent(ink.sum(axis=1), enough(width, share))
    columns = extent(ink.sum(axis=0), enough(height, share))
    return None if rows is None or columns is None else [columns[0], rows[0], columns[1] + 1, rows[1] + 1]


def displayed_widths(operators: list[tuple[str, list[float]]]) -> dict[str, float]:
    """Greatest width each drawn name has, following saved, restored and changed matrices."""
    now, saved, found = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], {}
    for name, args in operators:
        if name == "q":
            saved.append(now)
        elif name == "Q":
            now = saved.pop() if saved else now
        elif name == "cm":
            a, b, c, d, e, f = args
            A, B, C, D, E, G = now
            now = (a * A + b * C, a * B + b * D, c * A + d * C, c * B + d * D, e * A + f * C + E, e * B + f * D + G)
        elif name.startswith("Do "):
            found[name[3:]] = max(found.get(name[3:], 0.0), float(np.hypot(now[0], now[1])))
    return found
