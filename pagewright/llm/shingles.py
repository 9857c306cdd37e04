"""Word and shingle hashes of whole batches of text, vectorised over their bytes.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text; ASCII punctuation, white space, U+0080-U+00BF, U+2000-U+207F and
U+3000-U+303F separate words. A shingle is five words in a row. A text of one to four
words has one shingle, all of its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS_PER_SHINGLE = 5
#: Texts are hashed in pieces of about so many bytes: memory is a fixed multiple of this
#: (and of the longest single text), whatever the size of an Arrow batch.
PIECE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORD[128:] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << (max(n, 2) - 1).bit_length(), 1 << 16)
        have = np.full(size, base & ((1 << 64) - 1), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each (one row at least)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and their ends by row: row i has [ends[i-1], ends[i]).

    Null texts count as empty.
    """
    rows = len(texts)
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lengths = np.asarray(pc.binary_length(low), dtype=np.int64)
    stops = np.cumsum(lengths)
    first = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset]
    total = int(stops[-1]) if rows else 0
    if not total:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    b = np.frombuffer(low.buffers()[2], dtype=np.uint8)[first : first + total]
    word = _WORD[b]
    for lead, seconds, size in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(b == lead)
        at = at[at + size <= total]
        if seconds:
            at = at[np.isin(b[at + 1], seconds)]
        for k in range(size):
            word[at + k] = False
    # Word boundaries: a word starts after a separator or at the start of a row.
    before = np.empty(total, dtype=bool)
    before[0], before[1:] = False, word[:-1]
    row_starts = stops - lengths
    before[row_starts[lengths > 0]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    after = np.empty(total, dtype=bool)
    after[-1], after[:-1] = False, word[1:]
    after[stops[lengths > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * _power(_BASE, total), out=sums[1:])
    words = mix64((sums[ends] - sums[starts]) * _power(_INVERSE, total)[starts])
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], stops))))
    word_ends = np.cumsum(counts)
    n_shingles = np.where(counts >= WORDS_PER_SHINGLE, counts - WORDS_PER_SHINGLE + 1, np.minimum(counts, 1))
    shingle_ends = np.cumsum(n_shingles)
    # The place of each shingle's first word.
    row = np.repeat(np.arange(rows), n_shingles)
    place = np.arange(len(row)) - (shingle_ends - n_shingles)[row] + (word_ends - counts)[row]
    last = word_ends[row]
    out = np.zeros(len(row), dtype=np.uint64)
    for k in range(WORDS_PER_SHINGLE):
        at = place + k
        there = at < last
        w = words[np.minimum(at, len(words) - 1)]
        out = mix64(out ^ w) if there.all() else np.where(there, mix64(out ^ w), out)
    return out, shingle_ends
