"""Exact token counts at every prefix of a text, for a BPE with word ends.

Texts are normalised and cut into words as the tokenizer's file says; a word's last symbol
carries the end mark. Within a word a table goes from left to right: of each prefix it keeps
the last token of its encoding without an end mark, which is the one token ending there that
may follow the last token of what is before it, as its length, and the number of tokens; from
these the count of the prefix as a word of its own follows by the tokens with an end mark.
Words share the rows of their first symbols; rows further on are kept by position, for one
word at a time, so that a word of any length takes memory and time in proportion. A text's
table is the running sum over its words, so truncation and budget questions are look-ups.

The library's part is its normaliser, for one piece between blanks at a time; it counts
nothing. Special strings are tokens of their own.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import MOST_PIECES, SPACE, Borders, Pieces
from .shingles import pieces
from .workers import resident

#: A text with more tokens is over the limit.
LIMIT = 2048
#: Rows of a word's first symbols, so many, are shared.
SHORT = 6


def _byte_symbols() -> dict[int, str]:
    """The printable stand-ins of byte-level tokenizers: printable Latin-1 for itself, the
    others, in order, from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTable:
    """Prefix counts of single words, by the merges of a tokenizer file."""

    def __init__(self, model: dict):
        self.mark = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocabulary = model["vocab"]
        self.longest = max(len(t.removesuffix(self.mark)) for t in self.vocabulary)
        # Greatest length of tokens without and with an end mark, by their last three symbols.
        self.reach: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for token in self.vocabulary:
            plain = token.removesuffix(self.mark)
            known = self.reach[plain != token]
            known[plain[-3:]] = max(known.get(plain[-3:], 0), len(plain))
        self.symbol = _byte_symbols()
        self.heads: dict[str, tuple[array, array]] = {}
        self.borders = Borders(lambda a, b: self.rank.get((a, b)), self._symbols)

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.mark):
            token = token.removesuffix(self.mark)
            return [*token[:-1], token[-1] + self.mark]
        return list(token)

    def _row(self, word: str, n: int, end: bool, lengths: array, numbers: array, shift: int = 0) -> tuple[int, int]:
        """Length of the last token and number of tokens of a word's first n symbols; the
        rows of shorter prefixes are in the arrays. ``word`` may lack its first ``shift`` symbols."""
        last = n - shift
        reach = self.reach[end]
        longest = reach.get(word[max(0, last - 3) : last], 2) if n > 2 else n
        for k in range(min(n, max(longest, 2)), 0, -1):
            token = word[last - k : last] + self.mark if end else word[last - k : last]
            if token in self.vocabulary:
                at = n - k
                if not at:
                    if self.borders.halved(token) is not None:
                        return k, 1
                elif self.borders.may_follow(word[last - k - lengths[at] : last - k], token):
                    return k, numbers[at] + 1
        raise ValueError(f"no encoding ends {word[max(0, last - self.longest) : last]!r}")

    def _rows(self, word: str, upto: int) -> tuple[array, array]:
        """Length of the last token, without an end mark, and number of tokens of the prefixes
        of up to so many symbols."""
        head = word[: min(upto, SHORT)]
        known = self.heads.get(head)
        if known is None:
            if len(self.heads) > MOST_PIECES:
                self.heads.clear()
            known = self.heads[head] = array("L", (0,)), array("L", (0,))
            self._fill(head, len(head), *known)
        lengths, numbers = known[0][:], known[1][:]
        self._fill(word, upto, lengths, numbers)
        return lengths, numbers

    def _fill(self, word: str, upto: int, lengths: array, numbers: array) -> None:
        for n in range(len(lengths), upto + 1):
            k, number = self._row(word, n, False, lengths, numbers)
            lengths.append(k)
            numbers.append(number)

    def count(self, word: str) -> int:
        """Tokens of a whole word, given in byte symbols."""
        return self._row(word, len(word), True, *self._rows(word, len(word) - 1))[1]


class OpenWord:
    """A word that grows symbol by symbol: its rows, and its last symbols."""

    def __init__(self, table: WordTable):
        self.table = table
        self.tail, self.n = "", 0
        self.lengths, self.numbers = array("L", (0,)), array("L", (0,))

    def add(self, symbols: str) -> None:
        for symbol in symbols:
            if self.n:  # the row of what was the end until now
                self._append()
            self.tail = (self.tail + symbol)[-2 * self.table.longest :]
            self.n += 1

    def _append(self) -> None:
        k, number = self.table._row(self.tail, self.n, False, self.lengths, self.numbers, self.n - len(self.tail))
        self.lengths.append(k)
        self.numbers.append(number)

    def count(self) -> int:
        """Tokens, were this the whole word."""
        return self.table._row(self.tail, self.n, True, self.lengths, self.numbers, self.n - len(self.tail))[1] if self.n else 0

    def mark(self) -> tuple[str, int]:
        return self.tail, self.n

    def back_to(self, mark: tuple[str, int]) -> None:
        self.tail, self.n = mark
        del self.lengths[max(1, self.n) :], self.numbers[max(1, self.n) :]


#: What may follow an apostrophe to make a word of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Growing:
    """A piece of text that grows character by character, with the tokens it has so far.

    Normalisation only joins characters of one block, a character and those behind it that may
    combine with it: the state at the block's start is gone back to when a block grows.
    """

    def __init__(self, counter: PrefixCounter):
        self.counter = counter
        self.block = ""
        self.done, self.word, self.kind = 0, OpenWord(counter.table), ""
        self.start = self._state()

    def _state(self) -> tuple:
        return self.done, self.word, self.word.mark(), self.kind

    def add(self, char: str) -> int:
        """Tokens of the piece with this character at its end."""
        if char in self.counter.joining():
            self.done, self.word, mark, self.kind = self.start
            self.word.back_to(mark)
            self.block += char
        else:
            self.start, self.block = self._state(), char
        for c in self.counter.normal(self.block):
            self._push(c)
        return self.done + self._open()

    def _open(self) -> int:
        """Tokens of the word that is open; an apostrophe and a letter that may go on are two words."""
        if self.kind in ("'r", "'v", "'l"):
            return self.counter.word_count("'") + self.counter.word_count(self.kind[1])
        return self.word.count()

    def _begin(self, c: str, kind: str) -> None:
        self.done += self._open()
        self.word, self.kind = OpenWord(self.counter.table), kind
        self.word.add(self.counter.symbols(c))

    def _push(self, c: str) -> None:
        kind = self.kind
        if kind == "'" and c in ("s", "t", "m", "d") or kind + c in ("'re", "'ve", "'ll"):
            self.word, self.kind = OpenWord(self.counter.table), "closed"
            self.word.add(self.counter.symbols((kind + c)))
            return
        if kind == "'" and c in ("r", "v", "l"):
            self.kind = kind + c
            return
        if kind in ("'r", "'v", "'l"):
            # No ending after all: the apostrophe was a word and its letter begins one.
            self.kind = "other"
            self._begin(kind[1], "letters")
        of = self.counter.kind_of(c)
        if of == self.kind and of != "digit" or of == "other" and self.kind == "'":
            self.kind = of
            self.word.add(self.counter.symbols(c))
        else:
            self._begin(c, "'" if c == "'" else of)


class PrefixCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normaliser = Tokenizer.from_file(path).normalizer
        self.table = WordTable(spec["model"])
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.hint = os.path.commonprefix(special) if special else ""
        self.piece = regex.compile(f"[^{SPACE}]+")
        self.words = Pieces(self._count)
        self.counted = Pieces(lambda word: self.table.count(self.symbols(word)))
        self.kinds = Pieces(lambda c: "letters" if regex.match(r"\p{L}", c) else "digit" if regex.match(r"\p{N}", c) else "other")
        self.kind_of, self.word_count = self.kinds.__getitem__, self.counted.__getitem__
        self._joining: frozenset[str] | None = None

    def symbols(self, word: str) -> str:
        return "".join(map(self.table.symbol.__getitem__, word.encode()))

    def normal(self, piece: str) -> str:
        return self.normaliser.normalize_str(piece)

    def joining(self) -> frozenset[str]:
        """Characters that may change with what is before them: combining ones, and second ones
        of compositions."""
        if self._joining is None:
            found = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
            for c in map(chr, range(0x110000)):
                if unicodedata.combining(c):
                    found.add(c)
                parts = unicodedata.decomposition(c).split()
                if len(parts) == 2 and parts[0][0] != "<":
                    found.add(chr(int(parts[1], 16)))
            self._joining = frozenset(found)
        return self._joining

    def _count(self, piece: str) -> int:
        """Tokens of a piece of text without white space or special strings."""
        return sum(map(self.counted.__getitem__, self.pattern.findall(self.normal(piece))))

    def _pieces(self, text: str) -> list[str]:
        """Pieces between white space, and special strings."""
        if self.hint and self.hint in text and self.special.search(text):
            out, at = [], 0
            for found in self.special.finditer(text):
                out += [*self.piece.findall(text, at, found.start()), found[0]]
                at = found.end()
            return out + self.piece.findall(text, at)
        if text.replace("\n", " ").replace("\t", " ").replace("\r", " ").isprintable():
            return text.split()
        return self.piece.findall(text)

    def _tokens(self, piece: str) -> int:
        return 1 if self.special and self.special.fullmatch(piece) else self.words[piece]

    def running(self, text: str) -> tuple[list[str], np.ndarray]:
        """The text's pieces and the tokens up to the end of each."""
        if len(self.words) > MOST_PIECES:
            self.words.clear()
        if len(self.counted) > MOST_PIECES:
            self.counted.clear()
        found = self._pieces(text)
        get = self._tokens if self.hint and self.hint in text else self.words.__getitem__
        return found, np.cumsum(np.fromiter(map(get, found), dtype=np.int64, count=len(found)))

    def count(self, text: str) -> int:
        upto = self.running(text)[1]
        return int(upto[-1]) if len(upto) else 0

    def prefix_table(self, text: str) -> list[int]:
        """Tokens of text[:0], text[:1], ... text[:len(text)], each exactly, from left to right:
        time is in proportion to the text (and to the square of a run of combining marks)."""
        out, at, before = [0], 0, 0
        growing = Growing(self)
        for piece in self._pieces(text):
            start = text.index(piece, at)
            if start > at:
                out += [out[-1]] * (start - at)
                before, growing = out[-1], Growing(self)
            if self.special and self.special.fullmatch(piece):
                # Until its last character a special string is text like other text.
                full = out[-1] + 1
                out += [before + growing.add(c) for c in piece[:-1]]
                out.append(full)
                before, growing = full, Growing(self)
            else:
                out += [before + growing.add(c) for c in piece]
            at = start + len(piece)
        return out + [out[-1]] * (len(text) - at)

    def truncate(self, text: str, budget: int) -> int:
        """Code points of the longest cut whose text has at most ``budget`` tokens; blanks after
        the last piece are left out. Only the piece that passes the budget is read by character."""
        found, upto = self.running(text)
        k = bisect_right(upto.tolist(), budget)
        starts, at = [], 0
        for piece in found[: k + 1]:
            starts.append(text.index(piece, at))
            at = starts[-1] + len(piece)
        if k == len(found):
            return at
        end = at - len(found[k])
        cut = starts[k - 1] + len(found[k - 1]) if k else 0
        # A special string that is cut belongs to the text before it, down to the last blank or special string.
        first = k
        if self.special and self.special.fullmatch(found[k]):
            while first and starts[first - 1] + len(found[first - 1]) == starts[first] and not self.special.fullmatch(found[first - 1]):
                first -= 1
        left = budget - (int(upto[first - 1]) if first else 0)
        growing = Growing(self)
        for i, c in enumerate(text[starts[first] : at - (first < k or bool(self.special and self.special.fullmatch(found[k])))], starts[first] + 1):
            if growing.add(c) <= left and i > end:
                cut = i
        return cut


def prefix_counter(path: str) -> PrefixCounter:
    """One per Python worker."""
    return resident(("prefixes", path), lambda: PrefixCounter(path))


def count_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row: the last entry of the text's table.

    Null text counts as empty: no bytes, no tokens. One row out per row in; an empty table
    gives no rows; other columns are ignored. ``path`` must be readable on executors.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            for at, to in pieces(batch.column(1)):
                b = batch.slice(at, to - at)
                texts = [t or "" for t in b.column(1).to_pylist()]
                n = [counter.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
