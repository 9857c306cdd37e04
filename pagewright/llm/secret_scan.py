r"""Secret scans: fixed patterns, and an assignment-aware lexer.

Patterns, leftmost and non-overlapping per kind (spans are code points, end exclusive):
``assign`` a sensitive word, a separator and a value of six or more characters; ``access`` an
access key id of twenty or more; ``hex`` a run of twenty-four or more lower-case hex digits.

The lexer adds ``named``: it reads source and configuration syntax into pairs of a name and
a literal or another name (`pairs`), follows names to the constants they stand for, and
scores each literal by how sensitive the names are that it ends up in and by how little it
looks like a word or placeholder.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import pieces

KINDS = ("assign", "access", "hex", "named")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: What the parts of a name are worth; the most sensitive pair or single part counts.
PARTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "bearer": 0.8, "auth": 0.6}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("client", "secret"): 1.0, ("connection", "string"): 0.7}
#: One of these is in every name that is worth something.
_HINTS = tuple(PARTS.keys() | {b for _, b in PAIRS})
#: A literal is reported when its name's worth times its own reaches this.
THRESHOLD = 0.5
# Matched at a literal's start; literals hold no line feed.
_PLACEHOLDER = re.compile(r"(?i)(?:(?:x+|\*+|\.+|none|null|true|false|changeme)$|example|placeholder|your[-_ ])")
_BRACKETS = (("<", ">"), ("${", "}"), ("{{", "}}"), ("%", "%"))

#: Strings, which may hold assignments themselves, and separators. A quote inside a word is
#: an apostrophe; strings in single quotes of either kind end on their line.
_STRINGS = r"""\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\n]*+`"""
_TOKEN = re.compile(r"(?<![^\W_])[\"'`]|(:=|=>|=(?![=:])|:(?![=:-]))")
#: A name before a separator, in the text read backwards: quoted, an index, or bare.
_NAME = re.compile(r"""\n?[ \t]*+(?:(["'])\\?([\w.$-]++)\1\\?|\][ \t]*+(?:(["'])([\w.$-]++)\3|([\w.$-]++))[ \t]*+\[|([\w.$-]++))""", re.ASCII)
#: What makes the name before it a type: the name that has the type, backwards.
_TYPED = re.compile(r"""[ \t]*+:(?![:=])[ \t]*+([\w.$-]++)""", re.ASCII)
#: Blanks, brackets and line ends between a separator and its value. A value on the next line
#: stands alone there.
_GAP = re.compile(r"""[ \t]*+(?:\([ \t]*+)?(?:(?:\\|[|>][+-]?)?[ \t]*+\r?(\n)\s*+)?(?:[rbfuRBFU]{1,2}(?=["']))?""")
_QUOTED = re.compile(_STRINGS, re.DOTALL)
_ESCAPED = re.compile(r"""\\(["'])([^"'\\\n]*+)\\\1""")
#: What joins a string with one before it, outside and inside a bracket.
_JOINED = re.compile(r"""[ \t]*+(?:[+.][ \t]*+(?:\\?\r?\n[ \t]*+)?|\\\r?\n[ \t]*+|\r?\n[ \t]*+[+.][ \t]*+)?(?=["'`])""")
_JOINED_INSIDE = re.compile(r"""\s*+(?:[+.]\s*+)?(?=["'`])""")
#: A value that stands for another name, with what it is without that name.
_REFERENCE = re.compile(r"""\$\{([A-Za-z_][\w.]*+)(?::?[-=]([^}\n]*+))?\}|\$([A-Za-z_]\w*+)(?!\S)|\{\{\s*+[.]?([A-Za-z_][\w.]*+)\s*+\}\}|%([A-Za-z_]\w*+)%|\$\(([A-Za-z_]\w*+)\)""", re.ASCII)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
#: A call or index with a string as what it is about: of the environment, of a table.
_ABOUT = re.compile(rf"""[ \t]*+[(\[][ \t]*+({_STRINGS})(?:[ \t]*+,[ \t]*+({_STRINGS}))?""", re.DOTALL)
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w.$-]*", re.ASCII)
_ALONE = re.compile(r"[ \t]*+[);,]?[ \t]*+\r?(?:\n|\Z)")
_TAG = re.compile(r"<([A-Za-z_][\w.:-]*+)((?:\s[^<>]*+)?)>([^<>]*+)(</)?", re.ASCII)
_ATTRIBUTE = re.compile(r"""([\w.:-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""", re.ASCII)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]")


class Pair(NamedTuple):
    """A name, the place of the literal it is given, and the name it is given instead, if any:
    one that the literal stands for only if it is ``sure`` or assigned somewhere."""

    name: str
    start: int
    end: int
    quoted: bool
    refers: str | None = None
    sure: bool = False


def _inside(text: str, start: int, end: int) -> tuple[int, int]:
    """Of a string with its quotes, the place of what is in it."""
    k = 3 if end - start >= 6 and text[start] * 3 == text[start : start + 3] == text[end - 3 : end] else 1
    return start + k, end - k


def _references(name: str, text: str, start: int, end: int) -> Iterator[Pair]:
    """The value of ``name`` as a reference, if it is one, and its default."""
    if not (m := _REFERENCE.fullmatch(text, start, end)):
        return
    yield Pair(name, start, end, True, next(x for x in (m[1], m[3], m[4], m[5], m[6]) if x), True)
    if m[2]:
        yield Pair(name, m.start(2), m.end(2), True)


class _Values:
    """Values behind separators, read forward. A run of bare characters that holds separators
    is the end of several values; its end is kept, so that it is read once. A quote that isn't
    closed leaves the rest of its line (for three quotes, of the text) without strings of its
    kind, so that this too is found once."""

    def __init__(self, text: str):
        self.text, self.bare = text, 0
        self.unclosed: dict[str, int] = {}

    def string(self, at: int, end: int) -> re.Match | None:
        """The string that begins here and is closed before ``end``."""
        text = self.text
        if at >= end or text[at] not in "\"'`":
            return None
        kind = text[at] * 3 if text.startswith(text[at] * 3, at) else text[at]
        if at < self.unclosed.get(kind, 0):
            return None
        found = _QUOTED.match(text, at, end)
        if not found or len(kind) == 3 and found.end() - at < 6:
            line = text.find("\n", at, end) if len(kind) == 1 else -1
            self.unclosed[kind] = end if line < 0 else line
        return found

    def quoted(self, name: str, start: int, end: int) -> Iterator[Pair]:
        start, end = _inside(self.text, start, end)
        found = list(_references(name, self.text, start, end))
        yield from found or [Pair(name, start, end, True)]

    def about(self, name: str, call: re.Match) -> Iterator[Pair]:
        """What a call or index is about: a name if it may be one, with its default, else a literal."""
        start, end = _inside(self.text, call.start(1), call.end(1))
        if _IDENTIFIER.fullmatch(self.text, start, end):
            yield Pair(name, start, end, True, self.text[start:end])
        else:
            yield Pair(name, start, end, True)
        if call[2]:
            yield Pair(name, *_inside(self.text, call.start(2), call.end(2)), True)

    def of(self, name: str, at: int, end: int) -> Iterator[Pair]:
        text = self.text
        gap = _GAP.match(text, at)
        next_line, at = gap[1] is not None, gap.end()
        joined = _JOINED_INSIDE if "(" in gap[0] else _JOINED
        if m := self.string(at, end):
            if next_line and not _ALONE.match(text, m.end()) and not joined.match(text, m.end()):
                return
            yield from self.quoted(name, m.start(), m.end())
            while (more := joined.match(text, m.end())) and (m := self.string(more.end(), end)):
                yield from self.quoted(name, m.start(), m.end())
        elif m := _ESCAPED.match(text, at):
            yield Pair(name, m.start(2), m.end(2), True)
        elif m := _REFERENCE.match(text, at):
            yield from _references(name, text, m.start(), m.end())
        elif at < len(text) and text[at] not in "\"'`,;(){}[]<>" and not text[at].isspace():
            if self.bare <= at:
                self.bare = _BARE.match(text, at).end()
            if next_line and not _ALONE.match(text, self.bare):
                return
            if (call := _ABOUT.match(text, self.bare)) and _IDENTIFIER.fullmatch(text, at, self.bare):
                yield from self.about(name, call)
            elif not text.startswith("(", self.bare):  # else it is called for what isn't here
                word = text[at : self.bare] if self.bare - at <= 256 and _IDENTIFIER.fullmatch(text, at, self.bare) else None
                yield Pair(name, at, self.bare, False, word)


def pairs(text: str) -> list[Pair]:
    """Names and what they are given, in the order of the text.

    Read are quoted, bare and typed names and indices before ``=``, ``:``, ``:=`` and ``=>``,
    with values in quotes of any kind, joined strings, bare values, references, calls and
    indices about a string, and values on the next line; elements and attributes of mark-up;
    and assignments inside strings. Names, literals and blanks have any length: the text is
    read a fixed number of times.
    """
    out: list[Pair] = []
    back, values = text[::-1], _Values(text)

    def names(at: int) -> Iterator[str]:
        m = _NAME.match(back, len(text) - at)
        if not m:
            return
        name = (m[2] or m[4] or m[5] or m[6])[::-1]
        if m[6]:
            name = name.lstrip("0123456789.-")
            if not name:
                return
            if text[at] == "=" and (typed := _TYPED.match(back, m.end())):
                yield typed[1][::-1]
        yield name

    def read(start: int, end: int) -> None:
        at = start  # of the end of the last string
        while token := _TOKEN.search(text, max(start, at), end):
            start = token.end()
            if token[1]:
                for name in names(token.start()):
                    out.extend(values.of(name, token.end(), end))
            elif token.start() >= at and (string := values.string(token.start(), end)):
                at = string.end()
                if at - token.start() > 8:  # a shorter string holds no assignment of six characters
                    read(*_inside(text, *string.span()))

    read(0, len(text))
    if "<" in text:
        for tag in _TAG.finditer(text):
            if tag[4] and (value := tag[3].strip()):
                start = tag.start(3) + tag[3].index(value)
                found = list(_references(tag[1], text, start, start + len(value)))
                out += found or [Pair(tag[1], start, start + len(value), True)]
            if "=" in tag[2]:
                given = {m[1].lower(): m for m in _ATTRIBUTE.finditer(text, tag.start(2), tag.end(2))}
                value = given.get("value")
                for key in ("key", "name", "id"):
                    if value and key in given:
                        k = 2 if value[2] is not None else 3
                        name = given[key][2] or given[key][3] or ""
                        found = list(_references(name, text, value.start(k), value.end(k)))
                        out += found or [Pair(name, value.start(k), value.end(k), True)]
    return sorted(out, key=lambda x: x.start)


def name_worth(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    return max([0.0, *(PARTS.get(p, 0.0) for p in parts), *(PAIRS.get(p, 0.0) for p in zip(parts, parts[1:]))])


def _placeholder(text: str, start: int, end: int) -> bool:
    return bool(_PLACEHOLDER.match(text, start, end)) or any(end - start >= len(a) + len(b) and text.startswith(a, start) and text.endswith(b, start, end) for a, b in _BRACKETS)


def literal_worth(literal: str) -> float:
    """0 for short ones and placeholders; grows with bits per character and kinds of characters."""
    if len(literal) < 6 or _placeholder(literal, 0, len(literal)):
        return 0.0
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in _CLASSES)
    return min(1.0, bits / 3.0) * (0.4, 0.4, 0.8, 1.0, 1.0)[kinds] * (0.5 if " " in literal else 1.0)


def tail_worths(text: str, starts: list[int], end: int) -> dict[int, float]:
    """`literal_worth` of text[start:end] of each start of one bare run, read once from its end."""
    out: dict[int, float] = {}
    count: Counter[str] = Counter()
    logs, at, kinds = 0.0, end, [False] * len(_CLASSES)
    for start in sorted(set(starts), reverse=True):
        for c in text[start:at]:
            n = count[c] = count[c] + 1
            if n > 1:
                logs += n * math.log2(n) - (n - 1) * math.log2(n - 1)
            else:
                kinds = [k or bool(re.match(p, c)) for k, p in zip(kinds, _CLASSES)]
        at, n = start, end - start
        if n < 6 or _placeholder(text, start, end):
            out[start] = 0.0
        else:
            out[start] = min(1.0, max(0.0, math.log2(n) - logs / n) / 3.0) * (0.4, 0.4, 0.8, 1.0, 1.0)[sum(kinds)]
    return out


def named_spans(text: str) -> list[tuple[int, int, float]]:
    """Start, end and score of each literal that a sensitive name ends up with.

    A reference stands for the last value its name was given before, else for the first after
    it; chains are followed once each, whatever refers to them.
    """
    low = text.lower()
    if not any(w in low for w in _HINTS):
        return []
    found = pairs(text)
    given: dict[str, list[int]] = {}
    starts: dict[int, list[int]] = {}  # of bare literals, by their end
    tails: dict[int, dict[int, float]] = {}
    for i, x in enumerate(found):
        given.setdefault(x.name, []).append(i)
        if not x.quoted:
            starts.setdefault(x.end, []).append(x.start)

    def target(i: int) -> int | None:
        """The pair that pair i refers to."""
        for name in (found[i].refers, found[i].refers.rpartition(".")[2]):
            if at := given.get(name):
                k = bisect_left(at, i)
                if k:
                    return at[k - 1]
                later = k + (k < len(at) and at[k] == i)
                if later < len(at):
                    return at[later]
        return None

    ends: dict[int, int | None] = {}

    def literal(i: int) -> int | None:
        """The pair whose literal pair i ends up with."""
        path, at = [], i
        while at is not None and at not in ends:
            ends[at] = None  # what leads back here has no literal
            path.append(at)
            to = target(at) if found[at].refers else None
            if to is None:
                end = None if found[at].sure else at
                break
            at = to
        else:
            end = None if at is None else ends[at]
        for x in path:
            ends[x] = end
        return end

    def own(x: Pair, w: float) -> float:
        if x.quoted or len(starts[x.end]) < 3:
            return w * literal_worth(text[x.start : x.end])
        if x.end not in tails:
            tails[x.end] = tail_worths(text, starts[x.end], x.end)
        score = w * tails[x.end][x.start]
        # A sum in another order may differ in its last bits.
        return w * literal_worth(text[x.start : x.end]) if abs(score - THRESHOLD) < 1e-9 else score

    worth: dict[int, float] = {}
    for i, x in enumerate(found):
        if (w := name_worth(x.name)) and (end := literal(i)) is not None:
            worth[end] = max(w, worth.get(end, 0.0))
    scores: dict[tuple[int, int], float] = {}
    for end, w in worth.items():
        if (score := own(found[end], w)) >= THRESHOLD:
            span = found[end].start, found[end].end
            scores[span] = max(score, scores.get(span, 0.0))
    return [(*span, score) for span, score in sorted(scores.items())]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind, end of each match of the fixed patterns, in order."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed patterns' spans, and all spans; the lexer's are left out where they meet one of the first."""
    base = base_spans(text)
    more = []
    if ":" in text or "=" in text or "</" in text:
        at = 0
        longest = 0
        ends = []  # furthest end of the base spans so far
        for s in base:
            longest = max(longest, s[2])
            ends.append(longest)
        for start, end, _ in named_spans(text):
            while at < len(base) and base[at][0] < end:
                at += 1
            if not at or ends[at - 1] <= start:
                more.append((start, 3, end))
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_named of every row.

    Whole texts are scanned, with names, literals and blanks of any length; null text counts as
    empty and has no spans. One row out per row
    in, repeated ones too; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pieces(batch.column(1)):
                b = batch.slice(at, to - at)
                found = [scan(text or "") for text in b.column(1).to_pylist()]
                count = lambda k: pa.array([sum(s[1] == k for s in every) for _, every in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([joined(every) for _, every in found], pa.string()), count(3)],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long")
