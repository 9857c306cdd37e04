"""Byte-level BPE as a finite-state transducer, and streaming decoding.

A text's pretokens are the matches of the tokenizer's pattern. Each is read byte by byte by
a transducer whose states are made, and determinised, when first reached. Of a prefix of the
bytes, the encoding is fixed by its last token: the one token that ends there and may follow
the last token of the prefix before it (two tokens may be neighbours when their joined bytes
encode to just these two). Only prefixes whose remaining bytes begin some token can still be
continued; the tokens that the encodings of all such prefixes share are emitted. So a state
is what is left: the bytes since the first prefix that can be continued, and for each of
them the tokens not yet emitted. The last token emitted is kept beside the state, in a
register that only those moves look at that put a token right behind it; states, and most
moves, are thus shared by all tokens before them. Lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator

import regex

from .workers import resident

#: White space as the tokenizer's pattern language has it, for a character class.
SPACE = r"\t-\r\x20\x85\xa0  -     　"

#: States, moves that ask the register, first moves and cached pieces are dropped when they
#: are more than this; memory stays bounded.
MOST_STATES, MOST_CHECKED, MOST_HEADS, MOST_PIECES = 150_000, 300_000, 150_000, 250_000
#: Pieces of so many characters or more aren't kept.
KEPT = 64
#: The moves over a pretoken's first bytes, so many, are kept as one.
HEAD = 6


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Borders:
    """Which tokens may stand next to each other in an encoding.

    Undo the merges of two tokens, the latest first. At each stage the parts on either side
    of the border were neighbours until the merge just undone; had they a merge of lower rank
    (the left of two alike comes first), they would have been joined instead.
    """

    def __init__(self, pair_rank, base):
        """pair_rank(a, b): rank of the merge of two tokens or None; base(token): its first symbols."""
        self.pair_rank, self.base = pair_rank, base
        self.halves: dict = {}
        self.known: dict = {}

    def merge(self, symbols: list, least: int = 1) -> list:
        """Join the pair of least rank, leftmost first, until none is left or ``least`` parts are."""
        parts, pair_rank = list(symbols), self.pair_rank
        ranks = [pair_rank(a, b) for a, b in zip(parts, parts[1:])]
        while len(parts) > least:
            at, best = -1, None
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    at, best = i, r
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = pair_rank(parts[at - 1], parts[at])
            if at < len(ranks):
                ranks[at] = pair_rank(parts[at], parts[at + 1])
        return parts

    def halved(self, token):
        """The two tokens and the rank of the merge that makes a token; () for a first symbol,
        None if merging its symbols doesn't give the token."""
        found = self.halves.get(token, 0)
        if found == 0:
            parts = self.merge(self.base(token), 2)
            if len(parts) == 1:
                found = ()
            else:
                rank = self.pair_rank(*parts) if len(parts) == 2 else None
                found = None if rank is None else (*parts, rank)
            self.halves[token] = found
        return found

    def may_follow(self, a, b) -> bool:
        known = self.known.get((a, b))
        if known is None:
            if len(self.known) > 4 * MOST_STATES:
                self.known.clear()
            known = self.known[a, b] = self._may_follow(a, b)
        return known

    def _may_follow(self, a, b) -> bool:
        left, right = self.halved(a), self.halved(b)
        if left is None or right is None:
            return False
        limit = None
        while True:
            rank = self.pair_rank(a, b)
            if rank is not None and (limit is None or rank < limit):
                return False
            if left and (not right or left[2] > right[2]):
                limit, a = left[2], left[1]
                left = self.halved(a)
            elif right:
                limit, b = right[2] + 1, right[0]
                right = self.halved(b)
            else:
                return True


#: Ids to emit, next state, last token emitted.
Move = tuple[tuple[int, ...], int, bytes | None]


class Transducer:
    """Bytes of one pretoken to token ids, by the given merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:k] for t in ranks for k in range(len(t))}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.borders = Borders(lambda a, b: ranks.get(a + b), lambda t: [t[i : i + 1] for i in range(len(t))])
        self._clear()

    def _clear(self) -> None:
        # A state: bytes since the first prefix that can be continued, and for each such prefix
        # its length within these bytes and its tokens not yet emitted.
        start = (b"", ((0, ()),))
        self.states = [start]
        self.number = {start: 0}
        self.moves: dict[int, Move] = {}  # by state * 256 + byte
        self.checked: dict[tuple[int, bytes | None], Move] = {}  # those that ask the register, with it
        self.heads: dict[bytes, tuple[list[int], int, bytes | None]] = {}  # paths of the first bytes, compressed
        self.finals: list[tuple[int, ...]] = [()]

    def _move(self, state: int, byte: int, emitted: bytes | None) -> Move:
        """Ids to emit, next state, and the register after it (None: as before)."""
        tail, live = self.states[state]
        tail += bytes((byte,))
        n = len(tail)
        ranks = self.ranks
        here = None
        asked = False
        for at, tokens in live:  # the longest token that ends here first
            token = tail[at:]
            if token in ranks:
                if tokens:
                    fits = self.borders.may_follow(tokens[-1], token)
                else:
                    asked = True
                    fits = self.borders.halved(token) is not None if emitted is None else self.borders.may_follow(emitted, token)
                if fits:
                    here = (n, (*tokens, token))
                    break
        if here is None:
            raise ValueError(f"no encoding ends after {tail!r}")
        prefixes = self.prefixes
        live = [x for x in live if tail[x[0] :] in prefixes]
        live.append(here)
        lead = live[0][1]
        shared = len(lead)
        for _, tokens in live:
            if shared > len(tokens):
                shared = len(tokens)
            while shared and tokens[:shared] != lead[:shared]:
                shared -= 1
            if not shared:
                break
        first = live[0][0]
        if first or shared:
            live = [(at - first, tokens[shared:]) for at, tokens in live]
        key = (tail[first:], tuple(live))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.finals.append(tuple(ranks[t] for t in live[-1][1]))
        move = (tuple(ranks[t] for t in lead[:shared]), to, lead[shared - 1] if shared else None)
        if asked:
            self.checked[state << 8 | byte, emitted] = move
        else:
            self.moves[state << 8 | byte] = move
        return move

    def _run(self, data: bytes, state: int, emitted: bytes | None, out: list[int]) -> tuple[int, bytes | None]:
        find, find_checked = self.moves.get, self.checked.get
        for byte in data:
            move = find(state << 8 | byte) or find_checked((state << 8 | byte, emitted)) or self._move(state, byte, emitted)
            ids, state, last = move
            if ids:
                out += ids
                emitted = last
        return state, emitted

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > MOST_STATES or len(self.checked) > MOST_CHECKED or len(self.heads) > MOST_HEADS:
            self._clear()
        head = data[:HEAD]
        path = self.heads.get(head)
        if path is None:
            out: list[int] = []
            state, emitted = self._run(head, 0, None, out)
            self.heads[head] = (out, state, emitted)
            out = out.copy()
        else:
            out, state, emitted = path
            out = out.copy()
        if len(data) > HEAD:
            state, _ = self._run(data[HEAD:], state, emitted, out)
        out += self.finals[state]
        return out


class Pieces(dict):
    """What is known of each piece of text between blanks; see `split`."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str):
        value = self.of(piece)
        if len(piece) < KEPT:
            self[piece] = value
        return value


def cuttable(text: str) -> bool:
    """Whether every blank of the text is also a border of pretokens: blanks are single spaces and
    line feeds inside the text."""
    flat = text.replace("\n", " ")
    if not flat or flat[0] == " " or flat[-1] == " " or "  " in flat:
        return False
    return flat.isprintable()  # no other white space, no controls


def split(text: str) -> list[str] | None:
    """The text cut at its blanks, if it is `cuttable`, else None. A piece other than the first
    stands for itself with a space before it, unless it begins with the line feed that was
    before it.
    """
    return text.replace("\n", " \n").split(" ") if cuttable(text) else None


class ByteBpe:
    """Whole texts to ids by the ranks of a file and a pattern of pretokens, and back."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]"))
        self.pieces = Pieces(lambda piece: self.pretokens(piece if piece[:1] == "\n" else " " + piece))
        self.bytes_of = self.transducer.bytes_of
        self.matches = Pieces(lambda match: array("I", self.transducer.encode(match.encode())).tobytes())

    def pretokens(self, text: str) -> bytes:
        """Ids of a text's pretokens, as unsigned integers of four bytes."""
        if len(self.matches) > MOST_PIECES:
            self.matches.clear()
        return b"".join(map(self.matches.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        pieces = split(text)
        if pieces is None:
            packed = self.pretokens(text)
        else:
            if len(self.pieces) > MOST_PIECES:
                self.pieces.clear()
            packed = self.pretokens(pieces[0]) + b"".join(map(self.pieces.__getitem__, pieces[1:]))
        return array("I", packed).tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, blocks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text block by block as ids arrive: bytes of a character that isn't complete wait in
        the state of an incremental UTF-8 decoder; ill-formed bytes become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            if text := state.decode(self.decode_bytes(ids)):
                yield text
        if text := state.decode(b"", final=True):
            yield text


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One per Python worker."""
    return resident(("bpe", path, pattern), lambda: ByteBpe(path, pattern))
