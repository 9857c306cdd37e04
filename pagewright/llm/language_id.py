"""Language identification by segmentation-marginalised unigrams.

For each language the pieces of a fixed public vocabulary have probabilities, learned by
expectation maximisation. A word, written with the vocabulary's word mark in front, has the
probability of all its segmentations into pieces together, summed by the forward algorithm;
a text has that of its words. With equal priors the posterior over languages is the score.

Words are runs of letters (marks and numerals of any kind end one), of any length, of the lower-cased text. A character that is no
piece counts as one of fixed probability, the same for all languages. Sums are rescaled on
the way, so that they stay within a float's range in words of any length.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shingles import pieces
from .workers import resident, returned

UNDETERMINED = "und"
MARK = "▁"
#: Bounds of the sample the probabilities are learned from: documents of a language on
#: average, and its most frequent different words.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 400, 30_000
ROUNDS, SMOOTHING = 4, 0.1
#: Probability of a character that is no piece.
UNKNOWN = 1e-7
#: Words whose probabilities a worker keeps.
MOST_WORDS = 400_000
#: Words of more letters aren't kept.
KEPT_LETTERS = 64
#: Characters of words that are looked up at a time, and after how many sums are rescaled:
#: UNKNOWN to twice this power is within a float's range.
BLOCK_CHARS, RESCALED = 1 << 17, 16
#: Nats per letter below which the best language doesn't explain a text; see `drop_undetermined`.
LEAST_LIKELIHOOD = -9.0
_WORD = re.compile(r"[^\W\d_]+")
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def words_of(text: str) -> list[str]:
    """Runs of letters of the lower-cased text. What the pattern finds may hold numerals that are no
    decimal digits, outside ASCII alone; such words are cut there."""
    text = text.lower()
    words = _WORD.findall(text)
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """The normal pieces of a sentencepiece model file, lower case only (texts are lower-cased)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)))
    return sorted({p for p in normal if p == p.lower() and all(c.isalpha() or c == MARK for c in p) and MARK not in p[1:]})


class Windows:
    """Where the pieces of a vocabulary occur in words."""

    def __init__(self, path: str):
        self.words = vocabulary(path)
        self.power = np.ones((2, 1), dtype=np.uint64)  # of the base and of its inverse
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.words):
            by_length.setdefault(len(p), []).append(i)
        self.tables = {}
        for n, ids in by_length.items():
            h = self._sums([self.words[i] for i in ids])[:, n]
            order = np.argsort(h)
            self.tables[n] = (h[order], np.array(ids, dtype=np.int32)[order])

    def _powers(self, n: int) -> np.ndarray:
        if self.power.shape[1] < n:
            power = np.empty((2, 2 * n), dtype=np.uint64)
            power[:] = [[_BASE], [pow(_BASE, -1, 1 << 64)]]
            power[:, 0] = 1
            self.power = np.multiply.accumulate(power, axis=1)
        return self.power

    def _sums(self, words: list[str]) -> np.ndarray:
        """Of words of one length, sums of code points times powers, up to each place."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), n).astype(np.uint64)
        out = np.zeros((len(words), n + 1), dtype=np.uint64)
        np.cumsum((codes + np.uint64(1)) * self._powers(n + 1)[0, :n], axis=1, out=out[:, 1:])
        return out

    def of(self, words: list[str]) -> list[list[tuple[int, np.ndarray]]]:
        """Words of one length: for each end 1.. of the marked word, (piece length, piece or -1 by word)."""
        h = self._sums([MARK + w for w in words])
        ends = h.shape[1] - 1
        found: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(ends)]
        for n, (keys, ids) in self.tables.items():
            if n > ends:
                continue
            x = (h[:, n:] - h[:, :-n]) * self.power[1, : ends - n + 1]
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            piece = np.where(keys[at] == x, ids[at], np.int32(-1)).T.copy()
            for start in range(len(piece)) if n == 1 else np.flatnonzero((piece >= 0).any(axis=1)).tolist():
                found[start + n - 1].append((n, piece[start]))
        return found


def _chance(p: np.ndarray, n: int, piece: np.ndarray) -> np.ndarray:
    """Probability of a piece of n characters by word and language."""
    chance = p[piece]  # the last row of p, which -1 finds, is that of no piece
    if n == 1:
        chance[piece < 0] = UNKNOWN
    return chance


def forward(p: np.ndarray, found: list[list[tuple[int, np.ndarray]]], n_words: int, every: bool = False) -> list[np.ndarray]:
    """Log probabilities of each word in each language; of its first 0, 1, ... characters if ``every``."""
    reach = max(n for here in found for n, _ in here)
    alpha = [np.ones((n_words, p.shape[1]))]  # of the last ends, most recent last
    scale = np.zeros((n_words, p.shape[1]))
    logs = [scale]
    for end, here in enumerate(found, 1):
        total = np.zeros((n_words, p.shape[1]))
        for n, piece in here:
            total += alpha[-n] * _chance(p, n, piece)
        alpha.append(total)
        if every:
            logs.append(np.log(total) + scale)
        if end % RESCALED == 0:
            scale = scale + np.log(total)
            alpha = [a / total for a in alpha[-reach:]]
    return logs if every else [np.log(alpha[-1]) + scale]


def _expected(p: np.ndarray, found, counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece (last row: none) over words with counts by language."""
    before = forward(p, found, len(counts), every=True)
    # The same from the end: pieces by their start, ends counted from the last.
    turned: list[list[tuple[int, np.ndarray]]] = [[] for _ in found]
    for end, here in enumerate(found, 1):
        for n, piece in here:
            turned[len(found) - end + n - 1].append((n, piece))
    after = forward(p, turned, len(counts), every=True)
    out = np.zeros_like(p)
    for end, here in enumerate(found, 1):
        for n, piece in here:
            share = np.exp(before[end - n] + after[len(found) - end] - before[-1]) * _chance(p, n, piece)
            np.add.at(out, piece, counts * share)
    out[-1] = 0
    return out


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of equal length, in blocks."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        block = max(1, BLOCK_CHARS // int(n + 1))
        for i in range(0, len(at), block):
            yield at[i : i + block]


def learn(path: str, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces + 1 x languages) from words and their counts by language."""
    w = windows(path)
    groups = [(w.of([words[i] for i in at]), counts[at]) for at in _by_length(words)] if words else []
    size = len(w.words)
    p = np.full((size + 1, counts.shape[1]), 1.0 / size)
    p[-1] = 0
    for k in range(rounds):
        uses = sum((_expected(p, found, c) for found, c in groups), np.zeros_like(p))
        uses[:-1] += SMOOTHING
        p = uses / uses.sum(axis=0)
    return p


@functools.lru_cache(maxsize=2)
def windows(path: str) -> Windows:
    return Windows(path)


class Scorer:
    """Log probabilities of words by language, kept per worker."""

    def __init__(self, path: str, p: np.ndarray):
        self.windows, self.p = windows(path), p
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.zeros((1 << 14, self.p.shape[1]))

    def word_logs(self, words: list[str]) -> np.ndarray:
        logs = np.empty((len(words), self.p.shape[1]))
        for at in _by_length(words):
            same = [words[i] for i in at]
            logs[at] = forward(self.p, self.windows.of(same), len(same))[-1]
        return logs

    def score(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """Log probability of each text by language, and its letters; None where it has none."""
        words = [words_of(t) if t else [] for t in texts]
        if len(self.place) > MOST_WORDS:
            self.clear()
        new = list(set().union(*words).difference(self.place))
        short = [w for w in new if len(w) <= KEPT_LETTERS]
        first = len(self.place)
        if first + len(new) > len(self.logs):
            self.logs = np.concatenate((self.logs, np.zeros((first + len(new), self.p.shape[1]))))
        if new:
            long = [w for w in new if len(w) > KEPT_LETTERS]
            self.logs[first : first + len(new)] = self.word_logs(short + long)
            self.place.update(zip(short + long, range(first, first + len(new))))
        get = self.place.__getitem__
        out = [(self.logs[np.fromiter(map(get, w), dtype=np.int64, count=len(w))].sum(axis=0), sum(map(len, w))) if w else None for w in words]
        if len(short) < len(new):
            for w in long:
                del self.place[w]
        return out


def fit(docs: DataFrame, path: str, sample_documents: int = SAMPLE_DOCUMENTS, sample_words: int = SAMPLE_WORDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from the text and lang of ``docs`` (rows without
    either are left out).

    Of each language about ``sample_documents`` whole documents, chosen by a hash of doc_id,
    and their ``sample_words`` most frequent words are used; that bounds what reaches the
    driver, whatever the size of the table. The table is read twice, however many languages
    there are: to count documents, and for the sample's words.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 0))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    bound = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(1_000_000 * min(1.0, sample_documents / sizes[lang])))]), F.col("lang"))
    sample = known.where(draw < bound)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # A limit by group is applied before rows are sent; ties go by the word itself.
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= sample_words).select("lang", "word", "n").toArrow()
    top = top.sort_by([("lang", "ascending"), ("word", "ascending")])
    number: dict[str, int] = {}
    row = [number.setdefault(w, len(number)) for w in top["word"].to_pylist()]
    table = np.zeros((len(number), len(languages)))
    table[row, np.searchsorted(languages, top["lang"].to_numpy())] = top["n"].to_numpy()
    p = learn(path, list(number), table)
    returned()  # the driver goes on without what learning took
    return languages, p


def predict(docs: DataFrame, path: str, languages: list[str], p: np.ndarray, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and likelihood of every row, from its whole text alone, after
    the columns ``keep``.

    The likelihood is the mean log probability of a letter in the predicted language. A text
    that is null or has no letter, and every text when no language was learned, is ``und``
    with score 0 and no likelihood. Words may have any length; scores are from 0 to 1. One
    row out per row in; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(p.astype(np.float32))  # vocabulary x languages, whatever the corpus
    rows = docs.select("text", *(keep or (F.col("doc_id"),)))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    key = ("language", path, uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(key, lambda: Scorer(path, model.value.astype(np.float64))) if languages else None
        for batch in batches:
            for at, to in pieces(batch.column(0)):
                b = batch.slice(at, to - at)
                best, score, likelihood = [], [], []
                for found in scorer.score(b.column(0).to_pylist()) if scorer else [None] * b.num_rows:
                    if found is None:
                        best.append(UNDETERMINED)
                        score.append(0.0)
                        likelihood.append(None)
                    else:
                        logs, letters = found
                        k = int(np.argmax(logs))
                        best.append(languages[k])
                        score.append(float(1.0 / np.exp(logs - logs[k]).sum()))
                        likelihood.append(float(logs[k]) / letters)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(likelihood, pa.float64())], names=[*(f.name for f in kept), "lang_pred", "score", "likelihood"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, likelihood double")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: a fourth, by checksum of doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and likelihood of every row; probabilities are learned from the others' lang."""
    learned = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), path)
    return predict(docs, path, *learned, keep=(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")))


def drop_undetermined(docs: DataFrame, path: str, least: float = LEAST_LIKELIHOOD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is in one of the languages learned.

    What is dropped is ``und`` (null text and text without a letter), and text whose letters
    have a mean log probability below ``least`` in the best language. Text in a learned
    language has some -3, a letter that is no piece -16: dropped is text of which about half
    the letters are foreign to the vocabulary. Where no language was learned, all text with a
    letter stays. Whole rows pass through the scorer, so nothing is joined.
    """
    languages, p = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), path)
    if not languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = [f"_{i}" for i in range(len(docs.columns))]
    rows = predict(docs, path, languages, p, keep=tuple(docs[c].alias(n) for c, n in zip(docs.columns, names)))
    return rows.where((F.col("lang_pred") != UNDETERMINED) & (F.col("likelihood") >= least)).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
