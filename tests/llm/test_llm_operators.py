"""The training-data operators against brute force, on small tables with odd rows.

Every table here has null texts, an empty text, repeated rows and a column that clashes
with what an operator makes itself; every operator also runs on an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from pagewright.llm import bpe, bpe_documents, chat_format, components, exact_dedup, fingerprints, language_id, mixing, near_dedup, ranges, secret_scan, shingles, storage, token_counts, token_files  # noqa: E402
from pagewright.llm.components import connected  # noqa: E402
from pagewright.llm.storage import shared_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, part int, kept boolean, size long"
WORDS = "able bring castle down every flower green house into jungle keep little".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice("abcdefgh") for _ in range(n))


def corpus() -> list[tuple]:
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        rows.append((i, prose(rnd, rnd.randint(3, 120)), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "Ä", None, "hot", "hot", "hot"])))
    base = rows[10][1] + " " + prose(rnd, 150)
    rows.append((100, base, "en", "a"))
    for k in range(101, 130):  # copies edited in two places
        words = base.split()
        for _ in range(2):
            words[rnd.randrange(len(words))] = "edited" + str(rnd.randrange(99))
        rows.append((k, " ".join(words), "en", "hot"))
    rows += [(200 + k, base.replace(" ", "  \n"), "fr", "hot") for k in range(20)]
    rows += [(300, None, "en", "a"), (301, "", None, None), (302, " \t\n", "en", "b"), (303, "12 34 !!", "fr", "b"), (304, "é" * 3000 + " " + "word " * 2000, "fr", "a")]
    rows += [(5, rows[5][1], rows[5][2], rows[5][3]), (None, "a row without an id", "en", "a"), (300, None, "en", "a")]
    return [(*r, len(r[1] or ""), "x", 1, False, 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_hash(text) -> int:
    """Spark's xxhash64 of a text, as a signed number; null counts as empty."""
    n = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return n - (1 << 64) if n >> 63 else n


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


# 1: near-duplicates


def bag_of(text: str) -> Counter:
    words = re.findall(r"[a-z0-9À-῿]+", (text or "").lower())
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows) -> dict:
    bags = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            bags[r[0]].append(bag_of(r[1]))
    ids = sorted(bags)
    of = {i: i for i in ids}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(a and b and similarity(a, b) >= 0.8 for a in bags[i] for b in bags[j]):
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_classes(docs, none):
    rows = near_dedup.near_classes(docs).collect()
    want = brute_classes(corpus())
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in corpus())
    for r in rows:
        assert r["class_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["class_id"] == r["doc_id"])
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in rows if r["doc_id"] is not None)
    assert near_dedup.near_classes(none).collect() == []
    left = near_dedup.drop_near_duplicates(docs)
    # Every row is a document of its own: the repeated row of 5 and that of 300 is in its class.
    kept = Counter(r["doc_id"] for r in left.collect())
    assert left.columns == docs.columns and kept == Counter({300: 2, **{i: 1 for i in {None, *want.values()} - {300}}})
    assert near_dedup.drop_near_duplicates(none).collect() == []


def test_links_that_a_leader_misses(spark, monkeypatch):
    """A chain of edits: neighbours are similar, ends are not; and pairs tested directly or by next leaders."""
    rnd = random.Random(3)
    words, rows = prose(rnd, 200).split(), []
    for i in range(30):
        rows.append((i * 7 % 30, " ".join(words)))
        words = words[3:] + prose(rnd, 3).split()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    for direct in (64, 1):
        monkeypatch.setattr(near_dedup, "DIRECT_BAND", direct)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(df).collect()} == want


def test_recall_of_bands():
    """Measured: of 2,000 pairs of similarity 0.8 to 0.85, those that share a band."""
    rnd = random.Random(13)
    first, second = [], []
    while len(first) < 2000:
        words = [rnd.choice(WORDS) + str(rnd.randrange(500)) for _ in range(rnd.randint(80, 160))]
        edited = words[:]
        for _ in range(max(1, len(words) // 45)):
            edited[rnd.randrange(len(words))] = "edited"
        a, b = " ".join(words), " ".join(edited)
        if 0.8 <= similarity(bag_of(a), bag_of(b)) < 0.85:
            first.append(a)
            second.append(b)
    m = near_dedup.BANDS * near_dedup.BAND_ROWS
    of = lambda texts: near_dedup.signatures(*near_dedup.bags(*shingles.shingle_hashes(pa.array(texts))), len(texts), m).reshape(len(texts), near_dedup.BANDS, near_dedup.BAND_ROWS)
    met = (of(first) == of(second)).all(axis=2).any(axis=1)
    assert met.mean() >= 0.999


def test_signatures_estimate_weighted_similarity():
    rnd = random.Random(11)
    a = [rnd.choice(WORDS) * rnd.randint(1, 2) for _ in range(400)]
    b = a[:300] + [rnd.choice(WORDS) + "x" for _ in range(150)]
    texts = pa.array([" ".join(a), " ".join(b), " ".join(["same words here again now"] * 50), " ".join(["same words here again now"] * 30)])
    m = 4096
    row, h, count = near_dedup.bags(*shingles.shingle_hashes(texts))
    s = near_dedup.signatures(row, h, count, 4, m)
    for i, j in ((0, 1), (2, 3)):
        want = similarity(bag_of(texts[i].as_py()), bag_of(texts[j].as_py()))
        assert abs((s[i] == s[j]).mean() - want) < 5 * (want * (1 - want) / m) ** 0.5 + 1e-9
        assert near_dedup.overlap(texts.slice(i, 1), texts.slice(j, 1))[0] == pytest.approx(want)


def test_join_of_one_kind_of_keys(spark):
    """Where no key is hot nothing is broadcast, where all are nothing is merged; rows are the same."""

    def joined(sizes):
        rows = [(k, i) for k, n in enumerate(sizes) for i in range(n)]
        left = spark.createDataFrame(rows, "k long, i long")
        right = spark.createDataFrame([(k, n, str(k)) for k, n in enumerate(sizes)], "k long, n long, s string")
        df = ranges.join_unique(left, right, ["k"], "n", len(rows))
        assert df.columns == ["k", "i", "s"] and sorted(map(tuple, df.collect())) == [(k, i, str(k)) for k, i in rows]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("strategy=broadcast"), plan.count("strategy=merge")

    assert joined([1] * 50) == (0, 1)
    assert joined([3] * 50) == (1, 0)
    assert joined([1] * 50 + [3]) == (2, 1)
    assert joined([]) == (0, 1)


def test_connected(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(600, k) for k in range(601, 660)]
    of = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: of[x] for e in edges if e[0] != e[1] for x in e}


def test_plans_of_few_joins(spark, docs, monkeypatch):
    """No step of a round, nor the end of the near stage, is planned again inside another: a join
    apart for hot keys is three. The driver keeps all of a plan's stages and metrics in memory."""
    joins = lambda df: len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString()))
    found = []

    def written(df, name, path=None):
        found.append((name, joins(df)))
        return storage.written(df, name, path)

    monkeypatch.setattr(components, "written", written)
    edges = [(1, k) for k in range(2, 40)] + [(k, k + 1) for k in range(100, 110)] + [(39, 100)]
    got = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(x, 1) for e in edges for x in e}
    assert max(n for _, n in found) == 3
    assert joins(near_dedup.drop_near_duplicates(docs)) == 2


# 2: language


def test_language(spark, docs, none):
    path = P.path("piece_bpe_32k.model")
    rnd = random.Random(2)
    lists = {"en": "the of and to house water night".split(), "fr": "les des une maison eau nuit très".split(), "es": "los una casa agua noche años".split()}
    rows = [(i, " ".join(rnd.choice(lists[lang]) for _ in range(30)), lang if rnd.random() < 0.9 else None, lang) for i in range(300) for lang in [rnd.choice(list(lists))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    got = language_id.identify(df, path).collect()
    assert [f for f in got[0].asDict()] == ["doc_id", "held_out", "lang_pred", "score", "likelihood"]
    truth = {r[0]: r[3] for r in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]) >= 0.97 * sum(r["held_out"] for r in got)
    odd = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, path).where("doc_id >= 300").collect()}
    assert {(300, "und"), (301, "und"), (302, "und"), (303, "und")} <= odd and (304, "und") not in odd
    assert language_id.identify(none, path).collect() == []
    left = language_id.drop_undetermined(docs, path)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == sorted(r[0] or -1 for r in corpus() if any(c.isalpha() for c in r[1] or ""))


def test_language_of_long_words(spark):
    """Words of any length and of any script have a score from 0 to 1, none outweighs a text by error."""
    path = P.path("piece_bpe_32k.model")
    lists = {"en": "the of and to house water night".split(), "es": "los una casa agua noche años".split()}
    rows = [(i, " ".join(lists[lang] * 5), lang) for i, lang in enumerate(["en", "es"] * 30)]
    odd = ["漢" * 80 + " the house the house", "漢" * 5000 + " los una casa", "thehouse漢字" * 700 + " the of and to house", "é" * 5000, "ab" * 50_000, "漢字仮名" * 10]
    df = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df, path).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[1000 + i]["lang_pred"] for i in range(3)] == ["en", "es", "en"]
    left = {r["doc_id"] for r in language_id.drop_undetermined(df, path).collect()}
    assert left >= {r[0] for r in rows} and not left & {1000, 1001, 1005}
    nothing = language_id.drop_undetermined(df.withColumn("lang", F.lit(None).cast("string")), path)
    assert nothing.count() == df.count()


def test_letters_beside_numerals(spark):
    """A letter is a letter beside superscripts, fractions and letters that are numerals; those alone are none."""
    path = P.path("piece_bpe_32k.model")
    lists = {"en": "the of and to house water night".split(), "es": "los una casa agua noche años".split()}
    odd = {1000: "10 m²", 1001: "x² y²", 1002: "½ ² Ⅷ ٣ ①", 1003: "the² house½", 1004: "Ⅷc"}
    rows = [(i, " ".join(lists[lang] * 5), lang) for i, lang in enumerate(["en", "es"] * 20)] + [(i, t, None) for i, t in odd.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, path).collect()}
    assert {i for i in odd if got[i] == "und"} == {1002} and got[1003] == "en"
    assert {1000, 1001, 1003, 1004} <= {r["doc_id"] for r in language_id.drop_undetermined(df, path, least=-20.0).collect()}
    some = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert [c for c in some if any(w.isalpha() for w in language_id.words_of(c)) != any(x.isalpha() for x in c.lower())] == []
    assert language_id.words_of("Ab²cd x_y 3e½") == ["ab", "cd", "x", "y", "e"]


def test_range_cuts(spark):
    """Ranges ascend with key and hash, are even, and cut a key of a third of the rows."""
    rows = [(i * 37 % 4001 - 2000,) for i in range(4000)] + [(77,)] * 2000
    df = spark.createDataFrame(rows, "k long").withColumn("h", F.xxhash64(F.monotonically_increasing_id())).cache()
    cuts = ranges.range_cuts(df, "k", 8, 32, len(rows))
    got = df.select("k", "h", ranges.range_part(F.col("k"), F.col("h"), cuts).alias("p")).collect()
    assert all(r["p"] == sum(c <= (r["k"], r["h"]) for c in cuts) for r in got)
    assert max(Counter(r["p"] for r in got).values()) < 4 * len(rows) / 32
    even = ranges.range_cuts(df.where("k <> 77"), "k", 8, 32, 4000)
    assert all(r["p"] == sum(c <= (r["k"], 0) for c in even) for r in df.select("k", ranges.range_part(F.col("k"), F.lit(None).cast("long"), even).alias("p")).collect())
    assert ranges.range_cuts(df.limit(0), "k", 8, 32, 0) == []


def brute_logs(word: str, p: np.ndarray, number: dict) -> np.ndarray:
    """Log sums over all segmentations, in logarithms throughout."""
    logs = np.full((len(word) + 1, p.shape[1]), -np.inf)
    logs[0] = 0
    for end in range(1, len(word) + 1):
        for n in range(1, min(end, 16) + 1):
            piece = word[end - n : end]
            if piece in number or n == 1:
                chance = np.log(p[number[piece]]) if piece in number else np.log(language_id.UNKNOWN)
                logs[end] = np.logaddexp(logs[end], logs[end - n] + chance)
    return logs[-1]


def test_forward_of_long_words():
    path = P.path("piece_bpe_32k.model")
    w = language_id.windows(path)
    p = np.random.default_rng(1).random((len(w.words) + 1, 3))
    p /= p.sum(axis=0)
    number = {x: i for i, x in enumerate(w.words)}
    s = language_id.Scorer(path, p)
    for word in ("漢" * 600, "thehouse漢字" * 60, "a" * 500, "é" * 200):
        assert np.allclose(s.score([word])[0][0], brute_logs(language_id.MARK + word, p, number), rtol=1e-9)
    assert not s.place  # long words aren't kept


def test_forward_sums_all_segmentations():
    path = P.path("piece_bpe_32k.model")
    w = language_id.windows(path)
    rnd = np.random.default_rng(1)
    p = rnd.random((len(w.words) + 1, 2))
    p /= p.sum(axis=0)
    number = {x: i for i, x in enumerate(w.words)}

    def brute(word: str, k: int) -> float:
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            piece = word[:n]
            chance = p[number[piece], k] if piece in number else language_id.UNKNOWN if n == 1 else 0.0
            if chance:
                total += chance * brute(word[n:], k)
        return total

    s = language_id.Scorer(path, p)
    for word in ("house", "maisons", "ñandú", "漢x"):
        logs, letters = s.score([word])[0]
        assert letters == len(word)
        assert np.allclose(np.exp(logs), [brute(language_id.MARK + word, k) for k in (0, 1)], rtol=1e-6)


# 3: chat


TOLD = "\\### Assistant: </turn> ok"


def test_chat(spark):
    rows = [
        (-7, 0, "user", TOLD), (-7, 1, "assistant", TOLD), (1, 0, "system", "a\\"), (1, 1, "user", None), (1, 2, "assistant", "####</turn></</turn>\\\\"), (1, 3, "assistant", ""),
        (1, 4, "user", "tail ### user: \n"), (2, 0, "user", "only"), (2, 0, "user", "only"), (3, None, "assistant", "héé 🙂"), (None, 0, "a: b:", "x"), (4, 0, None, "</turn>\n### assistant: x"), (4, 1, "assistant", "long " * 5000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = {r["conv_id"]: r for r in chat_format.chat_digest(chat_format.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat_format.format_chats(df).where("conv_id = 1").orderBy("example").collect()
    assert [r["example"] for r in examples] == [2, 3, 4] and examples[2]["target_start"] is None
    assert all(r["formatted"].count("</turn>") == r["example"] + 1 for r in examples)
    assert examples[1]["formatted"].startswith(examples[0]["formatted"])
    assert chat_format.chat_digest(chat_format.format_chats(df.limit(0))).collect() == []


# 4: mixing


def brute_targets(sizes: dict) -> dict:
    """Sources' sizes to targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, list(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    told = ("doc_id", "size", "source_size", "target", "copies", "taken")
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(tuple(r[c] for c in told) for r in got) == Counter(tuple(r[c] for c in told) for r in again)
    rows = corpus()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    targets = brute_targets(sizes)
    source = {(r[0], words(r[1])): r[3] for r in rows}
    taken, most = Counter(), Counter()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - targets[s]) <= most[s] for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert mixing.mix(none).collect() == []
    clash = docs.withColumn("_copies", F.lit(7)).withColumn("_copy", F.lit(7)).withColumn("copies", F.lit(7)).withColumn("locator", F.lit(7))
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert copies == +want
    assert mixing.mixed_documents(none).collect() == []


def test_mix_of_repeated_rows(spark):
    """A doc_id of a third of all rows, with and without different texts, splits into buckets."""
    rows = [(i, "some words here " * (i % 5 + 1), "ab"[i % 2]) for i in range(400)] + [(None, "no id", "a")] * 150 + [(7777, f"text number {i}", "b") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = [Counter(tuple(r[c] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in mixing.mix(df.repartition(n)).collect()) for n in (1, 6)]
    assert counted[0] == counted[1] and sum(counted[0].values()) == len(rows)
    spent = sum(k[4] * n for k, n in counted[0].items())
    total = sum(len(r[1].split()) for r in rows)
    assert 1.5 * total - 40 <= spent <= 1.5 * total
    assert mixing.mixed_documents(df).count() == sum(k[4] // k[1] * n for k, n in counted[0].items())


# 5, 8, 9: tokens


def odd_texts() -> list[str]:
    rnd = random.Random(1)
    letters = list("abcdefghijklmnopqrstuvwxyzABC    \n\n\t\r'.,!?0123456789éèüßñ你好🙂  ­　Σσς½²_-<|>") + ["<|endoftext|>", "'s", "'re", "İ", "é", "\x1c", "\x85"]
    out = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(400)]
    return out + ["", " ", "\n", "a" * 3000, " " * 500, "the " * 1000, "é" * 400, prose(rnd, 3000)] + [r[1] or "" for r in corpus()]


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_is_the_library():
    library, own = tiktoken_encoding(), bpe.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert "".join(own.decode_stream(ids[i : i + 3] for i in range(0, len(ids), 3))) == text
    assert "".join(own.decode_stream([[own.bytes_of.index(b"\xc3")]])) == "�"


def test_transducer_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 5)
    library, own = tiktoken_encoding(), bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert all(own.encode(t) == library.encode_ordinary(t) for t in odd_texts()[:120])


def test_encode_documents(docs, none):
    library = tiktoken_encoding()
    how = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = Counter(tuple(r) for r in bpe_documents.encode_documents(docs, *how).collect())

    def one(r):
        ids = library.encode_ordinary(r[1] or "")
        return (r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())

    assert got == Counter(one(r) for r in corpus())
    assert bpe_documents.encode_documents(none, *how, ids=True).collect() == []


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    name = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(name)
    texts = odd_texts()
    assert [x.tolist() for x in token_files.encode_batch(name, texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    path = shared_path(spark, "test-tokens")
    token_files.write_tokens(docs, name, path)
    got = token_files.token_checksums(token_files.read_tokens(spark, path)).collect()
    rows = sorted(((r[0] is not None, r[0] or 0), text_hash(r[1]), r[1] or "") for r in corpus())
    start, want = 0, []
    for (has, i), _, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        want.append((i if has else None, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    index = token_files.read_index(spark, path).collect()
    assert Counter((r["doc_id"], r["start"], r["n_tokens"]) for r in index) == Counter(w[:3] for w in want)
    some = token_files.read_tokens(spark, path, first=10, last=20)
    assert Counter(r["doc_id"] for r in some.collect()) == Counter(i for (has, i), *_ in rows if has and 10 <= i <= 20)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in some._jdf.queryExecution().toString()
    path = shared_path(spark, "test-no-tokens")
    token_files.write_tokens(none, name, path)
    assert token_files.read_tokens(spark, path).collect() == []


def test_token_file_footers(spark):
    """Encodings, row groups and page indexes as the format promises."""
    import glob

    import pyarrow.parquet as pq

    rnd = random.Random(2)
    df = spark.createDataFrame([(i, prose(rnd, 400)) for i in range(3000)], "doc_id long, text string")
    path = shared_path(spark, "test-footers")
    token_files.write_tokens(df, P.path("byte_bpe_50k.json"), path)
    files = [f for f in glob.glob(path.removeprefix("file://") + "/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert files
    for name in files:
        meta = pq.ParquetFile(name).metadata
        assert [meta.row_group(0).column(i).path_in_schema for i in range(5)] == ["doc_id", "part", "local_start", "n_tokens", "ids.list.element"]
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 2 * token_files.ROW_GROUP_BYTES
            for i in range(5):
                column = group.column(i)
                assert column.has_column_index and column.has_offset_index
                assert ("RLE_DICTIONARY" if i == 4 else "DELTA_BINARY_PACKED") in column.encodings
    tight = shared_path(spark, "test-tokens")
    token_files.write_tokens(df.limit(50), P.path("byte_bpe_50k.json"), tight)
    assert token_files.read_tokens(spark, tight, first=7, last=9).count() == 3


def test_tokens_that_cross_pieces(monkeypatch):
    """Where pieces can't be told apart in the library's ids, whole texts are encoded."""
    from tokenizers import Tokenizer

    name = P.path("byte_bpe_50k.json")
    texts = ["ab cd ef", "gh ij", "", "x"]
    want = [Tokenizer.from_file(name).encode(t, add_special_tokens=False).ids for t in texts]
    tokenizer, lengths, _ = token_files._encoder(name)
    monkeypatch.setattr(token_files, "_encoder", lambda path: (tokenizer, lengths + 1, {}))  # ends aren't found
    assert [x.tolist() for x in token_files.encode_batch(name, texts)] == want


def test_pieces_with_tails(monkeypatch):
    """A known piece with another tail doesn't go to the library; all ids are the library's."""
    from tokenizers import Tokenizer

    name = P.path("byte_bpe_50k.json")
    tokenizer, lengths, _ = token_files._encoder(name)
    kept, sent = {}, []
    encode_new = token_files._encode_new
    monkeypatch.setattr(token_files, "_encoder", lambda path: (tokenizer, lengths, kept))
    monkeypatch.setattr(token_files, "_encode_new", lambda t, n, new, known: sent.append(list(new)) or encode_new(t, n, new, known))
    texts = ["a castle flower\nhouse", "a castle. flower,$$$ castle\nhouse.*** grün! грач: don't. it's,%% x<|endoftext|>. <|endoftext|>, 7. ... \u5b57. \u0e01\u0e34. a\u0301. <.>. castle....!!!!\nhouse;"]
    library = Tokenizer.from_file(name)
    for text in texts:
        assert token_files.encode_batch(name, [text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(sent[0]) == ["\nhouse", "castle", "flower"]
    later = [p for new in sent[1:] for p in new]
    assert not [p for p in later if "castle" in p or "flower" in p or "house" in p] and "grün" in later and "\u5b57." in later


def test_kept_pieces(monkeypatch):
    """No piece that is kept is an object of Python's; those not used of late go; all ids are the library's."""
    import gc
    import sys

    from tokenizers import Tokenizer

    name = P.path("byte_bpe_50k.json")
    tokenizer, lengths, _ = token_files._encoder(name)
    kept = {}
    monkeypatch.setattr(token_files, "_encoder", lambda path: (tokenizer, lengths, kept))
    rnd = random.Random(11)
    words = ["".join(rnd.choices("etaoinéßд", k=9)) for _ in range(20_000)]
    one, other = ([" ".join(words[i : i + 500]) for i in range(at, at + 10_000, 500)] for at in (0, 10_000))
    library = Tokenizer.from_file(name)
    want = lambda texts: [library.encode(t, add_special_tokens=False).ids for t in texts]
    same = lambda texts: [x.tolist() for x in token_files.encode_batch(name, texts)] == want(texts)
    assert same(one[:1]) and same([]) and same(["", " ", "a\n"])
    gc.collect()
    before = sys.getallocatedblocks()
    assert same(one) and same(one[::-1])
    gc.collect()
    assert sys.getallocatedblocks() - before < 5_000
    monkeypatch.setattr(token_files, "GENERATION", 100)
    assert same(other) and len(kept["pieces"].pieces) == len({p for t in one + other for p in t.split()[1:]})
    assert same(other) and len(kept["pieces"].pieces) == len({p for t in other for p in t.split()[1:]})
    assert same(one)


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts.prefix_counter(path)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in odd_texts():
        assert own.count(text) == n(text)
    rnd = random.Random(8)
    bits = list("abcdelvrstmABC    \n\t\r'.,!?01é你🙂 ≮Σςİ") + [" ", "　", "\xad", "\u200d", "\u200b", "<|endoftext|>", "<|startoftext|>", "<|endof", "|>", "'re", "'ll", "'v", "e\u0301", "\u0301", "\u0323", "\x1c", "\x85", "\x00", "한", "\u1112\u1161\u11ab", "\u09c7\u09be"]
    for text in odd_texts()[:60] + ["".join(rnd.choices(bits, k=rnd.randint(0, 40))) for _ in range(300)]:
        counts = [n(text[:i]) for i in range(len(text) + 1)]
        assert own.prefix_table(text) == counts and own.count(text) == counts[-1]
        for budget in (0, 1, 4, 9, 10**6):
            most = max(i for i, c in enumerate(counts) if c <= budget)
            cut = own.truncate(text, budget)
            assert counts[cut] <= budget and not regex.search(f"[^{bpe.SPACE}]", text[cut:most])
    text = prose(random.Random(4), 200)
    for budget in (0, 1, 57, 10**6):
        cut = own.truncate(text, budget)
        assert n(text[:cut]) <= budget and (cut == len(text) or n(text[: text.find(" ", cut + 1) if text.find(" ", cut + 1) > 0 else len(text)]) > budget)
    got = Counter(tuple(r) for r in token_counts.count_documents(docs, path, limit=100).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()), n(r[1] or ""), n(r[1] or "") > 100) for r in corpus())
    assert token_counts.count_documents(none, path).collect() == []


def test_token_counts_of_long_words():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rnd = random.Random(3)
    for letters in ("etaoinshrdlu", "=", "的一是不了人我在有他"):
        text = "".join(rnd.choices(letters, k=20_000))
        assert own.count(text) == n(text)
        assert sum(map(len, own.table.heads)) < 100_000 and not own.words
    for text in ("".join(rnd.choices("etaoins", k=300)), "it's'll!'s--" * 9, "的一是不了人我在" * 20, "İStraßeÀé" * 12, "e\u0301a\u0302한국어" * 9, "one two " + "abcde" * 40):
        counts = [n(text[:i]) for i in range(len(text) + 1)]
        assert own.prefix_table(text) == counts
        for budget in (0, 1, 7, 20, 10**6):
            assert own.truncate(text, budget) == len(text[: max(i for i, c in enumerate(counts) if c <= budget)].rstrip(" "))


# 6: exact copies


def brute_exact(rows) -> dict:
    best, size = {}, Counter()
    for r in rows:
        key = normal(r[1])
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best[key] = min(best.get(key, rank), rank)
        size[key] += 1
    return {k: (None if v[1] else v[2], size[k]) for k, v in best.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, none, weak):
    """Also with a digest of one character, so that full bytes must tell texts apart."""
    digest = (lambda t: F.substring(F.sha2(t, 256), 1, 1)) if weak else None
    got = exact_dedup.exact_groups(docs, digest).collect()
    want, text = brute_exact(corpus()), {hashlib.sha256(normal(r[1]).encode()).hexdigest(): normal(r[1]) for r in corpus()}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in corpus())
    kept = Counter()
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[text[r["text_sha256"]]]
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(want)
    assert exact_dedup.exact_groups(none, digest).collect() == []


def test_exact_in_batches_and_stage(docs):
    once = Counter(map(tuple, exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "text_sha256").collect()))
    assert once == Counter(map(tuple, exact_dedup.exact_groups(docs, files_per_batch=1).select("doc_id", "keep_id", "group_size", "text_sha256").collect()))
    clash = docs.withColumn("locator", F.lit(1)).withColumn("LOCATOR_", F.lit(1))
    left = exact_dedup.drop_exact_duplicates(clash)
    assert left.columns == clash.columns
    want = Counter(v[0] for v in brute_exact(corpus()).values())
    assert Counter(r["doc_id"] for r in left.collect()) == want
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).collect() == []


# 7: fingerprints


def test_fingerprints(docs, none):
    got = fingerprints.fingerprint_edits(docs, bytes_per_task=4000).collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is None, -(r[0] or 0), -text_hash(r[1])))
    want = Counter()
    exact = defaultdict(list)
    for i, r in enumerate(rows):
        text, following = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        edited = fingerprints.edited_text(text, following)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want[r[0], len(text), sha] += 1
        s = [set(bag_of(t)) for t in (text, edited, following)]
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        exact[r[0], sha].append((jaccard(s[0], s[1]), jaccard(s[0], s[2])))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    for r in got:  # small texts: the sketches hold everything
        if r["n_chars"] < 1500:
            assert any(e == pytest.approx((r["near_edited"], r["near_next"])) for e in exact[r["doc_id"], r["edited_sha256"]])
    plain = {(r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprint_documents(docs).collect()}
    assert plain == {(r["doc_id"], r["fingerprint"]) for r in got}
    assert fingerprints.fingerprint_edits(none).collect() == []


def test_fingerprints_of_repeated_ids(spark):
    """A third of the rows has one doc_id, another none; the least long is an id like others."""
    rows = [(i, f"text of number {i} here") for i in range(100)] + [(7, f"one of many texts {i}") for i in range(150)] + [(None, f"no id {i}") for i in range(120)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bytes_per_task=1000).collect()
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), -text_hash(r[1])))
    edits = [fingerprints.edited_text(t, ordered[(i + 1) % len(ordered)][1]) for i, (_, t) in enumerate(ordered)]
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == Counter((k, hashlib.sha256(e.encode()).hexdigest()) for (k, _), e in zip(ordered, edits))


def test_sketch_estimates_and_merges():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 1 << 64, 30000, dtype=np.uint64)
    a, b = pool[:20000], pool[10000:30000]
    sa, sb = fingerprints.sketch(np.concatenate([a, a])), fingerprints.sketch(b)
    assert (sa == fingerprints.sketch(a)).all()
    assert abs(fingerprints.resemblance(sa, sb) - 1 / 3) < 0.12
    assert abs(fingerprints.containment(sa, sb) - 0.5) < 0.15
    assert abs(fingerprints.distinct(sa) / 20000 - 1) < 0.25
    assert (fingerprints.merge(sa, sb) == fingerprints.sketch(pool)).all()
    assert (fingerprints.from_text(fingerprints.to_text(sa)) == sa).all()


# 10: secrets


def brute_base(text: str):
    text = text or ""
    out = []
    for k, (kind, pattern, group, least) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return sorted(out)


def test_secrets(spark, none):
    rnd = random.Random(9)
    bits = ["password", "PassWD", "secret", "Token", "api_key", "apikey", '"', "'", " ", ":", "=", "é🙂", "\n", "AKIA" + "X1" * 8, "AKIA12", "deadbeef" * 3, "0123456789abcdef", "hunter2x", "a1", "ſecret", "toKen", "K"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randint(0, 14)))) for i in range(500)] + [(900, None), (901, ""), (902, "x" * 100_000 + " token=" + "Ab9_" * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in secret_scan.scan_documents(df).collect()}
    for i, text in rows:
        base = brute_base(text)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(secret_scan.joined(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[1] == k for b in base) for k in range(3)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(secret_scan.joined(base).split(",") if base else []) <= set(spans)
    assert secret_scan.scan_documents(none).collect() == []


def test_assignments_are_followed():
    found = lambda t: [t[a:b] for a, b, _ in secret_scan.named_spans(t)]
    assert found('DB_PWD = "hunt3r-Xy9"') == ["hunt3r-Xy9"]
    assert found("k = 'Zx81-qwe-77ab'\nother = k\nclientSecret: other") == ["Zx81-qwe-77ab"]
    assert found('<add key="private_key" value="none"/> private_key: ${OTHER}\nOTHER=abc123DEF456') == ["abc123DEF456"]
    assert found("a = b\nb = a\npassphrase = a") == []
    assert found('password = "changeme"; title = "Q7w8-e9r0-t1y2"; note: words only here') == []
    assert found("She said: nothing = of that") == []


SECRET = "hunt3r-Xy9Zq"
FORMS = [
    (f'os.environ["DB_PASSWORD"] = "{SECRET}"', 1),
    (f"password =\n    '{SECRET}'\n", 1),
    (f"client_secret:\n  {SECRET}\nuser: bob", 1),
    (f"client_secret:\n  {SECRET}: 3", 0),
    (f'<add key="private_key" value="{SECRET}"/>', 1),
    (f"<clientSecret>{SECRET}</clientSecret>", 1),
    (f'password: str = "{SECRET}"', 1),
    (f'X = "{SECRET}"\npassword = os.environ["X"]', 1),
    (f'password = getenv("NOPE", "{SECRET}")', 1),
    (f'token = """{SECRET}"""', 1),
    (f"don't: password = '{SECRET}' it's", 1),
    (f"a = 'oth3r-Val99'\na = '{SECRET}'\nsecret = a\na = 'oth3r-Val99'", 1),
    (f"secret = a\na = '{SECRET}'\na = 'oth3r-Val99'", 1),
    (f'conn = "Server=x;Password={SECRET};Db=y"', 1),
    (f'j = "{{\\"client_secret\\": \\"{SECRET}\\"}}"', 1),
    (f"password = ${{FOO:-{SECRET}}}", 1),
    (f"api-key: `{SECRET}`", 1),
    (f"self.apiKey := {SECRET};", 1),
    (f"'token' => '{SECRET}'", 1),
    (f"secret = '%OTHER%'\nOTHER='{SECRET}'", 1),
    (f"secret = {{{{ vault.item }}}}\nvault.item = '{SECRET}'", 1),
    ("token = base64.b64decode(x)", 0),
    (f'password = ("{SECRET}"\n  "{SECRET}")', 2),
]


@pytest.mark.parametrize("text, n", FORMS)
def test_assignment_forms(text, n):
    for around in ("{}", "words before it's {}\nwords; after", "{}\n# title: 'Q7w8-e9r0-t1y2'\n"):
        whole = around.replace("{}", text)
        assert [whole[a:b] for a, b, _ in secret_scan.named_spans(whole)] == [SECRET] * n


def test_generated_assignments():
    """Files of assignments against what they were made from: references go to the last value before, else the first after."""
    rnd = random.Random(12)
    for _ in range(200):
        names = [rnd.choice(["alpha", "beta", "gamma", "db_password", "clientSecret", "API_KEY"]) for _ in range(rnd.randint(1, 30))]
        lines, values = [], []
        for i, name in enumerate(names):
            ref = rnd.random() < 0.5
            value = rnd.choice(names) if ref else "Zx%04d-qW7" % i
            values.append((name, value, ref))
            lines.append(rnd.choice(['{} = {}', 'export {}={}', '{}: {}', '"{}" : {},', 'x["{}"] = {};']).format(name, ("${%s}" % value) if ref else rnd.choice(['"%s"', "'%s'", "`%s`"]) % value))
        text = "\n".join(lines)
        want = set()
        for i, (name, _, _) in enumerate(values):
            if name not in ("alpha", "beta", "gamma"):
                at, seen = i, set()
                while at is not None and values[at][2] and at not in seen:
                    seen.add(at)
                    others = [k for k, v in enumerate(values) if v[0] == values[at][1] and k != at]
                    at = max((k for k in others if k < at), default=min(others, default=None))
                if at is not None and at not in seen:
                    want.add(values[at][1])
        assert {text[a:b] for a, b, _ in secret_scan.named_spans(text)} == want


@pytest.mark.parametrize("text", ["\"\\" * 50_000 + "token=", "password = '\n" * 30_000, "token:" * 50_000, "<a token" * 50_000, "password:" + "\n" * 200_000, 'token="a"' + '+"b"' * 50_000, "a:" * 50_000 + "token=x", "".join(f"a{i} = a{i - 1}\nsecret{i} = a{i}\n" for i in range(20_000))])
def test_lexer_time_is_linear(text):
    began = time.process_time()
    secret_scan.named_spans(text)
    assert time.process_time() - began < 20


def test_assignments_of_any_length():
    found = lambda t: [t[a:b] for a, b, _ in secret_scan.named_spans(t)]
    long = "".join(random.Random(5).choices("abcdefXYZ0123456789+/", k=300_000))
    assert found(f'client_secret = "{long}"') == [long]
    assert found(f"client_secret = '{long}") == []
    assert found(f"client_secret={long}\nx = 1") == [long]
    for blanks in (" " * 9, "\t" * 40, " " * 100_000):
        assert found(f'client_credentials{blanks}={blanks}"hunt3r-Xy9"') == ["hunt3r-Xy9"]
    assert found(f'client_secret = "{long * 4}"') == [long * 4]  # 1.2 MB
    name = "client_secret_" + "of_a_part_" * 30
    assert found(f'"{name}": "hunt3r-Xy9"') == ["hunt3r-Xy9"]
    assert found(f"{name} = hunt3r-Xy9") == ["hunt3r-Xy9"]
    # Bare literals that hold separators overlap; each ends where the run does.
    run = "&".join(f"client_secret=aB3-{i}" for i in range(20_000))
    got = secret_scan.named_spans(run)
    assert len(got) == 20_000 and {b for _, b, _ in got} == {len(run)}
    for a, b, score in got[::4000] + got[-5:]:
        assert score == pytest.approx(secret_scan.literal_worth(run[a:b]))


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [r[:5] for r in corpus() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    keep = {v[0] for v in brute_exact(lettered).values()}
    left = {r[0]: r for r in lettered if r[0] in keep}
    classes = brute_classes(list(left.values()))
    reps = set(classes.values())
    assert {r["doc_id"] for r in got} <= reps
    library = tiktoken_encoding()
    assert all(list(r["ids"]) == library.encode_ordinary(left[r["doc_id"]][1]) for r in got)
    assert max(Counter(r["doc_id"] for r in got).values()) <= 2
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty}/documents.parquet")
    assert pipeline.run(spark, empty).collect() == []
    assert [n for n, _ in pipeline.STAGES] == ["language", "exact", "near", "mixture", "tokens"]
