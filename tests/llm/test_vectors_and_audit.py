"""Vector codes, vector links and the filter audit against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from pagewright.llm import embedding_links, filter_audit, heap_lloyd  # noqa: E402
from pagewright.llm.vectors import finite_rows  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, code string, n int, dim string, loc long, digest string"
EXTRA = ("x", 1, "y", 2, "z")


def near(rnd: random.Random, v: list[float], by: float) -> list[float]:
    return [x + rnd.gauss(0, by) for x in v]


def vector_rows(dim: int = 24, n: int = 150) -> list[tuple]:
    """Random vectors, a group of near copies, exact copies, scaled copies, ties and odd rows."""
    rnd = random.Random(dim)
    rows = [(i * 7 % 997, [rnd.gauss(0, 0.2) for _ in range(dim)], rnd.choice([1, 2, 2, 2, None])) for i in range(n)]
    base = [rnd.gauss(0, 0.2) for _ in range(dim)]
    rows += [(2000 - i, near(rnd, base, 0.02), 1) for i in range(40)] + [(3000 + i, base, 2) for i in range(30)]
    chain = base
    for i in range(12):  # neighbours link, ends don't
        chain = near(rnd, chain, 0.03)
        rows.append((4000 + i, chain, 2))
    rows += [(5000, [2 * x for x in base], 3), (5001, [-x for x in base], 3), (5002, [0.0] * dim, 3), (5003, None, 3), (5004, [math.nan, *base[1:]], None), (5005, [math.inf, *base[1:]], None), (5006, [None, *base[1:]], 1)]
    rows += [(5007, [], 1), (5007, base, 1), (3000, base, 2), (None, base, None), (None, [1.0] + [0.0] * (dim - 1), None), (5008, base[:8], 3), (5009, base[:8], 3), (5010, [1e30] * dim, 3), (5011, [1e-30] * dim, 4)]
    return [(*r[:2], r[2], *EXTRA) for r in rows]


def test_finite_rows():
    got = {r: v.tolist() for rows, x in finite_rows(pa.array([[1.0, 2.0], None, [], [None, 1.0], [3.0], [math.nan, 1.0], [math.inf, 0.0], [4.0, 5.0]]).slice(1)) for r, v in zip(rows.tolist(), x)}
    assert got == {1: [], 3: [3.0], 6: [4.0, 5.0]}


# 11: codes


def whole(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_codes(rows: list[tuple], parts: int = 8, k: int = 16, rounds: int = 6) -> list[tuple]:
    rows = sorted(((r[0], np.float32(r[1]).tolist(), r[2]) for r in rows if whole(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    dim = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == dim]
    whole_numbers = [[math.floor(4096 * x) if abs(x) < 1e9 else 4096 * int(x) for x in r[1]] for r in rows]
    cut = [dim * p // parts for p in range(parts + 1)]
    part = [[w[a:b] for w in whole_numbers] for a, b in zip(cut, cut[1:])]
    books = [[p[i] for i in range(min(k, len(rows)))] for p in part]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(b)), key=lambda j: (d(v, b[j]), j)) for v in p] for p, b in zip(part, books)]
    for _ in range(rounds):
        for p, b, chosen in zip(part, books, assign()):
            for j in range(len(b)):
                mine = [v for v, c in zip(p, chosen) if c == j]
                if mine:
                    b[j] = [sum(x) // len(mine) for x in zip(*mine)]
    chosen = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d(part[p][i], books[p][chosen[p][i]]) for p in range(parts)) for i in range(len(rows))]
    label = Counter()
    for r, e in zip(rows, error):
        label[r[2]] += e
    most = (1 << 63) - 1
    return [(r[0], "".join(f"{chosen[p][i]:02x}" for p in range(parts)), min(most, error[i]), min(most, label[r[2]]), sha) for i, r in enumerate(rows)]


def by_repr(rows) -> list:
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("dim,n", [(24, 150), (20, 150), (16, 9)])
def test_codes(spark, monkeypatch, dim, n):
    monkeypatch.setattr(heap_lloyd, "BLOCK_ROWS", 64)
    rows = [r for r in vector_rows(dim, 150) if r[0] != 5010]
    rows = rows if n > 100 else rows[:n]
    got = heap_lloyd.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert by_repr(got.collect()) == by_repr(brute_codes(rows))


def test_codes_of_large_numbers_and_empty_tables(spark):
    rows = [r for r in vector_rows(16, 40) if r[0] is not None]
    got = heap_lloyd.vector_codes(spark.createDataFrame(rows, VECTORS))
    assert by_repr(got.collect()) == by_repr(brute_codes(rows))  # 1e30 among them
    for odd in ([], [(1, None, 1, *EXTRA)]):
        assert heap_lloyd.vector_codes(spark.createDataFrame(odd, VECTORS)).collect() == []
    assert [r["code"] for r in heap_lloyd.vector_codes(spark.createDataFrame([(1, [], 1, *EXTRA)], VECTORS)).collect()] == ["00" * 8]


def test_heap_pops_what_is_violated():
    rnd = np.random.default_rng(3)
    keys = np.sort(rnd.random(500))
    for limit in (-1.0, 0.0, float(keys[0]), 0.3, 2.0):
        assert sorted(heap_lloyd.violated(keys, limit).tolist()) == np.flatnonzero(keys <= limit).tolist()
    assert heap_lloyd.violated(np.zeros(0), 1.0).tolist() == []


def test_bounds_spare_comparisons(monkeypatch):
    """In late rounds few parts are compared anew, and the assignment is that of a whole comparison."""
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-4000, 4000, (16, 8))
    comps = (centres[rnd.integers(0, 16, 3000)] + rnd.integers(-200, 200, (3000, 8))).astype(np.int64)
    books = heap_lloyd.Books(comps[:16], 1)
    every = np.arange(len(comps))
    best, _, key = heap_lloyd.nearest(comps, books.entries[0])
    heap = heap_lloyd.Heaps([np.zeros(0)] * 16, [np.zeros(0, np.int64)] * 16)
    heap.push(every, best, key)
    popped = []
    for _ in range(8):
        books.sums[0] = [[int((best == j).sum()), *comps[best == j].sum(axis=0).tolist()] for j in range(16)]
        books.move()
        rows, _ = heap.pop(books.drift[0])
        popped.append(len(rows))
        new, _, key = heap_lloyd.nearest(comps[rows], books.entries[0])
        heap.push(rows, new, key + np.array(books.drift[0])[new])
        best[rows] = new
        assert (best == heap_lloyd.nearest(comps, books.entries[0])[0]).all()
    assert popped[-1] < len(comps) / 3


# 13: links


def brute_links(rows: list[tuple], least: float = 0.95) -> list[tuple]:
    n = len(rows)
    of, count = list(range(n)), [0] * n
    vectors = [np.float32(r[1]).astype(float) if whole(r[1]) and any(r[1]) else None for r in rows]
    unit = [None if v is None else v / np.abs(v).max() for v in vectors]
    unit = [None if v is None else v / math.sqrt(v @ v) for v in unit]

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
            count[i] += 1
            count[j] += 1
            of[root(i)] = root(j)
    ids: dict[int, list] = {}
    for i in range(n):
        ids.setdefault(root(i), []).append(rows[i][0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(rows[i][0], count[i], first[root(i)], rows[i][0] == first[root(i)]) for i in range(n)]


@pytest.mark.parametrize("dim,grid,chunk", [(24, 0, 4096), (24, 2, 4096), (24, 3, 16), (20, 1, 8), (5, None, 32), (64, 4, 64)])
def test_links(spark, dim, grid, chunk):
    rows = vector_rows(max(dim, 9), 120) if dim > 8 else [(i, [random.Random(i).gauss(0, 1) for _ in range(dim)], 1, *EXTRA) for i in range(150)]
    got = embedding_links.vector_links(spark.createDataFrame(rows, VECTORS).repartition(3), grid=grid, chunk_rows=chunk)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert by_repr(got.collect()) == by_repr(brute_links(rows))


@pytest.mark.parametrize("least", [0.5, 0.8, 0.999])
def test_links_at_other_cosines(spark, least):
    rows = vector_rows(16, 100)
    assert by_repr(embedding_links.vector_links(spark.createDataFrame(rows, VECTORS), least, grid=2).collect()) == by_repr(brute_links(rows, least))


def test_links_of_empty_tables_and_what_is_kept(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embedding_links.vector_links(none).collect() == [] and embedding_links.drop_near_vectors(none).collect() == []
    odd = spark.createDataFrame([(3, None, 1, *EXTRA), (4, [0.0], 1, *EXTRA), (None, None, 1, *EXTRA)], VECTORS)
    assert by_repr(embedding_links.vector_links(odd).collect()) == [(3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)]
    rows = vector_rows()
    left = embedding_links.drop_near_vectors(spark.createDataFrame(rows, VECTORS))
    assert left.columns == [f.split()[0] for f in VECTORS.split(", ")]
    assert Counter(r["vec_id"] for r in left.collect()) == Counter(r[0] for r in brute_links(rows) if r[3])


def test_every_near_pair_shares_a_block():
    """Of pairs just over the threshold, each is within the share of one block at least, and meets in the cell of its middle."""
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((4000, 64))
    y = x + rnd.standard_normal((4000, 64)) * 0.3
    x, y = (embedding_links.unit(v) @ embedding_links.rotation(64) for v in (x, y))
    fine = (x * y).sum(axis=1) >= 0.95
    assert 500 < fine.sum() < 4000
    shares = embedding_links.budgets(64, 0.95)
    within = np.stack([((x - y)[:, a:b] ** 2).sum(axis=1) <= s for (a, b), s in zip(embedding_links.blocks_of(64), shares)], axis=1)
    assert within[fine].any(axis=1).all()
    width = 2 * shares[0] ** 0.5
    of = [[{tuple(c) for c in cell[rows == i].tolist()} for i in range(300) for rows, cell in [merged]] for v in (x, y) for merged in [tuple(map(np.concatenate, zip(*embedding_links.cells(v[:300, :8], width, 3))))]]
    middle = np.floor((x + y)[:300, :3] / 2 / width).astype(int)
    for i in np.flatnonzero(within[:300, 0]):
        assert tuple(middle[i]) in of[0][i] & of[1][i]


# 12: filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, step int, good boolean, part string"


def filter_rows() -> tuple[list[tuple], list[tuple]]:
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["Alpha", "BETA", "gamma", "delta", "x&y", "plain", f"w{rnd.randrange(200)}"][: rnd.choice([5, 7])]) for _ in range(rnd.choice([3, 90, 99, 100, 101, 160]))) for _ in range(60)]
    texts += [" ".join(f"word{i}" for i in range(150)), " ".join(["AB"] + [f"W{i}" for i in range(120)]), "", None, None, " \n\t", "one" + " two", "é" * 50_000, "a b " * 30_000, "𝒳 " * 120, "A" + "𝒳" * 9, "A" + "𝒳" * 8]
    docs = [(i * 5 % 97, t, rnd.choice(["en", "fr", None, ""])) for i, t in enumerate(texts)]
    docs += [(200 + i, texts[0], "en") for i in range(30)] + [(7, texts[1], "fr"), (7, texts[1], "fr"), (None, texts[0], "de"), (None, None, "de")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 97, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (5000, 1, 1)]
    return [(*d, "a", 1, 9, 9, True, "q") for d in docs], labels


def brute_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    first: dict[str, int] = {}
    for d in docs:
        if d[0] is not None:
            first[d[1] or ""] = min(d[0], first.get(d[1] or "", d[0]))
    facts = []
    for d in docs:
        text = d[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d[0] is not None and d[0] > first[text]}
        facts.append((d[2] or "", fails, any(x[0] == d[0] and x[1] == 1 for x in labels if d[0] is not None), any(x[0] == d[0] and x[2] == 1 for x in labels if d[0] is not None)))
    out: Counter = Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, fails, good, toxic in facts:
            failing = [x for x in order if fails[x]]
            for k, x in enumerate(order, 1):
                at = order.index(failing[0]) + 1 if failing else 6
                key = (part, order, k)
                for name, yes in (("kept", at > k), ("removed", at == k), ("redundant", fails[x] and at < k), ("unique", failing == [x]), ("good", at == k and good), ("toxic", at == k and toxic)):
                    out[(*key, name)] += yes
    shapley: Counter = Counter()
    for part, order, k in {x[:3] for x in out}:
        shapley[part, order[k - 1]] += out[part, order, k, "removed"]
    return [(*key, *(out[(*key, n)] for n in ("kept", "removed", "redundant", "unique", "good", "toxic")), shapley[key[0], key[1][key[2] - 1]]) for key in {x[:3] for x in out}]


def test_audit(spark):
    docs, labels = filter_rows()
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    assert len(rows) == 600 * len({d[2] or "" for d in docs})
    assert by_repr(rows) == by_repr(brute_audit(docs, labels))


def test_audit_of_empty_tables(spark):
    docs, labels = filter_rows()
    no_docs, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(no_docs, spark.createDataFrame(labels, no_labels.schema)).collect() == []
    rows = filter_audit.audit(spark.createDataFrame(docs, DOCS), no_labels).collect()
    assert by_repr(rows) == by_repr(brute_audit(docs, []))
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)
