"""What keeps work and memory in step with the input: shuffles, batches, values computed once."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import folds, margins, search
from pagewright.plans import catalogue
from pagewright.sources import recognise

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_queries_held_by_texts(spark, monkeypatch, most):
    """Few queries go to every task; of many, places are met without their texts."""
    monkeypatch.setattr(search, "MOST_BROADCAST", most)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choices(words, k=60))) for i in range(60)] + [(60, None), (61, "")]
    queries = [(i, " ".join(texts[i][1].split(" ")[10:18]).upper()) for i in range(30)] + [(98, "w1 w2"), (99, "no such words in any of these texts")]
    found = search.holding(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, query string"))
    want = sorted((d, i) for d, t in texts for i, q in queries if t and q.lower() in t.lower())
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == want
    if most:
        assert shuffles(found) == 0


def test_recognised_words_come_in_batches():
    page = " ".join(["word"] * 10_000).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([1, 2]), pa.array([page, page], pa.binary())], names=["doc_id", "page", "image"])
    sizes = [b.num_rows for b in recognise._word_batches(iter([batch]), recognise.WordsInBytes())]
    assert sum(sizes) == 20_000 and max(sizes) <= recognise.BATCH_WORDS


def test_appearance_is_split_once(spark):
    df = spark.range(1).select(T.appearance_style(F.concat(F.lit("/Helv 12 Tf 0 g "), F.col("id").cast("string"))).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_strips_as_one_by_one(spark):
    rng = random.Random(2)
    strips = []
    for _ in range(300):
        width, rows = rng.choice([(5, 4), (9, 8), (1, 1)])
        dense = rng.choice([0.0, 0.3, 0.8])
        pixels = b"".join(rng.choice([b"\0\0\0\xff"]) if rng.random() < dense else b"\xff" * 4 for _ in range(width * rows))
        strips.append((rng.choice([pixels] * 8 + [None, b"xyz"]), width, 40, rows, rng.randrange(30)))
    columns = tuple(pa.array(c, t) for c, t in zip(zip(*strips), (pa.binary(), *[pa.int32()] * 4)))
    (got,) = margins._profiles(iter([columns]))
    assert got.to_pylist() == [None if s[0] is None else margins.profile(*s) for s in strips]


def test_shuffles_of_strips(spark):
    assert shuffles(catalogue.queries()["g24_margins"](spark, DATA)) <= 2


@pytest.mark.parametrize("name", ["e04_anchored_lines", "h24_lines_text", "e06_merge_runs", "e05_text_runs"])
def test_orders_are_shuffled_once(spark, name):
    assert shuffles(catalogue.queries()[name](spark, DATA)) == 1


def test_many_boxes(spark):
    """Beyond MANY_BOXES boxes come from arrays, the same ones."""
    rng = random.Random(3)
    rects = [tuple(rng.uniform(0, 400) for _ in range(2)) + tuple(rng.uniform(1, 6) for _ in range(2)) for _ in range(300)]
    boxes: list[list[float]] = []
    for x, y, w, h in rects:
        for b in boxes:
            if min(b[3], y + h) - max(b[1], y) > 0.5 * min(b[3] - b[1], h):
                b[:] = min(b[0], x), min(b[1], y), max(b[2], x + w), max(b[3], y + h)
                break
        else:
            boxes.append([x, y, x + w, y + h])
    assert len(boxes) > folds.MANY_BOXES
    assert folds._merged(*map(list, zip(*rects))) == sorted(boxes, key=lambda v: (v[1], v[0]))
    rows = spark.createDataFrame([(1, [rects[0]]), (2, []), (3, None)], "k int, r array<struct<x:double,y:double,width:double,height:double>>")
    got = dict(rows.select("k", folds.merge_runs(F.col("r")).alias("m")).collect())
    assert len(got[1]) == 1 and got[2] == [] and got[3] is None


def test_fonts_of_a_node_above_many_pages(spark):
    """Objects leave the parser without a shuffle, and fonts are read once per object that has them."""
    from pagewright.lineage import Rounds
    from pagewright.plans.objects import files
    from pagewright.sources import objects as O

    parsed = O.parse_objects(files(spark, DATA))
    assert shuffles(parsed) == shuffles(files(spark, DATA))
    table, _ = Rounds(spark).keep(parsed)
    pages, n = Rounds(spark).keep(O.page_rows(table).where("page IS NOT NULL"))
    fonts = O.fonts_of(pages, table)
    assert fonts.count() == pages.select("path").distinct().count() < n
    assert {f["name"] for r in fonts.collect() for f in r["fonts"]} == {"F1"}


def test_hash_of_a_password_repeats_by_copying(spark):
    """Values that a round uses again have names: one piece of work a round."""
    from pagewright.functions import protection as X

    one = X.hardened(F.lit(b"a"), F.lit(b"saltsalt"))
    df = spark.range(1).select(one.alias("h"))
    said = df._jdf.queryExecution().analyzed().toString()
    assert "repeat(" not in said and said.count("aes_encrypt(") == 1
