"""Folds against plain loops, parsers against hand-made bytes, guards, sources and streams."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.functions import binary as B
from pagewright.functions import cms, labels
from pagewright.functions import text as T
from pagewright.operators import fields, folds, pages, scrub, search, trees
from pagewright.plans import catalogue
from pagewright.sources import pdf
from pagewright.streaming import search as stream


def boxes(seed: int, n: int = 40) -> list[tuple]:
    rnd = random.Random(seed)
    return [(float(rnd.randrange(0, 200)), float(rnd.randrange(0, 60)), float(rnd.randrange(2, 30)), float(rnd.randrange(4, 20))) for _ in range(n)]


def test_merge_runs(spark):
    for seed in range(5):
        want: list[list[float]] = []
        for x, y, w, h in boxes(seed):
            for b in want:
                if min(b[1] + b[3], y + h) - max(b[1], y) > 0.5 * min(b[3], h):
                    x0, y0, x1, y1 = min(b[0], x), min(b[1], y), max(b[0] + b[2], x + w), max(b[1] + b[3], y + h)
                    b[:] = [x0, y0, x1 - x0, y1 - y0]
                    break
            else:
                want.append([x, y, w, h])
        df = spark.createDataFrame([(boxes(seed),)], "r array<struct<x:double,y:double,width:double,height:double>>")
        got = df.select(folds.merge_runs(F.col("r")).alias("m")).first()["m"]
        assert [list(b) for b in got] == sorted(want, key=lambda b: (b[1], b[0]))


def test_text_runs(spark):
    rnd = random.Random(4)
    chars = [(rnd.choice("ab "), float(6 * i + rnd.choice([0, 0, 0, 9])), rnd.choice([10.0, 10.0, 14.0, 30.0]), 5.0, 10.0, rnd.choice([12.0, 12.0, 12.3, 20.0])) for i in range(60)]
    want: list[list] = []
    for t, x, y, w, h, s in chars:
        last = want[-1] if want else None
        if last and abs(last[5] - s) < 0.5 and abs(last[2] - y) < last[4] * 0.5 and x - (last[1] + last[3]) < s * 0.5:
            x0, y0, x1, y1 = min(last[1], x), min(last[2], y), max(last[1] + last[3], x + w), max(last[2] + last[4], y + h)
            last[:] = [last[0] + t, x0, y0, x1 - x0, y1 - y0, last[5]]
        else:
            want.append([t, x, y, w, h, s])
    df = spark.createDataFrame([(chars,)], "c array<struct<text:string,x:double,y:double,width:double,height:double,size:double>>")
    assert [list(r) for r in df.select(folds.text_runs(F.col("c")).alias("r")).first()["r"]] == [r for r in want if r[0].strip()]


def test_wrapped(spark):
    width = dict(enumerate(T.ASCII_WIDTHS, 32))
    measure = lambda s: 12.0 * sum(width[ord(c)] for c in s) / 1000.0
    text = "the quick brown fox jumps\n\nover averyveryverylongwordthatoverflows and the lazy dog again and again"
    want = []
    for paragraph in text.split("\n"):
        line = ""
        for word in paragraph.split(" "):
            longer = f"{line} {word}" if line else word
            if not line or measure(longer) <= 96.0:
                line = longer
            else:
                want.append(line)
                line = word
        want.append(line)
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(folds.wrapped(F.col("t"), F.lit("Helvetica"), F.lit(12.0), F.lit(100.0)).alias("w")).first()["w"] == want


def test_recognised_words_to_lines(spark):
    words = "struct<text:string,x:double,y:double,width:double,height:double>"
    rows = [([("World", 40.0, 100.0, 9.0, 10.0), ("Bye", 10.0, 50.0, 9.0, 10.0), ("Hello", 10.0, 100.0, 9.0, 10.0)],), ([("a", 10.0, 100.0, 9.0, 10.0), ("b", 50.0, 103.0, 9.0, 10.0)],)]
    df = spark.createDataFrame(rows, f"w array<{words}>")
    got = [r["t"] for r in df.select(folds.line_text(folds.anchored_lines(F.col("w"), words)).alias("t")).collect()]
    assert got == ["Hello World\nBye", "a b"]


def test_folds_of_a_page_of_100_000_words(spark):
    """One pass each: a page of very many words takes seconds."""
    n, line = 100_000, 50
    word = F.struct(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), (F.col("id") % line * 9.0).alias("x"), (-F.floor(F.col("id") / line) * 12.0).alias("y"), F.lit(8.0).alias("width"), F.lit(10.0).alias("height"), F.lit(9.0).alias("size"))
    page = spark.range(n).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", word.alias("w")))), lambda p: p["w"]).alias("w"))
    kind = "struct<text:string,x:double,y:double,width:double,height:double,size:double>"
    began = time.time()
    row = page.select(
        F.size(folds.anchored_lines(F.col("w"), kind)).alias("lines"), F.size(folds.text_runs(F.col("w"))).alias("runs"), F.size(folds.merge_runs(F.col("w"))).alias("boxes"),
        F.size(folds.wrapped(F.array_join(F.transform("w", lambda w: w["text"]), " "), F.lit("Helvetica"), F.lit(12.0), F.lit(300.0))).alias("wrapped"),
    ).first()
    assert (row["lines"], row["boxes"]) == (n // line, n // line) and row["runs"] == n // line and row["wrapped"] > 10_000
    assert time.time() - began < 30


def test_copied_text(spark):
    tokens = [(1, "a", 1, 0.0, 5.0), (2, "b", 1, 5.5, 9.0), (3, "?", None, None, None), (4, "c", 1, 20.0, 25.0), (5, "d", 2, 0.0, None), (6, "e", 2, 99.0, 100.0), (7, None, None, None, None)]
    df = spark.createDataFrame([(1, *t, 10.0) for t in tokens], "k int, ord int, text string, line long, x double, right double, size double")
    assert [tuple(r) for r in folds.copied_text(df, "k").collect()] == [(1, "ab?\tc\nde")]


def brute_hits(text: str, pattern: str, boxes: list[tuple]) -> list[list[list[float]]]:
    """Boxes of each match: characters in a row on a line make a box, boxes on a line are merged."""
    shares = lambda a, b: min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]) > 0.5 * min(a[3], b[3])
    union = lambda a, b: [min(a[0], b[0]), min(a[1], b[1]), max(a[0] + a[2], b[0] + b[2]) - min(a[0], b[0]), max(a[1] + a[3], b[1] + b[3]) - min(a[1], b[1])]
    out = []
    for m in re.finditer(pattern, text):
        stretches, before = [], None
        for box in (list(boxes[i]) for i in range(m.start(), m.end()) if boxes[i]):
            if before and shares(before, box):
                stretches[-1] = union(stretches[-1], box)
            else:
                stretches.append(box)
            before = box
        merged: list[list[float]] = []
        for s in stretches:
            for k, b in enumerate(merged):
                if shares(b, s):
                    merged[k] = union(b, s)
                    break
            else:
                merged.append(s)
        out.append(sorted(merged, key=lambda b: (b[1], b[0])))
    return out


def test_hit_rectangles(spark, monkeypatch):
    monkeypatch.setattr(search, "CHARS_PER_KEY", 7)
    rnd = random.Random(6)
    words = ["one", "two", "𝒳x", "tw o", "on", "e\ntwo"]
    pages, chars, want = [], [], {}
    for page in range(1, 6):
        text = " ".join(rnd.choice(words) for _ in range(60))
        boxes = [None if rnd.random() < 0.05 else (float(i % 23 * 6 + rnd.choice([0, 2])), float(i // 23 % 4 * 12 + rnd.choice([0, 0, 1, 7])), 6.0, rnd.choice([9.0, 10.0, 14.0])) for i in range(len(text))]
        pages.append((1, page, text))
        chars += [(1, page, i, *(b or (None,) * 4)) for i, b in enumerate(boxes)]
        want[page] = brute_hits(text, r"(?<!\w)one\s+\S+", boxes)
    pages, chars = spark.createDataFrame([*pages, (2, 1, None), (2, 2, "")], "doc_id int, page int, text string"), spark.createDataFrame(chars, "doc_id int, page int, idx int, x double, y double, width double, height double")
    got: dict = {}
    for r in search.search_hits(pages, chars, r"(?<!\w)one\s+\S+", use_regex=True).orderBy("page", "match", "part").collect():
        got.setdefault((r["page"], r["match"]), []).append([r["x"], r["y"], r["width"], r["height"]])
    assert got == {(p, k): boxes for p, all_ in want.items() for k, boxes in enumerate(all_, 1) if boxes}
    assert search.search_hits(pages, chars, "").collect() == [] and search.redaction_regions(pages, chars, [" "]).collect() == []
    assert search.search_hits(pages, chars, "TWO", match_case=True).collect() == []
    assert search.search_hits(pages, chars, "TWO").count() > search.search_hits(pages, chars, "TWO", whole_word=True).count() - 1 > 0


def test_from_search_to_redaction(spark):
    """The hits of a query are the regions of a redaction; afterwards no word of them is left."""
    text = "the secret word is here and SECRET twice"
    spans = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    pages = spark.createDataFrame([(1, 1, text, {"Contents": "x"}), (2, 1, "nothing", {"Contents": "x"})], "doc_id int, page int, text string, keys map<string,string>")
    chars = spark.createDataFrame([(1, 1, i, 6.0 * i, 0.0, 6.0, 10.0) for i in range(len(text))], "doc_id int, page int, idx int, x double, y double, width double, height double")
    words = spark.createDataFrame([(1, 1, k, w, 6.0 * a, 0.0, 6.0 * (b - a), 10.0) for k, (w, a, b) in enumerate(spans)], "doc_id int, page int, ord int, text string, x double, y double, width double, height double")
    docs = spark.createDataFrame([(d, None, {}, {}, {}) for d in (1, 2)], "doc_id int, info map<string,string>, catalogue map<string,string>, names map<string,string>, form map<string,string>")
    fields = spark.createDataFrame([], "doc_id int, node string, parent string, name string")
    notes = spark.createDataFrame([], "doc_id int, page int, widget string, node string")
    regions = search.redaction_regions(pages, chars, ["secret"])
    assert sorted((r["x"], r["width"]) for r in regions.collect()) == [(24.0, 36.0), (168.0, 36.0)]
    result, tables = scrub.redact(docs, pages, words, fields, notes, regions, ["secret"])
    assert {r["doc_id"]: (r["regions"], r["verified"]) for r in result.collect()} == {1: (2, True), 2: (0, True)}
    assert [r["text"] for r in tables["words"].orderBy("ord").collect()] == [w for w, _, _ in spans if w.lower() != "secret"]


@pytest.mark.parametrize(("pattern", "n"), [("Total", 2), ("^Total", 1), ("Total$", 1), ("^Total 5$", 1), ("(?-m)^Total", 1), ("(?-m)Total 5$", 0)])
def test_line_anchors(spark, pattern, n):
    df = spark.createDataFrame([(1, 1, "Total 5\r\nSubtotal Total")], "doc_id int, page int, text string")
    assert [r["n_matches"] for r in search.search_pages(df, pattern, use_regex=True).collect()] == ([n] if n else [])


def test_search_guards(spark):
    df = spark.createDataFrame([(1, 1, "a.b a.b axb \\E x"), (1, 2, None)], "doc_id int, page int, text string")
    assert search.search_pages(df, "").collect() == []
    assert search.search_pages(df, "A.B").first()["n_matches"] == 2
    assert search.search_pages(df, "\\E").first()["n_matches"] == 1
    assert search.search_pages(df, "A.B", match_case=True).collect() == []
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        search.search_pages(df, "(", use_regex=True).collect()


def test_page_guards(spark):
    df = spark.createDataFrame([(1, p) for p in (1, 2, 3)], "doc_id int, page int")
    assert [r["page"] for r in pages.delete_pages(df, df.where("page = 2").union(df.where("page = 2"))).orderBy("page").collect()] == [1, 2]
    with pytest.raises(Exception, match="every page"):
        pages.delete_pages(df, df).collect()
    with pytest.raises(Exception, match="permutation"):
        pages.reorder_pages(df, df.withColumn("new_page", F.lit(1))).collect()
    with pytest.raises(ValueError):
        pages.page_range(df, 3, 2)


def test_search_for_whole_phrases(spark):
    df = spark.createDataFrame([(1, 1, "in New York city, co-op NewYork new york"), (1, 2, "cooperative co-ops"), (1, 3, "x.x.x"), (1, 4, None)], "doc_id int, page int, text string")
    n = lambda q, **how: {r["page"]: r["n_matches"] for r in search.search_pages(df, q, whole_word=True, **how).collect()}
    assert n("New York") == {1: 2} and n("New York", match_case=True) == {1: 1} and n("co-op") == {1: 1}
    assert n("x") == {3: 3} and n("co") == {1: 1, 2: 1} and n("\\E") == {} and n(" york ") == {} and n("") == {}


def test_texts_that_hold_queries(spark):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in "abcde" for b in "xyz"]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(80)] + [(100, None), (101, "")]
    queries = [(k, (t := rnd.choice(texts[:80])[1])[(a := rnd.randrange(len(t) + 1)) : a + rnd.randint(1, 60)]) for k in range(120)]
    got = search.holding(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(queries, "item_id int, query string")).collect()
    want = {(i, k) for i, t in texts for k, q in queries if t and q and q.lower() in t.lower()}
    assert len(got) == len(want) and {(r["doc_id"], r["item_id"]) for r in got} == want
    with pytest.raises(ValueError):
        search.holding(spark.createDataFrame(texts, "doc_id int, text string"), spark.range(2000).select(F.col("id").alias("item_id"), F.lit("short").alias("query")))


def test_deep_trees(spark):
    """A chain of 500, a bush, a cycle, what is below it, and a node whose parent isn't there."""
    rows = [(0, None, "r", "Tx")] + [(i, i - 1, f"n{i}" if i % 3 else "", "Ch" if i == 250 else None) for i in range(1, 501)] + [(1000 + i, 0, f"k{i}", None) for i in range(50)]
    rows += [(2000, 2002, "a", None), (2001, 2000, "b", None), (2002, 2001, "c", None), (2003, 2002, "d", None), (3000, 9999, "lost", None)]
    nodes = spark.createDataFrame(rows, "node int, parent int, part string, type string")
    got = {r["node"]: (r["name"], r["kind"], r["depth"]) for r in trees.field_names(nodes).collect()}
    want, kind = {}, None
    for i in range(501):
        kind = rows[i][3] or kind
        want[i] = (".".join(x[2] for x in rows[: i + 1] if x[2]), kind, i)
    want |= {1000 + i: (f"r.k{i}", "Tx", 1) for i in range(50)}
    assert got == want
    assert {r["node"] for r in trees.unrooted(nodes).collect()} == {2000, 2001, 2002, 2003, 3000}
    live = spark.createDataFrame([(300,), (1003,), (2003,)], "node int")
    up = {r["node"] for r in trees.with_live_descendant(nodes, live).collect()}
    assert up == {*range(301), 1003, 2000, 2001, 2002, 2003}


def redaction_tables(spark):
    maps = "map<string,string>"
    docs = spark.createDataFrame([(1, {"Title": "Secret plan", "Author": "Ann"}, {"Type": "1", "Outlines": "1", "Metadata": "1"}, {"Dests": "1", "JavaScript": "1"}, {"XFA": "1"}), (2, {}, {}, {}, {})], f"doc_id int, info {maps}, catalogue {maps}, names {maps}, form {maps}")
    pages = spark.createDataFrame([(1, 1, {"Annots": "1", "Thumb": "1", "Type": "1"}), (1, 2, {"Annots": "1"}), (2, 1, {})], f"doc_id int, page int, keys {maps}")
    words = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 30.0, 10.0, "secret"), (1, 1, 2, 40.0, 0.0, 30.0, 10.0, "word"), (1, 2, 1, 0.0, 0.0, 30.0, 10.0, "Secrets")], "doc_id int, page int, ord int, x double, y double, width double, height double, text string")
    fields = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", None), (2, "b", None)], "doc_id int, node string, parent string")
    annotations = spark.createDataFrame([(1, 2, "b")], "doc_id int, page int, node string")
    return docs, pages, words, fields, annotations


def test_redaction_chain(spark):
    docs, pages_, words, fields, annotations = redaction_tables(spark)
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 35.0, 12.0)], "doc_id int, page int, x double, y double, width double, height double")
    run = lambda regions, queries: scrub.redact(docs, pages_, words, fields, annotations, regions, queries)
    result, left = run(regions, ["secret "])
    got = {r["doc_id"]: r for r in result.collect()}
    # The query is still on page 2, which no region covers.
    assert (got[1]["regions"], got[1]["pages_flattened"], got[1]["leaks"], got[1]["violations"], got[1]["verified"]) == (1, 1, 1, 0, False) and got[2]["verified"]
    assert [r["text"] for r in left["words"].orderBy("page").collect()] == ["word", "Secrets"]
    assert {r["node"] for r in left["fields"].where("doc_id = 1").collect()} == {"a", "b"} and left["fields"].where("doc_id = 2").count() == 0
    d = left["docs"].where("doc_id = 1").first()
    assert d["info"] == {"Author": "Ann"} and set(d["catalogue"]) == {"Type"} and set(d["names"]) == {"Dests"} and d["form"] == {}
    assert {(r["page"], *sorted(r["keys"])) for r in left["pages"].where("doc_id = 1").collect()} == {(1, "Type"), (2, "Annots")}
    both = regions.union(spark.createDataFrame([(1, 2, 0.0, 0.0, 35.0, 12.0)], regions.schema))
    assert {r["doc_id"] for r in run(both, ["secret"])[0].where("verified").collect()} == {1, 2}
    # Without a query all information goes.
    assert run(both, [" "])[1]["docs"].where("info IS NULL").count() == 2
    with pytest.raises(ValueError):
        run(regions.limit(0), [" "])
    for bad in ((1, 1, 0.0, 0.0, 0.0, 12.0), (1, 7, 0.0, 0.0, 5.0, 5.0)):
        with pytest.raises(Exception, match="region"):
            run(spark.createDataFrame([bad], regions.schema), ["x"])[0].collect()


def test_postconditions_fail_closed(spark):
    docs, pages_, _, fields, annotations = redaction_tables(spark)
    flat = pages_.where("doc_id = 1 AND page = 1").select("doc_id", "page")
    got = {r["violation"] for r in scrub.postconditions(docs, pages_, fields, annotations, flat, ["secret"]).where("doc_id = 1").collect()}
    assert got == {"Info field /Title still contains a redacted term", "catalog /Outlines present", "catalog /Metadata present", "name tree /JavaScript present", "flattened page 1: /Annots present", "flattened page 1: /Thumb present", "form field without a widget (c)", "AcroForm /XFA present"}
    assert "document Info dictionary present" in {r["violation"] for r in scrub.postconditions(docs, pages_, fields, annotations, flat, []).collect()}


def test_signed_messages():
    tlv = lambda tag, *inside: bytes([tag, len(b"".join(inside))]) + b"".join(inside)
    assert cms.oid(bytes.fromhex("2A864886F70D010904")) == cms.MESSAGE_DIGEST and cms.oid(b"\x55\x04\x03") == "2.5.4.3" and cms.oid(b"") == ""
    assert list(cms.children(b"\x30\x80\x02\x01\x05\x00\x00\x04\x01a")) == [(0x30, b"\x02\x01\x05"), (4, b"a")]
    assert list(cms.children(b"\x04\x05ab")) == []
    name = tlv(0x30, tlv(0x31, tlv(0x30, b"\x06\x03\x55\x04\x03", tlv(0x1E, "Zoë".encode("utf-16-be")))))
    assert cms.common_name(name) == "Zoë" and cms.common_name(b"\x30\x80" * 200) is None
    rnd = random.Random(3)
    for _ in range(2000):  # whatever the bytes, nothing is raised
        assert cms.facts(bytes(rnd.choices([0x30, 0x80, 0xA0, 0x31, 0x06, 0x04, 0, 1, 2, 9, 0x2A, 0x86], k=rnd.randint(0, 40)))) is None


def test_bytes_for_disk(spark):
    row = lambda pending, protection, encrypted: spark.createDataFrame([(b"plain", pending, protection, encrypted)], "plain binary, pending boolean, protection string, encrypted binary")
    assert bytes(pages.bytes_for_disk(row(False, "plaintext", None)).first()["written"]) == b"plain"
    assert bytes(pages.bytes_for_disk(row(None, "protected", b"locked")).first()["written"]) == b"locked"
    for bad in (row(True, "plaintext", None), row(False, "protected", None), row(False, "other", None)):
        with pytest.raises(Exception, match="redaction|encrypted|protection"):
            pages.bytes_for_disk(bad).collect()


def test_paths_and_dates(spark):
    paths = {"/a/./b//c": "/a/b/c", "/../x/..": "/", "http://h/a/../b?q=/../c#d": "http://h/b", "a/b/../../../c": "/c"}
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    assert {r["p"]: r["c"] for r in df.select("p", pages.canonical_path(F.col("p")).alias("c")).collect()} == paths
    dates = {"D:20240229123045+05'30'": " at 12:30:45 UTC+05:30", "D:20240229123045Z": " at 12:30:45 UTC", "2024022912-08": " at 12:00:00 UTC-08:00", "D:20240229": "", "D:20240229123045+0530": " at 12:30:45 UTC+05:30"}
    df = spark.createDataFrame([(k,) for k in [*dates, "D:2024", "D:20241", "D:202", "D:20241399", "x"]], "d string")
    got = {r["d"]: r["t"] for r in df.select("d", labels.pdf_date(F.col("d")).alias("t")).collect()}
    assert all(got[k].endswith("29, 2024" + clock) for k, clock in dates.items())
    assert got["D:2024"].endswith("1, 2024") and got["D:20241"] == got["D:2024"] and all(got[k] == k for k in ("D:202", "D:20241399", "x"))


def test_gate(spark):
    df = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (3, None, "c")], "id int, ok boolean, body string")
    rows = pages.gated(df, F.col("ok"), "body")
    assert {(r["id"], r["verified"], r["body"]) for r in rows.collect()} == {(1, True, "a"), (2, False, None), (3, False, None)}
    with pytest.raises(Exception, match="not verified"):
        pages.assert_gated(rows, "not verified").collect()


def test_trees_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    assert {r["node"] for r in trees.reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()} == {1, 2, 3}


def test_parsers():
    assert B.inflate(zlib.compress(b"x" * 99)) == b"x" * 99 and B.inflate(zlib.compress(b"y")[2:-4]) == b"y" and B.inflate(b"\xff\xff") is None
    assert B.ber_end(b"\x30\x80\x04\x01a\x00\x00rest") == 7 and B.ber_end(b"\x04\x05ab") is None and B.ber_end(b"\x30\x80" * 200) is None
    assert B.octets(b"\x04\x02ab") == b"ab" and B.octets(b"\x05\x02ab") is None
    diagonals = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    assert list(B.ZIGZAG) == diagonals
    for quality, scale in ((50, 100), (75, 50), (25, 200)):
        table = [max(1, min(255, (s * scale + 50) // 100)) for s in B.STANDARD_LUMINANCE]
        stored = bytes(table[p] for p in B.ZIGZAG)
        jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xdb\x00\x43\x00" + stored + b"\xff\xda\x00\x02"
        assert abs(B.jpeg_quality(jpeg) - quality) < 1 and (quality != 50 or abs(B.jpeg_quality(jpeg) - 50.7485) < 1e-4)
        found = B.jpeg_quality(jpeg)
        assert B.jpeg_quality(jpeg.replace(b"\xff\xdb", b"\x00\xff\xff\xd0\xff\xdb")) == found  # padding, a marker alone
        assert B.jpeg_quality(jpeg[:-4] + b"\xff\xdb\x00\x43\x00" + b"\x63" * 64 + b"\xff\xda\x00\x02") == found  # the first table 0
        assert B.jpeg_quality(jpeg[:60]) is None and B.jpeg_quality(b"\xff\xd8\xff\xda" + jpeg[2:]) is None
    for clamped in (1, 255):
        assert B.jpeg_quality(b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([clamped]) * 64) is None
    assert B.jpeg_quality(b"GIF") is None
    white = bytearray(b"\xff" * 400)
    for row in (3, 4):
        for column in (2, 3, 5):
            white[(row * 10 + column) * 4] = 0
    assert B.ink_box(bytes(white), 10) == [2, 3, 4, 5]
    assert B.digest_spans(b"abcdef", [0, 2, 4, 2], "sha256") and B.digest_spans(b"abc", [0, 2, 2, 9], "sha256") is None


PDF = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 5 0 R] /Count 3 /MediaBox [0 0 200 300] >> endobj
3 0 obj << /Type /Page /Parent 2 0 R >> endobj
5 0 obj << /Type /Pages /Kids [4 0 R 6 0 R 5 0 R] /Rotate 90 >> endobj
4 0 obj << /Type /Page /CropBox [10 10 110 60] >> endobj
6 0 obj << /Type /Page /Rotate 0 >> endobj
trailer << /Root 1 0 R >>
%%EOF"""


def test_cms_never_raises():
    """An attribute without contents, and whole messages that are cut, flipped or shuffled."""
    der = lambda tag, *parts: bytes([tag]) + (lambda b: (bytes([len(b)]) if len(b) < 128 else b"\x81" + bytes([len(b)])) + b)(b"".join(parts))
    digest = der(0x06, bytes.fromhex("2A864886F70D010904"))
    algorithm = der(0x30, der(0x06, bytes.fromhex("608648016503040201")))

    def message(*attributes: bytes) -> bytes:
        signer = der(0x30, der(2, b"\1"), der(0x30, der(2, b"\7")), algorithm, der(0xA0, *attributes))
        return der(0x30, der(0x06, bytes.fromhex("2A864886F70D010702")), der(0xA0, der(0x30, der(2, b"\1"), der(0x31, algorithm), der(0x30, der(0x06, b"\x2a")), der(0x31, signer))))

    sealed = der(0x30, digest, der(0x31, der(4, b"seal")))
    assert cms.facts(message(sealed))["sealed"] == b"seal"
    assert cms.facts(message(der(0x30), sealed))["sealed"] == b"seal"
    assert cms.facts(message(der(0x30), der(0x30, digest)))["sealed"] is None
    assert list(cms.children(b"\x9f\x81\x01\x02ab\x04\x01c")) == [(0x9F, b"ab"), (4, b"c")]
    rnd, whole = random.Random(4), message(der(0x30), sealed)
    for _ in range(3000):
        data = bytearray(whole[: rnd.randrange(len(whole) + 1)])
        for _ in range(rnd.randrange(4)):
            if data:
                data[rnd.randrange(len(data))] = rnd.randrange(256)
        found = cms.facts(bytes(data))
        assert found is None or set(found) == {"digest_oid", "sealed", "signer"}


def test_two_copies_of_a_form(spark):
    """What is named, reset or set in one document leaves its copy alone; a name of the other document is none."""
    rows = [(d, n, "Tx", "old", n + "0") for d in (1, 2) for n in ("a", "b")]
    form = spark.createDataFrame(rows, "doc_id long, name string, ft string, value string, default string")
    names = spark.createDataFrame([(1, "a")], "doc_id long, name string")
    of = lambda df: {(r["doc_id"], r["name"]): r["value"] for r in df.collect()}
    same = {(r[0], r[1]): "old" for r in rows}
    assert of(fields.reset(form, fields.ONLY, names)) == same | {(1, "a"): "a0"}
    assert of(fields.reset(form, fields.EXCEPT, names)) == {(1, "a"): "old", (1, "b"): "b0", (2, "a"): "a0", (2, "b"): "b0"}
    assert set(of(fields.in_scope(form, fields.ONLY, names))) == {(1, "a")}
    new = spark.createDataFrame([(2, "b", "new")], "doc_id long, name string, value string")
    assert of(fields.set_values(form, new)) == same | {(2, "b"): "new"}
    with pytest.raises(Exception, match="no field of that name"):
        fields.set_values(form, spark.createDataFrame([(3, "b", "new")], new.schema)).collect()
    kids = spark.createDataFrame([(d, "a", k, ["Off", k]) for d in (1, 2) for k in ("x", "y")], "doc_id long, name string, kid string, states array<string>")
    states = fields.button_states(kids, spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "doc_id long, name string, value string"))
    assert {(r["doc_id"], r["kid"]): r["state"] for r in states.collect()} == {(1, "x"): "x", (1, "y"): "Off", (2, "x"): "Off", (2, "y"): "y"}



def test_pdf_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(PDF)
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.pdf").write_bytes(PDF.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"))
    got = {(r["path"][-5:], r["page"]): r for r in pdf.read_pages(spark, str(tmp_path)).collect()}
    sizes = {k[1]: (r["width"], r["height"], r["rotation"]) for k, r in got.items() if k[0] == "a.pdf" and k[1]}
    assert sizes == {1: (200.0, 300.0, 0), 2: (50.0, 100.0, 90), 3: (200.0, 300.0, 0)}
    assert got["a.pdf", None]["error"] == "object 5 is listed in several places"
    assert got["b.pdf", None]["error"] == "not a PDF file" and got["c.pdf", None]["error"] == "PASSWORD_REQUIRED"


def test_streaming_search(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, "than " * i) for i in range(6)], "doc_id int, page int, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    hits = stream.search_arrivals(spark, f"{tmp_path}/in", rows.schema, "than", files_per_batch=1)
    query = hits.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert {(r["doc_id"], r["n_matches"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(i, i) for i in range(1, 6)}


def test_wrapped_lines_of_whole_turns(spark, tmp_path):
    """Turns longer than 300 characters are wrapped to their end."""
    width = dict(enumerate(T.ASCII_WIDTHS, 32))
    measure = lambda s: 12.0 * sum(width[ord(c)] for c in s) / 1000.0
    rnd = random.Random(2)
    rows = [(1, i, " ".join("abcdefghij"[: rnd.randint(1, 10)] for _ in range(n)) + "\n\nlast one") for i, n in enumerate((3, 90, 700))]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = set()
    for conv, turn, text in rows:
        lines: list[str] = []
        for paragraph in text.split("\n"):
            line = ""
            for word in paragraph.split(" "):
                longer = f"{line} {word}" if line else word
                if not line or measure(longer) <= 196.0:
                    line = longer
                else:
                    lines.append(line)
                    line = word
            lines.append(line)
        want |= {(conv, turn, at, line) for at, line in enumerate(lines)}
    got = [tuple(r) for r in catalogue.queries()["e17_wrapped_lines"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """A folder of documents of any length and characters."""
    at = tmp_path_factory.mktemp("texts")
    rows = [(1, "été 🙂 the e\n" * 40), (2, "é" * 1023 + "a" + "the"), (3, "é" * 1022 + "a" + "the"), (4, "x" * 119), (5, "é" * 60), (6, "é" * 59 + "z"), (7, ""), (8, None), (9, "😀eé" * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at), rows


def test_char_offsets_of_whole_texts(spark, texts):
    want = [(k, i, len(t[:i].encode())) for k, t in texts[1] for i, c in enumerate(t or "") if c != "e"]
    got = [tuple(r) for r in catalogue.queries()["e09_char_offsets"](spark, texts[0]).collect()]
    assert sorted(got) == want


def test_marker_in_every_head(spark, texts):
    got = {r["doc_id"]: r["marked"] for r in catalogue.queries()["a13_marker_in_head"](spark, texts[0]).collect()}
    content = lambda k, t: t + "/Linearized" if k % 3 == 0 else t[:1000] + "/Linearized 1" + t
    assert got == {k: None if t is None else b"/Linearized" in content(k, t).encode()[:2048] for k, t in texts[1]}
    assert not got[3] and got[1]


def test_digest_of_every_document(spark, texts):
    got = {r["doc_id"]: r["digest"] for r in catalogue.queries()["d23_digest_byte_range"](spark, texts[0]).collect()}
    digest = lambda raw: hashlib.sha256(raw[:50] + raw[80:120]).hexdigest() if len(raw) >= 120 else None
    assert got == {k: digest((t or "").encode()) for k, t in texts[1]}
    assert got[4] is None and got[5] and got[6] is None


def test_every_page_is_recognised(spark, tmp_path):
    rows = [(c, turn, f"w{turn} of\n{c} " * (turn + 1)) for c in range(3) for turn in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = [(c, turn + 1, i + 1, w, 10.0 * i) for c, turn, text in rows for i, w in enumerate(text.split())]
    assert sorted(tuple(r) for r in catalogue.queries()["j01_recognised_words"](spark, str(tmp_path)).collect()) == want


def test_strokes_are_set_replaced_and_cleared_by_document(spark):
    box = [10.0, 0.0, 110.0, 40.0]
    form = spark.createDataFrame([(1, "a", box, None, 7), (1, "b", box, "old", 7), (2, "a", box, "old", 7), (2, "n", None, "kept", 7)], "doc_id long, name string, rect array<double>, appearance string, more int")
    shape = "doc_id long, name string, strokes array<array<array<double>>>"
    new = spark.createDataFrame([(1, "a", [[[0.0, 0.0], [1.0, 1.0]], []]), (1, "b", []), (2, "a", None)], shape)
    rows = fields.set_strokes(form, new)
    found = {(r["doc_id"], r["name"]): r["appearance"] for r in rows.collect()}
    assert rows.columns == form.columns
    assert found == {(1, "a"): "0.5 w 0 G\n0.50 0.50 99.00 39.00 re S\n1.5 w 1 J 1 j\n0.00 40.00 m\n100.00 0.00 l\nS\n", (1, "b"): None, (2, "a"): None, (2, "n"): "kept"}
    assert sorted(tuple(r) for r in fields.orphaned(form, rows).collect()) == [(1, "b", "old"), (2, "a", "old")]
    for bad, why in ((3, "a"), "no signature field"), ((2, "n"), "without a rectangle"):
        with pytest.raises(Exception, match=why):
            fields.set_strokes(form, spark.createDataFrame([(*bad, [])], shape)).collect()
