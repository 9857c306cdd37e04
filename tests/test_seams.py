"""The sink of files and the table function of recognition."""

from __future__ import annotations

import os

import pytest

from pagewright.sources import recognise, text_files


def found(folder) -> dict[str, bytes]:
    return {name: open(os.path.join(top, name), "rb").read() for top, _, names in os.walk(folder) for name in names}


def test_files_are_there_as_a_whole_or_not_at_all(spark, tmp_path):
    text_files.register(spark)
    save = lambda rows, to: spark.createDataFrame(rows, "doc_id string, content string, verified boolean, extra int").repartition(3).write.format("document_files").mode("append").option("path", str(to)).save()
    save([("a/b", "é\n", True, 1), ("..", "", True, 2), ("c", None, True, None)], tmp_path / "one")
    assert found(tmp_path / "one") == {"a%2Fb.txt": "é\n".encode(), "...txt": b"", "c.txt": b""}
    for rows in ([("a", "x", True, 1), ("b", "x", False, 1)], [("a", "x", None, 1)], [(None, "x", True, 1)]):
        with pytest.raises(Exception, match="isn't verified"):
            save(rows, tmp_path / "two")
    with pytest.raises(Exception, match="there already"):
        save([("a", "x", True, 1)], tmp_path / "one")
    save([], tmp_path / "none")
    assert sorted(os.listdir(tmp_path)) == ["none", "one"] and found(tmp_path / "none") == {}


def test_recognition_in_sql(spark):
    recognise.register(spark, recognise.WordsInBytes())
    spark.createDataFrame([(1, 1, b"two words", 0), (1, 2, b"\xff\xfe", 0), (2, 1, b"", 0), (2, 2, None, 0)], "doc_id long, page long, image binary, ord int").createOrReplaceTempView("seam_images")
    rows = spark.sql("SELECT doc_id, page, ord, text, x, error FROM recognise(TABLE(seam_images) PARTITION BY (doc_id, page)) ORDER BY doc_id, page, ord").collect()
    assert [tuple(r)[:5] for r in rows] == [(1, 1, 1, "two", 0.0), (1, 1, 2, "words", 10.0), (1, 2, None, None, None), (2, 2, None, None, None)]
    assert rows[2]["error"].startswith("UnicodeDecodeError") and rows[3]["error"].startswith("TypeError") and rows[0]["error"] is None
    with pytest.raises(Exception, match="are missing"):
        spark.sql("SELECT * FROM recognise(TABLE(SELECT 1 AS page))").collect()
