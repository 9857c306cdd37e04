"""The training-data queries that have a SQL twin, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from pagewright.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_and_columns(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    assert [found.description[i][0] for i in order] == columns
    assert sorted(repr(plain([r[c] for c in columns])) for r in df.collect()) == sorted(repr(plain([r[i] for i in order])) for r in found.fetchall())


def test_every_operator_has_a_query():
    assert [name.split("_")[0] for name in sorted(queries.QUERIES, key=lambda x: int(x[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
