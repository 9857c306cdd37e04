"""Every query that has a SQL twin, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from pagewright.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr(plain([r[c] for c in columns])) for r in df.collect())
    found = duck.execute(catalogue.oracles()[name])
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    assert [found.description[i][0] for i in order] == columns
    assert ours == sorted(repr(plain([r[i] for i in order])) for r in found.fetchall())


def test_queries_without_sql_run(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracles()):
        assert catalogue.queries()[name](spark, DATA).count() > 0, name
