"""Every query that has SQL gives the same rows as DuckDB."""

import datetime

import duckdb
import pytest

from quire import detail_queries, format_queries, object_queries, page_queries, queries, value_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else round(v, 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, duck, sf_small, name):
    df = queries.QUERIES[name](spark, sf_small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    result = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == expected
