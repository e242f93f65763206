"""Every catalogued query against DuckDB on the smallest tables."""

import duckdb
import pytest

from loomlog.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, duck):
    df, sql = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 and set(entry.oracle_sql()) <= set(entry.queries())
