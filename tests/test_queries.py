"""Every query with SQL gives what DuckDB gives; every other one runs."""

import os

import duckdb
import pytest

from spanloom.plans import catalogue
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return con


def canonical(df, columns):
    """Rows as texts; floats must be the same to their last digit, since both sides round them."""

    def text(v):
        return "null" if v is None or (isinstance(v, float) and v != v) else repr(v) if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    spark.catalog.clearCache()
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got, sorted(got.columns)) == canonical(want, sorted(got.columns))
    else:
        assert len(got.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
