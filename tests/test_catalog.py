"""Every registered query with an SQL twin against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidecast import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    found = db.execute(catalog.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() == 35


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.SQL) <= set(e.oracle_sql())
