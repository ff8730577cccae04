import duckdb
import pytest
from pyspark.sql import types as T

import xylem.coverage  # noqa: F401
from xylem.queries import QUERIES, SQL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = got.collect()
    assert not any(isinstance(f.dataType, T.NullType) for f in got.schema)
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(got.columns) == sorted(names)
        cols = sorted(names)
        want = sorted(tuple(str(dict(zip(names, r))[c]) for c in cols) for r in found.fetchall())
        assert sorted(tuple(str(r[c]) for c in cols) for r in rows) == want


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
