"""Every registered raster and tile query against its DuckDB twin, on the small tables."""

from collections import Counter

import duckdb
import pytest

from tests.conftest import SF_ORACLE

from tilewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_ORACLE}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    got = QUERIES[name](spark, SF_ORACLE)
    columns = sorted(got.columns)
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want)
    assert want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF_ORACLE).count() > 0
