"""Every registered query against its DuckDB twin on the smallest tables,
and the driver contract itself."""

import duckdb
import pytest

import __spark_entry__ as E
from pressroom.plans.registry import QUERIES as LIBRARY
from pressroom.sources.tables import TABLES
from tools.oracle_check import canon

# the library's own queries; those of the training-data subpackage have their own tests
QUERIES = {k: f for k, f in E.queries().items() if k in LIBRARY}
ORACLE = {k: q for k, q in E.oracle_sql().items() if k in LIBRARY}


@pytest.fixture(scope="module")
def con(smoke_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smoke_dir}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["domain", "count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def test_every_query_has_an_oracle():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, smoke_dir, name):
    df = QUERIES[name](spark, smoke_dir)
    srows = df.collect()
    r = con.sql(ORACLE[name])
    dcols, drows = r.columns, r.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert canon(df.columns, srows) == canon(dcols, drows)
