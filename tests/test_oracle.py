"""Every registered query against its DuckDB oracle at sf0.001 (queries with
no SQL oracle must at least run and keep a stable schema); plus the driver's
smoke entry."""

import pytest

import __spark_entry__ as se
from oracle_harness import compare, duck

SMOKE = "/root/testdata/sf0.001"
QUERIES = se.queries()
ORACLE = se.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() >= 1 and df.columns == ["ticker", "net_margin", "net_margin_pct"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SMOKE), ORACLE[name], con)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SMOKE)
    schema = df.schema
    assert df.count() >= 0 and QUERIES[name](spark, SMOKE).schema == schema
