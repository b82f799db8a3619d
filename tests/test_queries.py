"""Every registered engine query against its SQL in DuckDB, over the smallest tables."""

import os

import pytest

from streamloom import queries

TABLES = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in ("events", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_sql(spark, oracle, name):
    made = queries.queries()[name](spark, TABLES)
    columns = sorted(made.columns)
    got = sorted(repr(tuple(r)) for r in made.select(*columns).collect())
    want = oracle.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, want))


def test_pushdown_and_single_scans(spark):
    def plan(name):
        return queries.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()

    assert "EqualTo(event_type,view)" in plan("tag_subset")
    assert "GreaterThanOrEqual(ts" in plan("replay_range") and "LessThan" in plan("replay_range")
    for name in ("alarm_and_or", "alarm_single", "match_alarm", "foo_map", "linearize"):
        assert plan(name).count("FileScan") == 1
