"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from catalog import registry  # noqa: E402
from check_queries import TABLES, compare  # noqa: E402

@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    df = queries()[name](spark, str(DATA))
    got = df.collect()
    assert got
    plan = df._jdf.queryExecution().executedPlan().toString()
    if not name.startswith(("m4", "m6", "m8")):  # fits and predictions in numpy or Spark ML
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas", plan)
    assert compare(name, got, df.columns, oracle_sql()[name], con) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
