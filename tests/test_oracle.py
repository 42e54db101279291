"""Every query against DuckDB.  ``ORACLE_SF`` picks the scale (default sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from prodlake.harness.oracles import ORACLES
from prodlake.harness.queries import QUERIES

SF_DIR = f"/root/testdata/sf{os.environ.get('ORACLE_SF', '0.001')}"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def ordered(rows):
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return sorted(clean, key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython") if n in plan]
    columns = sorted(frame.columns)
    got = ordered([tuple(r[c] for c in columns) for r in frame.collect()])
    duck.execute(f"CREATE OR REPLACE VIEW wanted AS {ORACLES[name]}")  # the SQL has to do as a view
    result = duck.execute("SELECT * FROM wanted")
    kinds = {d[0]: str(d[1]) for d in result.description}
    names = list(kinds)
    want = ordered([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])
    assert {c: KINDS[k] for c, k in frame.dtypes} == kinds
    assert len(got) > 0
    assert got == want


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
