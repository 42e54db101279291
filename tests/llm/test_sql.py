"""The queries that SQL can express, against DuckDB; its SQL must do as a view."""

import duckdb
import pytest

from prodlake.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_chat", "op12_negatives"])
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    duck.execute(f"CREATE VIEW wanted AS {ORACLES[name]}")
    frame = QUERIES[name](spark, SF_DIR)
    got = sorted((tuple(r) for r in frame.collect()), key=repr)
    assert got == sorted(duck.execute(f"SELECT {', '.join(frame.columns)} FROM wanted").fetchall(), key=repr)
    assert got
