"""Queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from rhoscope.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df[order].itertuples(index=False))
    assert rows(ours) == rows(theirs)
    assert isinstance(ours, pd.DataFrame) and len(ours)
