"""Every registered query of the monitor against its SQL in DuckDB, on the smallest tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from rhoscope.queries import ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, numbers.Number) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in ("events", "orders", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_flagship(spark):
    assert flagship(spark, SF).count() == 1000


def test_entry_module_lists_queries_with_sql(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
