"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lithospark import geometry_queries as queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df, columns):
    df = df[columns].copy()
    for c in columns:
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float) + 0.0
    return df.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).df()
    assert set(ours) == set(theirs)
    pd.testing.assert_frame_equal(plain(ours, sorted(ours)), plain(theirs, sorted(ours)), check_dtype=False)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
