"""Each query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from lacuna.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    a, b = normal(QUERIES[name](spark, SF).toPandas()), normal(db.sql(ORACLES[name]).df())
    assert list(a.columns) == list(b.columns)
    pd.testing.assert_frame_equal(a, b)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 25 and df.columns == ["zone", "tests", "covered", "covered_pct"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
