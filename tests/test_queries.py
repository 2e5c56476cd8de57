"""Every query with SQL gives what DuckDB gives, at the smallest size."""

import duckdb
import pytest

from sievework.plans.oracle import ORACLE_SQL
from sievework.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAME = sorted(set(QUERIES) & set(ORACLE_SQL))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).map(lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)).values.tolist()), key=str)


@pytest.mark.parametrize("name", SAME)
def test_query_equals_sql(spark, duck, name):
    want, got = duck.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
