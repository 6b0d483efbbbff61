"""Every query with SQL gives the rows of its SQL; test_whole_tables has the others."""

import duckdb
import pandas as pd
import pytest

from tempograph import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return f"{round(float(v), 6):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" and v.ndim == 0 else str(list(v) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_no_shuffle_where_rows_are_independent(spark, sf):
    plan = registry.QUERIES["redact_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
