"""Every registered query of the library against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from windloom.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NA:
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, con, name):
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_plans_have_no_python_and_no_pairwise_joins(spark, data):
    for name in ("tile_basic", "interval_overlap", "percentile_vs_ref", "roc_auc", "exact_membership"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan, name
