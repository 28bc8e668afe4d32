"""Every registered query against its DuckDB oracle (sf0.001) and plan checks."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from nichelab import oracles
from nichelab import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ML = {"gbt_train_score", "cv_grid", "feature_importance", "rf_baseline", "training_summary", "model_risk_summary", "second_order_train_score"}
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(None if (isinstance(r[i], float) and r[i] != r[i]) else r[i] for i in order) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    df = Q.REGISTRY[name](spark, SF001)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    assert _canon(srows, scols) == _canon(res.fetchall(), dcols)


def test_every_query_has_oracle_or_is_model():
    assert set(Q.REGISTRY) - set(SQL) <= ML | {"grid_cells_geojson_text"}


@pytest.mark.parametrize("name", sorted(set(Q.REGISTRY) - ML))
def test_plan_has_no_cartesian_or_python(spark, name):
    df = Q.REGISTRY[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert bad not in plan, f"{name}: {bad}"


def test_pushdown_and_pruning(spark):
    plan = Q.occ_quality_filter(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    ev = Q.standard_metrics(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in ev


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "key"
