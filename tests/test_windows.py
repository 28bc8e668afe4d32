"""Distributed running totals and exact medians against pandas / numpy."""

from pyspark.sql import functions as F
import numpy as np
import pandas as pd
import pytest

from nichelab.operators.windows import exact_median, running_totals


def _data(spark, hot=True):
    rng = np.random.default_rng(0)
    g = np.where(rng.random(3000) < (0.6 if hot else 0.3), "hot", rng.choice(["a", "b", "c"], 3000))
    v = rng.integers(0, 500, 3000).astype(float) / 7.0
    pdf = pd.DataFrame({"g": g, "v": v, "w": rng.integers(1, 5, 3000)})
    agg = pdf.groupby(["g", "v"], as_index=False)["w"].sum()
    return agg, spark.createDataFrame(agg)


@pytest.mark.parametrize("ascending,inclusive", [(True, True), (True, False), (False, True), (False, False)])
def test_running_totals_grouped(spark, ascending, inclusive):
    agg, df = _data(spark)
    got = running_totals(df, "v", ["w"], by=["g"], ascending=ascending, inclusive=inclusive, buckets=6).toPandas()
    exp = agg.sort_values(["g", "v"], ascending=[True, ascending]).copy()
    exp["cum_w"] = exp.groupby("g")["w"].cumsum() - (0 if inclusive else exp["w"])
    m = got.merge(exp, on=["g", "v"], suffixes=("", "_exp"))
    assert len(m) == len(agg)
    assert (m["cum_w"] == m["cum_w_exp"]).all()


def test_running_totals_global(spark):
    agg, df = _data(spark)
    one = agg.groupby("v", as_index=False)["w"].sum()
    got = running_totals(spark.createDataFrame(one), "v", ["w"], buckets=5).toPandas().sort_values("v")
    assert (got["cum_w"].to_numpy() == one.sort_values("v")["w"].cumsum().to_numpy()).all()


@pytest.mark.parametrize("n", [1, 2, 7, 10, 501])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    vals = rng.integers(0, 50, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    got = exact_median(df, "x").first()[0]
    assert got == float(np.median(vals))


def test_exact_median_by_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["p", "q", "r"], 999), "x": rng.normal(size=999)})
    got = {r["g"]: r["median_x"] for r in exact_median(spark.createDataFrame(pdf), "x", by=["g"]).collect()}
    for g, s in pdf.groupby("g")["x"]:
        assert got[g] == pytest.approx(float(np.median(s)), abs=1e-15)


def test_bucket_expression_is_a_count_of_bounds(spark):
    from nichelab.operators.windows import _bucket_expr

    bounds = [float(b) for b in range(0, 2000, 2)]
    values = [-1.0, 0.0, 0.5, 1.0, 2.0, 999.0, 1998.0, 5000.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", _bucket_expr(F.col("v"), bounds).alias("b")).collect()
    assert [r["b"] for r in got] == [sum(b <= v for b in bounds) for v in values]


def test_hash_sample_on_both_sides_of_the_limit(spark, monkeypatch):
    from nichelab.operators import sampling

    df = spark.createDataFrame([(k % 700, p, k) for k in range(1400) for p in (0, 1)], "key long, presence int, x long")
    for n in (1, 7, 699, 1500, 2799, 2800, 9000):
        want = sampling.hash_sample(df, n, tiebreak=["presence", "x"]).collect()
        monkeypatch.setattr(sampling, "TOP_N_ROWS", 0)
        got = sampling.hash_sample(df, n, tiebreak=["presence", "x"]).collect()
        monkeypatch.undo()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_hash_sample_of_many_rows_without_a_key(spark, monkeypatch):
    from nichelab.operators import sampling

    df = spark.createDataFrame([(None if k < 900 else k, 1, k) for k in range(1000)], "key long, presence int, x long")
    for n in (5, 899, 900, 901, 999, 1000, 2000):
        want = sampling.hash_sample(df, n, tiebreak=["presence", "x"]).collect()
        monkeypatch.setattr(sampling, "TOP_N_ROWS", 0)
        got = sampling.hash_sample(df, n, tiebreak=["presence", "x"]).collect()
        monkeypatch.undo()
        assert len(got) == min(n, 1000) and {r["x"] for r in got} == {r["x"] for r in want}
