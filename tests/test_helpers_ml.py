"""Formats, the model-run ledger, model persistence and a small end-to-end training run."""

import os

import pytest
from pyspark.sql import functions as F

from nichelab.functions import bins, formats
from nichelab.sources import sinks

from conftest import SF001


def test_normalize_variable():
    assert formats.normalize_variable("1") == "bio1"
    assert formats.normalize_variable("bio12") == "bio12"
    assert formats.normalize_variable("5,6") == "bio5"
    assert formats.normalize_variable("bio5,6") == "bio5"
    assert formats.normalize_variable("x") is None
    assert formats.normalize_variable("biox") is None


def test_split_and_first_present_and_keys(spark):
    df = spark.createDataFrame([(" 1, 4 ,bio5", 0.0, 20.0, -33.9254, 18.4241)], "s string, a double, b double, lat double, lon double")
    r = df.select(
        formats.split_variable_list("s").alias("items"),
        formats.first_present(F.col("a"), F.col("b")).alias("plain"),
        formats.first_present(F.col("a"), F.col("b"), zero_is_missing=True).alias("compat"),
        formats.coordinate_key("lat", "lon").alias("key"),
        formats.percent_text(F.lit(0.12345)).alias("pct"),
    ).first()
    assert r["items"] == ["1", "4", "bio5"]
    assert r["plain"] == 0.0 and r["compat"] == 20.0
    assert r["key"] == "-33.925,18.424" and r["pct"] == "12.35%"
    ties = df.select(formats.percent_text(F.lit(0.00125)).alias("a"), formats.percent_text(F.lit(None).cast("double")).alias("b")).first()
    assert ties["a"] == "0.12%" and ties["b"] is None


@pytest.mark.parametrize("risk,color", [(0.0, "#00E6FF"), (0.5, "#FFFF00"), (1.0, "#660000"), (0.95, "#B30000"), (-1.0, "#00E6FF"), (2.0, "#660000")])
def test_legend_color(spark, risk, color):
    got = spark.createDataFrame([(risk,)], "risk double").select(bins.legend_color("risk")).first()[0]
    assert got == color


def test_request_batches(spark):
    from nichelab.plans.environment import request_batches

    df = spark.createDataFrame([(i, i / 10.0, -i / 10.0) for i in range(120)], "pos long, latitude double, longitude double")
    got = {r["batch"]: r for r in request_batches(df, 50).collect()}
    assert [got[b]["n_points"] for b in (0, 1, 2)] == [50, 50, 20]
    assert got[2]["locations"].split("|")[0] == "10.0,-10.0"


def test_ledger_append_and_text(spark, tmp_dir):
    from nichelab.operators import metrics

    rows = [(k, 0.8 if k % 3 else 0.2, 1 if k % 2 else 0) for k in range(60)]
    m = metrics.standard_metrics(spark.createDataFrame(rows, "key long, risk double, label int"), 0.5)
    path = os.path.join(tmp_dir, "ledger")
    sinks.append_model_run(m, path, "boosted", 0.64)
    sinks.append_model_run(m, path, "forest", None)
    led = spark.read.parquet(path)
    assert led.count() == 2
    texts = [r["report"] for r in sinks.ledger_text(led).collect()]
    boosted = next(t for t in texts if "boosted" in t)
    assert "**Optimal Threshold**: 0.6400" in boosted and "**Accuracy**:" in boosted
    assert not any("Optimal Threshold" in t for t in texts if "forest" in t)


def test_threshold_round_trip(spark, tmp_dir):
    p = os.path.join(tmp_dir, "thr")
    sinks.save_threshold(spark, 0.6399999999999997, p)
    assert sinks.load_threshold(spark, p) == 0.6399999999999997


def test_train_evaluate_save_load_score(spark, tmp_dir):
    from nichelab import queries as Q
    from nichelab.plans import training

    train, val = Q._training_sets(spark, SF001)
    res = training.train_and_evaluate(train, val, max_iter=3)
    assert 0.1 <= res.threshold <= 0.9 or res.threshold == 0.5
    m = res.metrics.first()
    assert m["auc"] is not None and 0.0 <= m["auc"] <= 1.0
    assert [d for d, _ in res.cv] == [3, 6]
    path = os.path.join(tmp_dir, "model")
    training.save_model(res.model, path)
    loaded = training.load_model(path)
    a = sorted(r["risk"] for r in training.score(loaded, val).collect())
    b = sorted(r["risk"] for r in res.scored.collect())
    assert a == pytest.approx(b)
    top = training.top_importances(training.importances(res.model, spark), 10).collect()
    assert len(top) == 10 and top[0]["importance"] >= top[-1]["importance"]


def test_model_risk_map(spark):

    from nichelab.plans import risk_map, training
    from nichelab import queries as Q
    from nichelab.sources import tables
    from nichelab.sources.tables import FIXTURE_RASTER as META

    train, _ = Q._training_sets(spark, SF001)
    pipe, _ = training.gbt_pipeline(max_depth=3, max_iter=3)
    model = pipe.fit(training.features(train))
    rm = risk_map.model_risk_map(spark, model, tables.raster_cells(spark), tables.elevation_cells(spark), META, n=10, month=2)
    out = risk_map.outputs(rm)
    assert out["summary"].first()["month_name"] == "February"
    assert out["cells"].count() == 81 and out["hotspots"].count() == 5
    assert rm.scored.filter((F.col("risk") < 0) | (F.col("risk") > 1)).count() == 0


def test_wide_grid_size(spark):
    from nichelab.plans import training

    _, gbt = training.gbt_pipeline()
    assert len(training.wide_param_grid(gbt)) == 216
