"""GeoJSON documents, a ledger that survives retries, layer checks without a job."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from nichelab.operators import grid, raster
from nichelab.plans import environment
from nichelab.operators import tiles
from nichelab.sources import sinks, tables
from nichelab.sources.tables import FIXTURE_RASTER as META


def _cells(spark, n=40):
    ring = F.array(*[F.array(F.col("lon") + a, F.col("lat") + b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0))])
    df = spark.range(n).select("id", (F.col("id") * 1.0).alias("lat"), (F.col("id") * 2.0).alias("lon"), (F.col("id") / n).alias("risk"))
    text = {c: F.lit('a "quoted", text') for c in ("risk_percent", "risk_category", "risk_description", "navigation_url")}
    return df.withColumns(text).withColumn("ring", ring)


def test_every_part_is_a_feature_collection(spark, tmp_dir):
    path = f"{tmp_dir}/docs"
    sinks.write_feature_collections(_cells(spark).repartition(4), path)
    parts = sorted(glob.glob(f"{path}/part-*"))
    docs = [json.load(open(p)) for p in parts if os.path.getsize(p)]
    assert len(docs) == 4 and all(d["type"] == "FeatureCollection" for d in docs)
    features = [f for d in docs for f in d["features"]]
    assert sorted(f["properties"]["lat"] for f in features) == [float(k) for k in range(40)]
    assert all(f["type"] == "Feature" and f["properties"]["risk_category"] == 'a "quoted", text' for f in features)
    # many batches in one part, one feature, none
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for n in (0, 1, 3, 10):
            sinks.write_feature_collections(_cells(spark, n).coalesce(1), path)
            found = [json.load(open(p)) for p in glob.glob(f"{path}/part-*") if os.path.getsize(p)]
            assert sum(len(d["features"]) for d in found) == n
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_failed_task_leaves_no_document(spark, tmp_dir):
    path = f"{tmp_dir}/failed"
    bad = _cells(spark).repartition(4, "id").withColumn("risk", F.when(F.col("id") == 39, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("risk")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_feature_collections(bad, path)
    assert not glob.glob(f"{path}/part-*")


def test_a_retried_run_is_in_the_ledger_once(spark, tmp_dir):
    path = f"{tmp_dir}/ledger"
    m = spark.createDataFrame([(0.9, 1, 2, 3, 4)], "accuracy double, tn long, fp long, fn long, tp long")
    first = sinks.append_model_run(m, path, "boosted", 0.6, "bio1", "depth 3")
    assert sinks.append_model_run(m, path, "boosted", 0.6, "bio1", "depth 3") == first
    assert spark.read.parquet(path).count() == 1
    other = {sinks.append_model_run(m, path, "boosted", 0.6, "bio1", "depth 6"), sinks.append_model_run(m.withColumn("tp", F.lit(5).cast("long")), path, "boosted", 0.6, "bio1", "depth 3")}
    assert first not in other and spark.read.parquet(path).count() == 3
    for _ in range(2):  # a name of its own: what it says may differ, as with another time or machine
        assert sinks.append_model_run(m.withColumn("accuracy", F.rand()), path, "boosted", run_id="job-7") == "job-7"
    rows = spark.read.parquet(path)
    assert rows.count() == 4 and rows.select("run_id").distinct().count() == 4
    old = f"{tmp_dir}/old"
    m.select(F.current_timestamp().alias("run_ts"), F.lit("m").alias("model"), "*").write.parquet(old)
    sinks.append_model_run(m, old, "boosted")
    assert spark.read.option("mergeSchema", True).parquet(old).count() == 2


def test_layer_checks_without_a_job(spark, tmp_dir, monkeypatch):
    def no_job(*_):
        raise AssertionError("a scan while the plan is built")

    cells = tables.raster_cells(spark)
    sinks.write_raster_cells(cells, f"{tmp_dir}/cells")
    stored = spark.read.parquet(f"{tmp_dir}/cells")
    monkeypatch.setattr(raster, "missing_layers", no_job)
    for df in (cells, stored):
        assert raster.known_layers(df) == set(tables.CLIMATE_NUMBERS)
        raster.require_layers(df, ["bio1", "bio12"])
        with pytest.raises(FileNotFoundError, match="bio2, bio3"):
            raster.require_layers(df, ["bio1", "bio2", "bio3"])
    assert raster.known_layers(cells.filter("var = 1")) is None
    grid.enrich_grid(spark.range(3).select(F.col("id").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(1).alias("month")), cells, tables.elevation_cells(spark), META)


def test_environment_from_tiles(spark):
    req = spark.createDataFrame([(k, k * 0.9 - 90, k * 1.7 - 170) for k in range(210)], "pos long, latitude double, longitude double")
    cells, elev = tables.raster_cells(spark), tables.elevation_cells(spark)
    want = environment.extract_environment(req, cells, elev, META)
    got = environment.extract_environment(req, cells, elev, META, packed=tiles.pack_layers(cells, tile=9), tile=9)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
