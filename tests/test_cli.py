"""The command line runs the three jobs end to end on the smallest tables."""

import os

from conftest import SF001


def test_cli_jobs(spark, tmp_dir):
    from nichelab.__main__ import main

    main(["ml-ready", "--input", SF001, "--out", tmp_dir, "--max-global", "60", "--max-local", "30"])
    g = spark.read.option("header", True).csv(os.path.join(tmp_dir, "global_training_ml_ready"))
    assert 0 < g.count() <= 60 and g.columns[0] == "latitude" and len(g.columns) == 15
    main(["train", "--input", SF001, "--out", tmp_dir, "--max-iter", "3"])
    assert spark.read.parquet(os.path.join(tmp_dir, "model_runs")).count() == 1
    main(["risk-map", "--model", os.path.join(tmp_dir, "model"), "--out", tmp_dir, "--grid-size", "8", "--month", "6"])
    assert spark.read.text(os.path.join(tmp_dir, "cells_geojson")).count() == 49
