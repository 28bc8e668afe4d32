"""Sinks: model-ready CSV, GeoJSON feature lines, the model-run ledger, models."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nichelab.functions.numeric import bround6, half_even
from nichelab.schemas import ML_READY_COLUMNS, ML_READY_INT_COLUMNS


def ml_ready_text(df: DataFrame, columns: list[str] = ML_READY_COLUMNS) -> DataFrame:
    """CSV text form: floats rounded half-even to 6 decimals and printed ``%.6f``,
    integer columns as integers (even with nulls), nulls as empty fields."""
    out = []
    for c in columns:
        dtype = df.schema[c].dataType
        if c in ML_READY_INT_COLUMNS or isinstance(dtype, (T.IntegerType, T.LongType)):
            out.append(F.col(c).cast("string").alias(c))
        else:
            value = F.col(c).cast("double")
            out.append(F.when(value.isNotNull(), F.format_string("%.6f", bround6(value))).alias(c))
    return df.select(*out)


def write_ml_ready_csv(df: DataFrame, path: str, columns: list[str] = ML_READY_COLUMNS) -> None:
    """Overwrite a folder of CSV part files with header (one file per task, no driver merge)."""
    ml_ready_text(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def geojson_feature_lines(cells: DataFrame) -> DataFrame:
    """One GeoJSON Feature per row as JSON text (``value``), from the grid-cell frame."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.col("ring")).alias("coordinates")).alias("geometry"),
        F.struct(
            F.col("risk"),
            F.col("risk_percent"),
            F.col("risk_category"),
            F.col("risk_description"),
            F.col("lat"),
            F.col("lon"),
            F.col("navigation_url"),
        ).alias("properties"),
    )
    return cells.select(F.to_json(feature).alias("value"))


def write_geojson_lines(cells: DataFrame, path: str) -> None:
    """Feature-per-line GeoJSON; ``write_feature_collections`` writes documents that other tools open."""
    geojson_feature_lines(cells).write.mode("overwrite").text(path)


def _document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one FeatureCollection from a task's features; no features, no document."""
    held = None

    def line(values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    for batch in batches:
        values = batch.column(0).to_pylist()
        if not values:
            continue
        out = ['{"type": "FeatureCollection", "features": ['] if held is None else [held + ","]
        out += [v + "," for v in values[:-1]]
        held = values[-1]
        yield line(out)
    if held is not None:
        yield line([held, "]}"])


def write_feature_collections(cells: DataFrame, path: str) -> None:
    """A folder of GeoJSON documents: every part is one valid FeatureCollection.

    A task writes its header, its features and its footer as lines of text, through the
    text writer's commit: parts of failed or repeated tasks never show, and nothing does
    before the job is done.  No task sees another's features, so any number of cells can
    be written; for a single document coalesce the cells first.
    """
    lines = geojson_feature_lines(cells).mapInArrow(_document, "value string")
    lines.write.mode("overwrite").text(path)


def run_identity(model_name: str, row: dict, threshold: float | None, top_features: str | None, details: str | None) -> str:
    """The id of a model run: a hash of everything its ledger row says but the time."""
    said = [model_name, threshold, top_features, details, sorted((k, repr(v)) for k, v in row.items())]
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()[:32]


def append_model_run(
    metrics: DataFrame,
    path: str,
    model_name: str,
    threshold: float | None = None,
    top_features: str | None = None,
    details: str | None = None,
    run_id: str | None = None,
) -> str:
    """Append a dated metrics row to the model-run ledger (parquet), with the strongest features and the model's
    settings as text, unless the ledger has the run already; returns the run's id.

    ``run_id`` names the run (a retried job passes the same one); without it the run is known by what its row says.  The
    row is one file, which the writer's commit makes visible whole or not at all.  ``metrics`` is one row.
    """
    spark = metrics.sparkSession
    values = metrics.first().asDict()
    run_id = run_id or run_identity(model_name, values, threshold, top_features, details)
    if read_ledger(spark, path, F.col("run_id") == run_id):
        return run_id
    metrics = spark.createDataFrame([tuple(values[c] for c in metrics.columns)], metrics.schema)
    row = metrics.coalesce(1).select(
        F.lit(run_id).alias("run_id"),
        F.current_timestamp().alias("run_ts"),
        F.lit(model_name).alias("model"),
        F.lit(threshold).cast("double").alias("threshold"),
        F.lit(top_features).cast("string").alias("top_features"),
        F.lit(details).cast("string").alias("details"),
        *[F.col(c) for c in metrics.columns if c not in ("model", "threshold")],
    )
    row.write.mode("append").parquet(path)
    return run_id


def read_ledger(spark: SparkSession, path: str, where: Column) -> bool:
    """Whether a ledger has a row for which ``where`` holds; one that is not there, or from before runs had ids, has none."""
    try:
        ledger = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException:
        return False
    return "run_id" in ledger.columns and not ledger.filter(where).isEmpty()


def ledger_text(ledger: DataFrame) -> DataFrame:
    """Markdown-like report text per ledger row: 6 metrics at 4 decimals, threshold, confusion matrix."""
    # a metric that is not defined (one class only) prints as n/a
    fmt = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.4f", half_even(F.col(c), 4))), F.lit("n/a"))
    line = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- **{title}**: "), F.col(c), F.lit("\n"))).otherwise(F.lit(""))
    return ledger.select(
        F.concat(
            F.lit("## "), F.col("model"), F.lit(" Model Results\n\n"),
            F.lit("**Date**: "), F.date_format("run_ts", "yyyy-MM-dd HH:mm"), F.lit("\n\n"),
            F.lit("- **Accuracy**: "), fmt("accuracy"), F.lit("\n"),
            F.lit("- **ROC AUC**: "), fmt("auc"), F.lit("\n"),
            F.lit("- **F1 Score**: "), fmt("f1_score"), F.lit("\n"),
            F.lit("- **Sensitivity**: "), fmt("sensitivity"), F.lit("\n"),
            F.lit("- **Specificity**: "), fmt("specificity"), F.lit("\n"),
            F.lit("- **Average Precision**: "), fmt("average_precision"), F.lit("\n"),
            F.when(F.col("threshold").isNotNull(), F.concat(F.lit("- **Optimal Threshold**: "), fmt("threshold"), F.lit("\n"))).otherwise(F.lit("")),
            line("Model Details", "details"), line("Top Features", "top_features"),
            F.lit("\n[[ "), F.col("tn").cast("string"), F.lit(" "), F.col("fp").cast("string"), F.lit(" ]]\n"),
            F.lit("[ [ "), F.col("fn").cast("string"), F.lit(" "), F.col("tp").cast("string"), F.lit(" ]]\n"),
        ).alias("report")
    )


def save_threshold(spark: SparkSession, threshold: float, path: str) -> None:
    spark.createDataFrame([(float(threshold),)], "threshold double").write.mode("overwrite").parquet(path)


def load_threshold(spark: SparkSession, path: str) -> float:
    return float(spark.read.parquet(path).first()["threshold"])


def write_raster_cells(cells: DataFrame, path: str) -> None:
    """Store a long cell table partitioned by layer, each layer's cells sorted by (row, col),
    so that reading a few layers lists only their folders."""
    (
        cells.repartition("var")
        .sortWithinPartitions("row_id", "col_id")
        .write.mode("overwrite")
        .partitionBy("var")
        .parquet(path)
    )


def write_wide_cells(wide: DataFrame, path: str) -> None:
    """Store the one-row-per-cell layer table once per raster, clustered by
    (row, col) so joins read it sequentially; jobs then skip the pivot."""
    wide.repartitionByRange("row_id", "col_id").sortWithinPartitions("row_id", "col_id").write.mode("overwrite").parquet(path)
