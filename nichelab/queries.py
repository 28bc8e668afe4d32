"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator group.

Each reads the driver tables (through the views of ``sources.tables``) in
full; every floating output is rounded to 6 decimals and every column is
aliased, so results compare value-for-value with the SQL in ``oracles``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nichelab.functions import bins, formats
from nichelab.functions.numeric import round6
from nichelab.operators import features, filters, grid, metrics, raster, sampling, tiles
from nichelab.plans import boosting, environment, ml_ready, risk_map, training
from nichelab.schemas import (
    CLIMATE_VARIABLES,
    LOCAL_COUNTRY,
    ML_READY_COLUMNS,
    OCCURRENCE_PAGE,
    PIPELINE_UNCERTAINTY_MAX,
)
from nichelab.session import shared_folder
from nichelab.sources import rasterfile, readers, sinks, tables
from nichelab.sources.tables import FIXTURE_RASTER as META

TAXON_KEY = 100  # the species every pipeline query is about
QUALITY_DATE_FROM = "1996-01-01"
PAGE_OFFSET, PAGE_LIMIT = 300, 600
GRID_N, GRID_MONTH = 50, 1
SUBSAMPLE_ROWS = 1000
ML_MAX_ITER = 100


def finish(df: DataFrame) -> DataFrame:
    """Round every floating column to 6 decimals."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round6(F.col(f.name).cast("double")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- shared inputs


def _occ(spark: SparkSession, sf: str) -> DataFrame:
    return tables.occurrences(spark, sf)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """All records with coordinates (no filters): the raster/temporal inputs."""
    return filters.drop_missing_coordinates(filters.project_occurrences(_occ(spark, sf)))


def _species_points(spark: SparkSession, sf: str) -> DataFrame:
    return ml_ready.presence_points(_occ(spark, sf), tables.taxon_matches(spark), TAXON_KEY)


def _ml_ready(spark: SparkSession, sf: str, country: str | None) -> DataFrame:
    df = ml_ready.build_ml_ready(
        _occ(spark, sf),
        tables.taxon_matches(spark),
        tables.raster_cells(spark, sf),
        tables.elevation_cells(spark, sf),
        META,
        TAXON_KEY,
        country=country,
    )
    return ml_ready.rounded(df)


def _training_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return training.prepare_training(_ml_ready(spark, sf, None), _ml_ready(spark, sf, LOCAL_COUNTRY))


def _risk_map(spark: SparkSession, sf: str) -> risk_map.RiskMap:
    return risk_map.density_risk_map(
        spark,
        _species_points(spark, sf),
        tables.raster_cells(spark, sf),
        tables.elevation_cells(spark, sf),
        META,
        n=GRID_N,
        month=GRID_MONTH,
    )


# ---------------------------------------------------------------- occurrences


def occ_scan_project(spark, sf):
    return finish(_points(spark, sf))


def occ_pages_explode(spark, sf):
    occ = _occ(spark, sf)
    fields = [f.name for f in OCCURRENCE_PAGE["results"].dataType.elementType.fields]
    # one record per envelope: the records need not meet to be paged
    envelope = F.struct(F.lit(1).cast("long").alias("count"), F.array(F.struct(*fields)).alias("results"))
    texts = occ.select(F.to_json(envelope).alias("value"))
    recs = readers.parse_pages(texts)
    return finish(
        recs.select("key", "taxonKey", "decimalLatitude", "decimalLongitude", "eventDate", "year", "month", "day", "country")
    )


def taxon_resolve(spark, sf):
    resolved = filters.resolve_taxon(tables.taxon_matches(spark))
    out = filters.occurrences_of_taxa(_occ(spark, sf), resolved)
    return out.select("key", "taxonKey", "species_key", "match_type")


def occ_quality_filter(spark, sf):
    out = filters.occurrence_filters(
        _occ(spark, sf),
        quality=True,
        date_from=QUALITY_DATE_FROM,
        country=LOCAL_COUNTRY,
        uncertainty_max=PIPELINE_UNCERTAINTY_MAX,
    )
    return finish(
        out.select("key", "taxonKey", "decimalLatitude", "decimalLongitude", "eventDate", "country", "coordinateUncertaintyInMeters")
    )


def occ_count(spark, sf):
    recs = ml_ready.species_records(_occ(spark, sf), tables.taxon_matches(spark), TAXON_KEY)
    return recs.agg(
        F.count(F.lit(1)).alias("n_global"), F.count_if(F.col("country") == F.lit(LOCAL_COUNTRY)).alias("n_local")
    )


def occ_limit_offset(spark, sf):
    recs = ml_ready.species_records(_occ(spark, sf), tables.taxon_matches(spark), TAXON_KEY)
    out = sampling.page(recs, "key", PAGE_OFFSET, PAGE_LIMIT)
    return finish(out.select("key", "decimalLatitude", "decimalLongitude", "eventDate"))


def temporal_features(spark, sf):
    out = filters.add_temporal_features(_points(spark, sf))
    return finish(out.select("key", "month", "day_of_year", "sin_month", "cos_month"))


# ---------------------------------------------------------------- rasters and elevation


def raster_sample(spark, sf):
    out = raster.sample_long(_points(spark, sf).select("key", "latitude", "longitude"), tables.raster_cells(spark, sf), META)
    return finish(out.select("key", "var", "value"))


def raster_sample_wide(spark, sf):
    out = raster.sample_wide(_points(spark, sf).select("key", "latitude", "longitude"), tables.raster_cells(spark, sf), META)
    return finish(out.select("key", "latitude", "longitude", *CLIMATE_VARIABLES))


def raster_dedup_sample(spark, sf):
    out = raster.sample_wide_dedup(
        _points(spark, sf).select("key", "latitude", "longitude"), tables.raster_cells(spark, sf), META
    )
    return finish(out.select("key", "latitude", "longitude", *CLIMATE_VARIABLES))


def layer_check(spark, sf):
    pts = _points(spark, sf).select("latitude", "longitude")
    return raster.layer_coverage(pts, tables.raster_cells(spark, sf), META)


def elevation_lookup(spark, sf):
    pts = _points(spark, sf).select("key", "latitude", "longitude")
    out = raster.lookup_elevation(pts, tables.elevation_cells(spark, sf), META)
    return finish(out.select("key", "latitude", "longitude", "elevation", "status"))


def coord_validation(spark, sf):
    out = filters.validate_coordinates(tables.coordinate_requests(spark, sf))
    return finish(out.select("pos", "latitude", "longitude", "error", F.col("error").isNull().alias("valid")))


def env_extract_batch(spark, sf):
    out = environment.extract_environment(
        tables.coordinate_requests(spark, sf), tables.raster_cells(spark, sf), tables.elevation_cells(spark, sf), META
    )
    return finish(out)


def elevation_request_batches(spark, sf):
    return environment.request_batches(tables.coordinate_requests(spark, sf))


# ---------------------------------------------------------------- model-ready tables


def elevation_extract(spark, sf):
    """The elevation job on a raster of its own resolution."""
    meta = tables.FINE_ELEVATION
    out = environment.extract_elevation(tables.coordinate_requests(spark, sf), tables.elevation_cells(spark, sf, meta), meta)
    return finish(out.select("pos", "latitude", "longitude", "elevation", "dataset", "status"))


def request_formats(spark, sf):
    """Text forms of a request: cache key, first usable value, split variable list."""
    req = tables.coordinate_requests(spark, sf)
    pos = F.col("pos")
    maybe = F.when(pos % 3 == 0, F.lit(0.0)).when(pos % 5 == 0, F.lit(None)).otherwise(F.col("latitude"))
    asked = F.concat(F.lit(" bio1, 4 ,"), (pos % 19 + 1).cast("string"))
    return finish(
        req.select(
            "pos",
            formats.coordinate_key("latitude", "longitude").alias("coordinate_key"),
            formats.first_present(maybe, F.col("longitude")).alias("first_value"),
            formats.first_present(maybe, F.col("longitude"), zero_is_missing=True).alias("first_nonzero"),
            F.array_join(formats.split_variable_list(asked), "|").alias("variables"),
        )
    )


def elevation_replies(spark, sf):
    requests, replies = tables.elevation_replies(spark, sf)
    return finish(readers.elevation_results(replies, requests))


def raster_sample_shuffle(spark, sf):
    """Point sampling on the shuffle path: cells that grow with the data, never broadcast by hint."""
    meta = tables.ORDER_RASTER
    cells = tables.order_cells(spark, sf)
    pts = raster.with_cell(_points(spark, sf).select("key", "latitude", "longitude"), meta)
    out = raster.join_cells(pts, cells, raster.cell_table_bytes(meta, 2), 0)
    return finish(out.select("key", "latitude", "longitude", "n_lines", "top_quantity"))


def raster_tile_sample(spark, sf):
    """Points on a half-minute raster of packed tiles: one join by tile."""
    packed = tiles.pack_layers(tables.fine_cells(spark, sf), [1, 12])
    return finish(tiles.sample_tiles(tables.fine_points(spark, sf), packed, tables.FINE_RASTER, [1, 12]))


def elevation_tile_lookup(spark, sf):
    """Elevation lookup on packed tiles of the finer elevation raster."""
    meta = tables.FINE_ELEVATION
    packed = tiles.pack_cells(tables.elevation_cells(spark, sf, meta), ["elevation"], 16)
    return finish(tiles.lookup_elevation_tiles(tables.coordinate_requests(spark, sf), packed, meta, 16))


def _raster_folder(spark, sf) -> str:
    """The driver-table raster as layer files in the shared folder, as a user's raster lies in a folder of its own."""
    folder = f"{shared_folder(spark)}/rasters-{uuid.uuid4().hex}"
    fs, at = rasterfile.file_system(folder)
    fs.create_dir(at)
    cells = tables.raster_cells(spark, sf).toPandas()  # the fixture: 36 x 72 cells of 8 layers
    for var, layer in cells.groupby("var"):
        values = np.full((META.n_rows, META.n_cols), META.nodata, np.float32)
        values[layer["row_id"], layer["col_id"]] = layer["value"]
        rasterfile.write_layer(f"{folder}/bio_{var}.tif", values, META, rows_per_strip=8)
    return folder


def raster_file_sample(spark, sf):
    """Point sampling on a raster that is read from files, two of its eight layers."""
    folder = _raster_folder(spark, sf)
    cells, meta = rasterfile.read_raster_files(spark, folder, [1, 12]), rasterfile.raster_files_meta(folder, [1, 12])
    out = raster.sample_wide(_points(spark, sf).select("key", "latitude", "longitude"), cells, meta, [1, 12])
    return finish(out.select("key", "latitude", "longitude", "bio1", "bio12"))


def occ_page_sequence(spark, sf):
    """Paged fetches that may break off: the records a client has read by then."""
    return finish(readers.read_page_sequence(tables.request_pages(spark, sf), 20, ["series"], limit=300))


def raster_cached_sample(spark, sf):
    """Point sampling behind a cache on rounded coordinates, first arrival wins."""
    pts = _points(spark, sf).select("key", (F.col("latitude") + (F.col("key") % 9) * 1e-4 - 4e-4).alias("latitude"), "longitude")
    out = raster.sample_wide_cached(pts, tables.raster_cells(spark, sf), META)
    return finish(out.select("key", *CLIMATE_VARIABLES))


def grid_attach_replies(spark, sf):
    """Grid rows filled from replies that carry coordinates, last write wins."""
    return finish(grid.attach_replies(tables.reply_grid(spark, sf), tables.coordinate_replies(spark, sf), ["elevation", "bio1"]))


def ml_ready_csv_text(spark, sf):
    """The model-ready table as the CSV sink prints it."""
    return sinks.ml_ready_text(_ml_ready(spark, sf, None), ["key", *ML_READY_COLUMNS])


def ml_ready_global(spark, sf):
    return finish(_ml_ready(spark, sf, None))


def ml_ready_local(spark, sf):
    return finish(_ml_ready(spark, sf, LOCAL_COUNTRY))


def holdout_global(spark, sf):
    return finish(ml_ready.holdout(_ml_ready(spark, sf, None), _ml_ready(spark, sf, LOCAL_COUNTRY)))


def label_class_balance(spark, sf):
    """Class balance of the two binary columns of ``labels`` (one aggregate pass)."""
    lab = tables.read_table(spark, sf, "labels").select("quality", "toxic")
    stacked = lab.select(F.explode(F.array(
        F.struct(F.lit("quality").alias("label_name"), F.col("quality").alias("presence")),
        F.struct(F.lit("toxic").alias("label_name"), F.col("toxic").alias("presence")),
    )).alias("s")).select("s.*")
    y = F.col("presence")
    agg = stacked.groupBy("label_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("n_presence"),
        F.coalesce(F.max((y == 1).cast("int")), F.lit(0)).cast("boolean").alias("has_presence"),
        F.coalesce(F.max((y == 0).cast("int")), F.lit(0)).cast("boolean").alias("has_background"),
    )
    return agg.select(
        "label_name", "n_rows", "n_presence", (F.col("n_rows") - F.col("n_presence")).alias("n_background"),
        "has_presence", "has_background",
    )


def presence_default(spark, sf):
    return finish(filters.add_presence_default(_ml_ready(spark, sf, LOCAL_COUNTRY)))


def class_balance(spark, sf):
    train, val = _training_sets(spark, sf)
    a = training.class_balance(train).select(F.lit("train").alias("dataset"), "*")
    b = training.class_balance(val).select(F.lit("validation").alias("dataset"), "*")
    return a.unionByName(b)


def background_points(spark, sf):
    train = training.training_set(_ml_ready(spark, sf, None))
    return finish(train.select("key", "presence", *ML_READY_COLUMNS))


def split_80_20(spark, sf):
    df = _ml_ready(spark, sf, None)
    return df.select("key", sampling.split_label("key").alias("split"))


def folds(spark, sf):
    train = training.training_set(_ml_ready(spark, sf, None))
    return train.select("key", "presence", sampling.fold_id("key", 3, label="presence").alias("fold"))


def stratified_folds(spark, sf):
    train = training.training_set(_ml_ready(spark, sf, None))
    return sampling.stratified_folds(train, 3).select("key", "presence", "fold")


def subsample(spark, sf):
    train, val = _training_sets(spark, sf)
    t, v = sampling.subsample(train, val, SUBSAMPLE_ROWS, tiebreak=["presence"])
    cols = ["key", "presence", "latitude", "longitude"]
    out = t.select(F.lit("train").alias("dataset"), *cols).unionByName(v.select(F.lit("validation").alias("dataset"), *cols))
    return finish(out)


# ---------------------------------------------------------------- metrics


def _scored(spark, sf):
    return tables.scored(spark, sf)


def confusion_at_threshold(spark, sf):
    return metrics.confusion(_scored(spark, sf), 0.5)


def standard_metrics(spark, sf):
    return finish(metrics.standard_metrics(_scored(spark, sf), 0.5))


def roc_auc(spark, sf):
    return finish(metrics.roc_auc(_scored(spark, sf)))


def average_precision(spark, sf):
    return finish(metrics.average_precision(_scored(spark, sf)))


def roc_points(spark, sf):
    return finish(metrics.roc_points(_scored(spark, sf)))


def threshold_sweep(spark, sf):
    return finish(metrics.threshold_sweep(_scored(spark, sf)))


def optimal_threshold(spark, sf):
    return finish(metrics.optimal_threshold(_scored(spark, sf)))


def classification_report(spark, sf):
    return finish(metrics.classification_report(_scored(spark, sf), 0.5))


def model_scores(spark, sf):
    per_model = metrics.standard_metrics(tables.prediction_log(spark, sf), 0.5, by=["model"])
    out = metrics.model_scores(per_model)
    return finish(
        out.select("model", "auc", "f1_score", "accuracy", "specificity", "sensitivity", "average_precision", "score", "is_best", "rank")
    )


def transfer_gap(spark, sf):
    return finish(metrics.transfer_gap(tables.prediction_log(spark, sf)))


def fold_mean_auc(spark, sf):
    """Mean AUC over three key-hash folds, per model of the prediction log."""
    return finish(training.fold_mean_auc(tables.prediction_log(spark, sf)))


# ---------------------------------------------------------------- grid and risk analytics


def grid_points(spark, sf):
    rm = _risk_map(spark, sf)
    return finish(rm.points.select(*grid.GRID_COLUMNS))


def grid_enriched(spark, sf):
    rm = _risk_map(spark, sf)
    return finish(rm.filled.select("idx", "latitude", "longitude", "elevation", *CLIMATE_VARIABLES, "matched", "sin_month", "cos_month"))


def null_profile(spark, sf):
    return grid.null_profile(_risk_map(spark, sf).enriched)


def match_coverage(spark, sf):
    return grid.match_coverage(_risk_map(spark, sf).enriched)


def risk_summary(spark, sf):
    rm = _risk_map(spark, sf)
    return finish(grid.risk_summary(rm.scored, rm.month))


def risk_distribution(spark, sf):
    return finish(grid.risk_distribution(_risk_map(spark, sf).scored))


def risk_stats(spark, sf):
    rm = _risk_map(spark, sf)
    return finish(grid.risk_stats(rm.scored, max_rows=rm.n * rm.n))


def risk_category(spark, sf):
    out = grid.categorize(_risk_map(spark, sf).scored)
    return finish(out.select("idx", "risk", "risk_category", "risk_description"))


def risk_color(spark, sf):
    out = grid.categorize(_risk_map(spark, sf).scored)
    return finish(out.select("idx", "risk", "risk_color", bins.legend_color("risk").alias("legend_color")))


def hotspots_top5(spark, sf):
    return finish(grid.hotspots(_risk_map(spark, sf).scored))


def grid_extent(spark, sf):
    return finish(grid.grid_extent(_risk_map(spark, sf).points))


def grid_cells_geojson(spark, sf):
    rm = _risk_map(spark, sf)
    cells = grid.grid_cells(rm.scored, rm.n)
    return finish(cells.drop("ring", "navigation_url", "risk_description"))


def grid_cells_geojson_text(spark, sf):
    rm = _risk_map(spark, sf)
    return sinks.geojson_feature_lines(grid.grid_cells(rm.scored, rm.n))


def geojson_text_parsed(spark, sf):
    """The GeoJSON lines read back: ring points, link and properties of every feature."""
    schema = (
        "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, "
        "properties struct<risk: double, risk_percent: string, risk_category: string, risk_description: string, "
        "lat: double, lon: double, navigation_url: string>"
    )
    f = grid_cells_geojson_text(spark, sf).select(F.from_json("value", schema).alias("f")).select("f.*")
    ring = F.col("geometry.coordinates")[0]
    link = F.split_part(F.col("properties.navigation_url"), F.lit("destination="), F.lit(2))
    out = f.select(
        F.col("type").alias("feature_type"),
        F.col("geometry.type").alias("geometry_type"),
        F.size(ring).alias("n_ring"),
        *[ring[k][0].alias(f"p{k}_lon") for k in range(5)],
        *[ring[k][1].alias(f"p{k}_lat") for k in range(5)],
        F.col("properties.risk").alias("risk"),
        F.col("properties.risk_percent").alias("risk_percent"),
        F.col("properties.risk_category").alias("risk_category"),
        F.split_part(link, F.lit(","), F.lit(1)).cast("double").alias("link_lat"),
        F.split_part(link, F.lit(","), F.lit(2)).cast("double").alias("link_lon"),
    )
    return finish(out)


# ---------------------------------------------------------------- documented feature set


def enhanced_features(spark, sf):
    return finish(features.enhanced_features(_ml_ready(spark, sf, None)))


# ---------------------------------------------------------------- trained models (rows-only checks)


_LAST_FIT: dict[tuple, training.TunedModel] = {}


def _fit(spark, sf):
    """One cross-validated fit with its training and validation rows.

    The last fitted model is kept and used again only in the same application
    on the same files (names, sizes, times of change); other input fits anew.
    """
    train, val = _training_sets(spark, sf)
    key = (spark.sparkContext.applicationId, ML_MAX_ITER, *tables.file_stamps(spark, sf, "orders"))
    if key not in _LAST_FIT:
        _LAST_FIT.clear()
        _LAST_FIT[key] = training.tune_gbt(train, max_iter=ML_MAX_ITER)
    return _LAST_FIT[key], train, val


def gbt_train_score(spark, sf):
    cvm, _, val = _fit(spark, sf)
    return finish(training.score(cvm.bestModel, val).select("key", "presence", "risk"))


def second_order_train_score(spark, sf):
    """Second-order trees on features with gaps, scored on the validation rows."""
    train, val = _training_sets(spark, sf)
    gaps = F.when(F.col("key") % 10 >= 3, F.col("elevation"))  # as where an elevation service has no answer
    model = boosting.train_booster(train.withColumn("elevation", gaps), boosting.Params(n_estimators=20))
    return finish(boosting.score(model, val.withColumn("elevation", gaps)).select("key", "presence", "risk"))


def cv_grid(spark, sf):
    cvm, _, _ = _fit(spark, sf)
    return spark.createDataFrame(training.cv_results(cvm), "max_depth int, mean_auc double")


def feature_importance(spark, sf):
    cvm, _, _ = _fit(spark, sf)
    return training.top_importances(training.importances(cvm, spark), 10)


def training_summary(spark, sf):
    cvm, train, val = _fit(spark, sf)
    return finish(training.train_and_evaluate(train, val, tuned=cvm).summary)


def model_risk_summary(spark, sf):
    """The default region's grid scored by the trained model, summarised."""
    cvm, _, _ = _fit(spark, sf)
    rm = risk_map.model_risk_map(
        spark, cvm.bestModel, tables.raster_cells(spark, sf), tables.elevation_cells(spark, sf), META, n=GRID_N, month=GRID_MONTH
    )
    return finish(grid.risk_summary(rm.scored, rm.month))


def rf_baseline(spark, sf):
    train, val = _training_sets(spark, sf)
    with training.learner_input(training.features(train)) as data:
        model = training.rf_pipeline().fit(data)
    scored = training.score(model, val).select("key", "presence", "risk")
    return finish(metrics.optimal_threshold(scored, score="risk", label="presence"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "occ_scan_project": occ_scan_project,
    "occ_pages_explode": occ_pages_explode,
    "taxon_resolve": taxon_resolve,
    "occ_quality_filter": occ_quality_filter,
    "occ_count": occ_count,
    "occ_limit_offset": occ_limit_offset,
    "temporal_features": temporal_features,
    "raster_sample": raster_sample,
    "raster_sample_wide": raster_sample_wide,
    "raster_dedup_sample": raster_dedup_sample,
    "layer_check": layer_check,
    "elevation_lookup": elevation_lookup,
    "coord_validation": coord_validation,
    "env_extract_batch": env_extract_batch,
    "elevation_request_batches": elevation_request_batches,
    "elevation_extract": elevation_extract,
    "elevation_replies": elevation_replies,
    "request_formats": request_formats,
    "raster_sample_shuffle": raster_sample_shuffle,
    "raster_tile_sample": raster_tile_sample,
    "elevation_tile_lookup": elevation_tile_lookup,
    "raster_file_sample": raster_file_sample,
    "occ_page_sequence": occ_page_sequence,
    "raster_cached_sample": raster_cached_sample,
    "grid_attach_replies": grid_attach_replies,
    "stratified_folds": stratified_folds,
    "ml_ready_csv_text": ml_ready_csv_text,
    "geojson_text_parsed": geojson_text_parsed,
    "ml_ready_global": ml_ready_global,
    "ml_ready_local": ml_ready_local,
    "holdout_global": holdout_global,
    "class_balance": class_balance,
    "presence_default": presence_default,
    "label_class_balance": label_class_balance,
    "background_points": background_points,
    "split_80_20": split_80_20,
    "folds": folds,
    "subsample": subsample,
    "confusion_at_threshold": confusion_at_threshold,
    "standard_metrics": standard_metrics,
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "roc_points": roc_points,
    "threshold_sweep": threshold_sweep,
    "optimal_threshold": optimal_threshold,
    "classification_report": classification_report,
    "grid_points": grid_points,
    "grid_enriched": grid_enriched,
    "null_profile": null_profile,
    "match_coverage": match_coverage,
    "risk_summary": risk_summary,
    "risk_distribution": risk_distribution,
    "risk_stats": risk_stats,
    "risk_category": risk_category,
    "risk_color": risk_color,
    "hotspots_top5": hotspots_top5,
    "grid_extent": grid_extent,
    "grid_cells_geojson": grid_cells_geojson,
    "grid_cells_geojson_text": grid_cells_geojson_text,
    "model_scores": model_scores,
    "transfer_gap": transfer_gap,
    "fold_mean_auc": fold_mean_auc,
    "enhanced_features": enhanced_features,
    "gbt_train_score": gbt_train_score,
    "second_order_train_score": second_order_train_score,
    "cv_grid": cv_grid,
    "feature_importance": feature_importance,
    "rf_baseline": rf_baseline,
    "training_summary": training_summary,
    "model_risk_summary": model_risk_summary,
}
