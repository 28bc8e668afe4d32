"""Environment extraction for coordinate requests (climate + elevation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelab.functions.formats import batch_id, location_list, normalize_variable
from nichelab.functions.temporal import iso_utc_now
from nichelab.operators import filters, raster, tiles
from nichelab.schemas import CLIMATE_VARIABLES, DEFAULT_ELEVATION_DATASET, ELEVATION_BATCH_SIZE
from nichelab.sources.tables import RasterMeta


def extract_environment(
    requests: DataFrame,
    cells: DataFrame,
    elev: DataFrame,
    meta: RasterMeta,
    variables: list[str] = CLIMATE_VARIABLES,
    strict: bool = False,
    provenance: bool = False,
    elev_meta: RasterMeta | None = None,
    wide: DataFrame | None = None,
    packed: DataFrame | None = None,
    tile: int = tiles.TILE,
) -> DataFrame:
    """Per request point: one column per requested variable (named as
    requested; unusable names give a null column), elevation, coordinate
    ``error`` and ``elevation_status``; the request order key ``pos`` is kept.
    ``wide`` is a stored wide cell table, ``packed`` a tile table (``tiles.pack_layers``), for fine rasters."""
    pts = filters.validate_coordinates(requests, strict)
    normalized = [normalize_variable(v) for v in variables]
    numbers = sorted({int(n[3:]) for n in normalized if n is not None})
    if numbers and wide is None and packed is None:
        raster.require_layers(cells, raster.layer_names(numbers))
    if numbers and packed is not None:
        env = tiles.sample_tiles(pts, packed, meta, numbers, tile)
    else:
        env = raster.sample_wide(pts, cells, meta, numbers, wide=wide) if numbers else pts
    env = raster.lookup_elevation(env, elev, elev_meta or meta).withColumnRenamed("status", "elevation_status")
    value_cols = []
    for raw, norm in zip(variables, normalized):
        col = F.col(norm) if norm is not None else F.lit(None).cast("double")
        value_cols.append(col.alias(str(raw)))
    base = [c for c in requests.columns]
    out = env.select(*base, *value_cols, "elevation", "error", "elevation_status")
    if provenance:
        out = out.withColumn("extraction_date", iso_utc_now()).withColumn(
            "data_source", F.lit(f"raster_{meta.res:g}deg")
        )
    return out


def extract_elevation(
    requests: DataFrame, elev: DataFrame, meta: RasterMeta, strict: bool = False
) -> DataFrame:
    """Per request point: elevation, dataset and a status (ok / missing_result / Invalid coordinates)."""
    pts = filters.validate_coordinates(requests, strict).drop("error")
    out = raster.lookup_elevation(pts, elev, meta)
    return out.withColumn("dataset", F.lit(DEFAULT_ELEVATION_DATASET))


def request_batches(requests: DataFrame, size: int = ELEVATION_BATCH_SIZE) -> DataFrame:
    """Request points grouped into fixed-size batches by position, each with
    its point count and the ``lat,lon|...`` location text a batch request sends."""
    b = requests.withColumn("batch", batch_id("pos", size))
    return b.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_points"),
        location_list("pos", "latitude", "longitude").alias("locations"),
    )
