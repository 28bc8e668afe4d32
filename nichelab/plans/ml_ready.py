"""Model-ready occurrence tables (global and local).

One lazy plan per output: scan -> taxon semi-join -> record filters ->
projection -> temporal features -> one raster join (wide cells) -> one
elevation join -> conform -> completeness filter.  Exchanges appear only
where a cell table is too large to broadcast (and for an optional ordered
row limit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelab.functions.numeric import bround6
from nichelab.operators import filters, raster, sampling
from nichelab.schemas import CLIMATE_VARIABLES, ML_READY, ML_READY_INT_COLUMNS, PIPELINE_UNCERTAINTY_MAX, REQUIRED_NON_NULL
from nichelab.sources.tables import RasterMeta


def species_records(
    occ: DataFrame,
    taxa: DataFrame,
    taxon_key: int,
    country: str | None = None,
    uncertainty_max: float | None = PIPELINE_UNCERTAINTY_MAX,
    date_from: str | None = None,
    date_to: str | None = None,
    max_records: int | None = None,
) -> DataFrame:
    """Filtered records of one species (taxon lookup, quality, country, uncertainty, dates)."""
    resolved = filters.resolve_taxon(taxa.filter(F.col("taxonKey") == F.lit(taxon_key)))
    recs = filters.filter_taxa(occ, resolved)
    recs = filters.occurrence_filters(recs, True, date_from, date_to, country, uncertainty_max)
    if max_records:
        recs = sampling.page(recs, "key", 0, max_records)
    return recs


def presence_points(occ: DataFrame, taxa: DataFrame, taxon_key: int, country: str | None = None) -> DataFrame:
    """(key, latitude, longitude, event_date, year, month, day) of usable records."""
    recs = species_records(occ, taxa, taxon_key, country)
    return filters.drop_missing_coordinates(filters.project_occurrences(recs))


def build_ml_ready(
    occ: DataFrame,
    taxa: DataFrame,
    cells: DataFrame,
    elev: DataFrame,
    meta: RasterMeta,
    taxon_key: int,
    country: str | None = None,
    max_records: int | None = None,
    keep_key: bool = True,
    elev_meta: RasterMeta | None = None,
    wide: DataFrame | None = None,
    layers: list[str] | None = None,
    broadcast_limit: int = raster.DEFAULT_BROADCAST_LIMIT,
) -> DataFrame:
    """``key`` + the 15 model-ready columns; rows missing a climate value, the
    month or its sin/cos are dropped (elevation and day_of_year may be null).

    ``elev_meta`` is the elevation raster's geometry where it differs from the
    climate raster's; ``wide`` a stored wide cell table, which saves the pivot.
    The climate source must hold ``layers`` (default: those the job reads).
    """
    if wide is None:
        raster.require_layers(cells, layers or CLIMATE_VARIABLES)
    recs = species_records(occ, taxa, taxon_key, country, max_records=max_records)
    pts = filters.drop_missing_coordinates(filters.project_occurrences(recs))
    feats = filters.add_temporal_features(pts)
    env = raster.sample_wide(feats, cells, meta, broadcast_limit=broadcast_limit, wide=wide)
    env = raster.lookup_elevation(env, elev, elev_meta or meta, broadcast_limit).drop("status")
    out = filters.conform(env, ML_READY, keep=["key"] if keep_key else [])
    return filters.drop_incomplete(out, REQUIRED_NON_NULL)


def rounded(df: DataFrame) -> DataFrame:
    """Export rounding: doubles half-even to 6 decimals, integer columns unchanged."""
    return df.select(
        *[
            F.col(c) if c in ML_READY_INT_COLUMNS or c == "key" or c == "presence" else bround6(c).alias(c)
            for c in df.columns
        ]
    )


def holdout(global_df: DataFrame, local_df: DataFrame) -> DataFrame:
    """Global rows whose record is not in the local table (no train/validation leakage)."""
    return global_df.join(local_df.select("key"), "key", "left_anti")
