"""Incremental model-ready rows from a folder of arriving occurrence files.

Every step of the enrichment is stateless per record (filters, projection,
temporal features) or a stream-static left join against the raster and
elevation cell tables, so the batch operators apply to the stream as they
are: no watermark or state store is needed.  The sink is a parquet folder
with a checkpoint, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from nichelab.operators import filters, raster
from nichelab.schemas import ML_READY, OCCURRENCE, PIPELINE_UNCERTAINTY_MAX, REQUIRED_NON_NULL
from nichelab.sources.tables import RasterMeta


def occurrence_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(OCCURRENCE).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def enrich(
    occ: DataFrame,
    cells: DataFrame,
    elev: DataFrame,
    meta: RasterMeta,
    country: str | None = None,
    uncertainty_max: float | None = PIPELINE_UNCERTAINTY_MAX,
    elev_meta: RasterMeta | None = None,
    wide: DataFrame | None = None,
    broadcast_limit: int = raster.DEFAULT_BROADCAST_LIMIT,
) -> DataFrame:
    """Same rows as the batch model-ready job (without the taxon lookup and
    the row limit, which are whole-table operations)."""
    recs = filters.occurrence_filters(occ, True, None, None, country, uncertainty_max)
    pts = filters.drop_missing_coordinates(filters.project_occurrences(recs))
    feats = filters.add_temporal_features(pts)
    env = raster.sample_wide(feats, cells, meta, broadcast_limit=broadcast_limit, wide=wide)
    env = raster.lookup_elevation(env, elev, elev_meta or meta, broadcast_limit).drop("status")
    out = filters.conform(env, ML_READY, keep=["key"])
    return filters.drop_incomplete(out, REQUIRED_NON_NULL)


def start(
    enriched: DataFrame,
    sink_path: str,
    checkpoint_path: str,
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Append to a parquet folder; ``available_now`` drains what is there and stops."""
    writer = enriched.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint_path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(sink_path)
