"""File sources with declared schemas (no inference on the hot path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nichelab.schemas import DEFAULT_ELEVATION_DATASET, ELEVATION_RESPONSE, ML_READY, OCCURRENCE, OCCURRENCE_PAGE, RASTER_CELL


def read_occurrences(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Flat occurrence records from a folder of parquet, JSON lines or tab-separated files.

    The files are the pages: Spark reads them all in parallel, and a bad
    file fails the job (no partial result is returned silently).
    """
    reader = spark.read.schema(OCCURRENCE)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.json(path)
    if fmt in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    raise ValueError(f"unknown occurrence format: {fmt}")


def explode_pages(pages: DataFrame, page_col: str = "page") -> DataFrame:
    """Page envelopes ``{count, results: [...]}`` -> one row per record (the rest is ignored)."""
    return pages.select(F.explode(F.col(f"{page_col}.results")).alias("r")).select("r.*")


def parse_pages(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON text of page envelopes -> one row per record."""
    parsed = texts.select(F.from_json(F.col(text_col), OCCURRENCE_PAGE).alias("page"))
    return explode_pages(parsed)


def read_occurrence_pages(spark: SparkSession, path: str) -> DataFrame:
    """Folder of JSON page documents (one envelope per file) -> records."""
    pages = spark.read.schema(OCCURRENCE_PAGE).option("multiLine", True).json(path)
    return pages.select(F.explode("results").alias("r")).select("r.*")


def full_prefix(pages: DataFrame, by: list[str], index: str, full: str, span: int = 1024) -> DataFrame:
    """By group, ``stop``: the first page number that is not there in full (0 where the first page is not).

    Pages are gathered per range of ``span`` numbers (at most ``span`` entries, combined
    before the shuffle), and only the ranges are compared: the answer is the first
    number missing within a range, or the start of a range that is not there
    although the one before it is whole; the smallest of these is the first.
    """
    ranged = pages.filter(F.col(full)).select(*by, F.col(index).alias("_i"), F.floor(F.col(index) / span).alias("_range"))
    held = ranged.groupBy(*by, "_range").agg(F.collect_set("_i").alias("_held"))
    start = F.col("_range") * span
    gap = F.array_min(F.array_except(F.sequence(start, start + (span - 1)), "_held"))
    ranges = held.select(*by, "_range", gap.alias("_gap"))
    ahead = ranges.select(*by, (F.col("_range") - 1).alias("_range"), F.lit(True).alias("_next"))
    joined = ranges.join(ahead, [*by, "_range"], "left")
    found = F.coalesce(F.col("_gap"), F.when(F.col("_next").isNull(), start + span))
    stops = joined.groupBy(*by).agg(F.when(F.min("_range") > 0, 0).otherwise(F.min(found)).cast("long").alias("stop"))
    every = pages.select(*by).distinct()
    return every.join(stops, by, "left").select(*by, F.coalesce("stop", F.lit(0)).alias("stop"))


def read_page_sequence(
    pages: DataFrame, size: int, by: list[str], offset: str = "offset", total: str = "total", page: str = "page", limit: int | None = None
) -> DataFrame:
    """Records of paged fetches as a client reads them that asks page after page: ``by``, offset, nth and the record's fields.

    A fetch (one ``by`` group) asks for ``size`` records from ``offset`` 0 on until ``total`` (or ``limit``) is reached.  It ends
    at a page that is missing or failed (``page`` null), which adds nothing, and at one with fewer records than asked
    for, which still counts; the pages before stay.  This is the mode for sources that may break off;
    ``read_occurrence_pages`` takes all or nothing.
    """
    wanted = F.least(total, F.lit(limit)) if limit is not None else F.col(total)
    asked = F.least(F.lit(size).cast("long"), wanted - F.col(offset))
    rows = F.col(f"{page}.results")
    marked = pages.filter((F.col(offset) % size == 0) & (asked > 0)).withColumns(
        {
            "_index": F.floor(F.col(offset) / size).cast("long"),
            "_taken": F.slice(rows, F.lit(1), F.greatest(asked, F.lit(0)).cast("int")),
            "_full": F.coalesce(F.size(rows) >= asked, F.lit(False)),
        }
    )
    stops = full_prefix(marked, by, "_index", "_full")
    read = marked.join(stops, by).filter((F.col("_index") <= F.col("stop")) & F.col("_taken").isNotNull())
    return read.select(*by, offset, F.posexplode("_taken").alias("nth", "_record")).select(*by, offset, "nth", "_record.*")


def read_occurrence_page_files(spark: SparkSession, path: str, size: int, limit: int | None = None) -> DataFrame:
    """A folder of page documents, each with its ``offset`` and the fetch's ``count``, read as ``read_page_sequence`` does.

    A document that cannot be parsed, or names no offset, is a page that is missing.
    """
    schema = T.StructType([T.StructField("offset", T.LongType()), *OCCURRENCE_PAGE.fields])
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    pages = docs.filter(F.col("offset").isNotNull()).select(
        F.lit(0).alias("fetch"), "offset", F.col("count").alias("total"), F.when(F.col("results").isNotNull(), F.struct("results")).alias("page")
    )
    return read_page_sequence(pages, size, ["fetch"], limit=limit).drop("fetch", "nth")


def parse_elevation_responses(
    responses: DataFrame, text_col: str = "response", batch_col: str = "batch"
) -> DataFrame:
    """Elevation service replies -> ``(batch, pos, elevation, dataset, lat, lng, status)``.

    A reply counts only with ``status == 'OK'`` and a non-empty result list;
    ``dataset`` defaults to the service's default; the location is kept as
    sent (callers fall back to the request point when it is missing).
    """
    parsed = responses.select(F.col(batch_col), F.from_json(F.col(text_col), ELEVATION_RESPONSE).alias("r"))
    ok = (F.col("r.status") == F.lit("OK")) & (F.size(F.col("r.results")) > 0)
    return (
        parsed.filter(ok)
        .select(F.col(batch_col), F.posexplode("r.results").alias("pos", "res"))
        .select(
            F.col(batch_col),
            F.col("pos"),
            F.col("res.elevation").alias("elevation"),
            F.coalesce(F.col("res.dataset"), F.lit(DEFAULT_ELEVATION_DATASET)).alias("dataset"),
            F.col("res.location.lat").alias("lat"),
            F.col("res.location.lng").alias("lng"),
        )
    )


def elevation_results(
    responses: DataFrame, requests: DataFrame, text_col: str = "response", batch_col: str = "batch"
) -> DataFrame:
    """Every requested point with its answer: ``(batch, pos, latitude, longitude, elevation, dataset, status)``.

    ``requests`` holds ``batch``, ``pos``, ``latitude``, ``longitude``; the n-th result
    of a reply answers the n-th point of its batch (at most a batch size of rows
    is ordered per batch).  The location is the reply's where it names one, else
    the request's; a point without an answer (short reply, or a reply that does
    not count) is ``missing_result``.
    """
    nth = F.row_number().over(Window.partitionBy(batch_col).orderBy("pos")) - 1
    asked = requests.select(batch_col, "pos", "latitude", "longitude").withColumn("_nth", nth)
    got = parse_elevation_responses(responses, text_col, batch_col).withColumnRenamed("pos", "_nth").withColumn("_hit", F.lit(True))
    joined = asked.join(got, [batch_col, "_nth"], "left")
    return joined.select(
        batch_col,
        "pos",
        F.coalesce("lat", "latitude").alias("latitude"),
        F.coalesce("lng", "longitude").alias("longitude"),
        "elevation",
        "dataset",
        F.when(F.col("_hit").isNull(), F.lit("missing_result")).otherwise(F.lit("ok")).alias("status"),
    )


def read_ml_ready_csv(spark: SparkSession, path: str, with_presence: bool = False) -> DataFrame:
    """Model-ready CSV with header; ``presence`` is read when present in the file."""
    schema = ML_READY
    if with_presence:
        schema = T.StructType([*ML_READY.fields, T.StructField("presence", T.IntegerType())])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_raster_cells(spark: SparkSession, path: str, variables: list[int] | None = None) -> DataFrame:
    """Cell table stored as parquet partitioned by ``var``; a variable list prunes partitions."""
    df = spark.read.schema(RASTER_CELL).parquet(path)
    if variables:
        df = df.filter(F.col("var").isin(variables))
    return df


def read_wide_cells(spark: SparkSession, path: str) -> DataFrame:
    """The stored wide cell table ``(row_id, col_id, bioN...)``."""
    return spark.read.parquet(path)
