"""Reference-shaped relations derived from the driver's parquet tables.

The driver ships TPC-H-like tables; these views give them the shapes the
species-distribution jobs read (occurrence records, raster cells, elevation
cells, taxon matches, scored predictions).  They are plain projections, so
column pruning and filter pushdown reach the parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelab.schemas import CLIMATE_NUMBERS, TAXON


@dataclass(frozen=True)
class RasterMeta:
    """Geometry of a north-up raster: cell (row, col) covers
    ``[top - (row+1) res, top - row res) x [left + col res, left + (col+1) res)``."""

    left: float
    top: float
    res: float
    n_rows: int
    n_cols: int
    nodata: float | None
    # (layer number, nodata value) where a layer differs from ``nodata``
    layer_nodata: tuple[tuple[int, float | None], ...] = ()

    @classmethod
    def from_dict(cls, d: dict) -> RasterMeta:
        """Geometry from JSON: left, top, res, n_rows, n_cols, nodata and optionally layer_nodata by layer number."""
        own = tuple(sorted((int(k), v) for k, v in (d.get("layer_nodata") or {}).items()))
        return cls(float(d["left"]), float(d["top"]), float(d["res"]), int(d["n_rows"]), int(d["n_cols"]), d.get("nodata"), own)

    @classmethod
    def global_grid(cls, minutes: float, nodata: float | None = None) -> RasterMeta:
        """The whole globe at a resolution in arc minutes (10, 5, 2.5, 0.5)."""
        rows = round(180 * 60 / minutes)
        return cls(-180.0, 90.0, minutes / 60.0, rows, 2 * rows, nodata)

    @property
    def n_cells(self) -> int:
        return self.n_rows * self.n_cols


# the driver-table raster: a 5-degree global grid (36 x 72 cells)
FIXTURE_RASTER = RasterMeta(left=-180.0, top=90.0, res=5.0, n_rows=36, n_cols=72, nodata=-9999.0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def file_stamps(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """(path, bytes, time of change) of a table's files, through Hadoop's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrence records (schema ``OCCURRENCE``) derived from ``orders``."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = F.col("o_orderdate")
    day_text = d.cast("date").cast("string")
    null_int = F.lit(None).cast("int")
    return o.select(
        k.alias("key"),
        (F.lit(100) + c % 3).cast("long").alias("taxonKey"),
        F.when(k % 17 == 0, F.lit(None).cast("double"))
        .otherwise(((c * 7919) % 17000 - 8500).cast("double") / F.lit(100.0))
        .alias("decimalLatitude"),
        (((c * 104729) % 36000 - 18000).cast("double") / F.lit(100.0)).alias("decimalLongitude"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .when(k % 29 == 0, F.lit("junk"))
        .when(k % 31 == 0, F.concat(day_text, F.lit("/2002-01-01")))
        .otherwise(day_text)
        .alias("eventDate"),
        F.when(k % 5 == 0, null_int).otherwise(F.year(d).cast("int")).alias("year"),
        F.when(k % 5 == 0, null_int).when(k % 37 == 0, F.lit(13)).otherwise(F.month(d).cast("int")).alias("month"),
        F.when(k % 7 == 0, null_int).when(k % 41 == 0, F.lit(31)).otherwise(F.dayofmonth(d).cast("int")).alias("day"),
        F.when(c % 4 == 0, F.lit("ZA")).otherwise(F.lit("XX")).alias("country"),
        F.when(k % 11 == 0, F.lit(None).cast("double"))
        .otherwise(((k * 37) % 15000).cast("double"))
        .alias("coordinateUncertaintyInMeters"),
        (k % 17 != 0).alias("hasCoordinate"),
        (k % 19 == 0).alias("hasGeospatialIssue"),
        F.when(k % 23 == 0, F.lit("ABSENT")).otherwise(F.lit("PRESENT")).alias("occurrenceStatus"),
    )


def raster_cells(spark: SparkSession, sf_dir: str | None = None, meta: RasterMeta = FIXTURE_RASTER) -> DataFrame:
    """Long cell table ``(var, row_id, col_id, value float)`` of the 8 climate layers.

    Generated with ``range`` (no joins); nodata cells carry -9999.  In
    production this is a Parquet table partitioned by ``var`` (see
    ``readers.read_raster_cells``) so a layer filter prunes whole folders.
    """
    nv = len(CLIMATE_NUMBERS)
    ids = spark.range(meta.n_cells * nv)
    cell = (F.col("id") / nv).cast("long")
    a = (cell / meta.n_cols).cast("long")
    b = cell % meta.n_cols
    var = F.element_at(F.array(*[F.lit(v) for v in CLIMATE_NUMBERS]), (F.col("id") % nv + 1).cast("int"))
    df = ids.select(a.alias("a"), b.alias("b"), var.alias("var"))
    a, b, v = F.col("a"), F.col("b"), F.col("var")
    value = (
        F.when((a * meta.n_cols + b + v) % 23 == 0, F.lit(-9999.0))
        .otherwise(((a * 31 + b * 17 + v * 101) % 500).cast("double"))
        .cast("float")
    )
    cells = df.select(v.cast("int").alias("var"), a.cast("int").alias("row_id"), b.cast("int").alias("col_id"), value.alias("value"))
    cells.layers = set(CLIMATE_NUMBERS)  # known without a scan
    return cells


def elevation_cells(spark: SparkSession, sf_dir: str | None = None, meta: RasterMeta = FIXTURE_RASTER) -> DataFrame:
    """Elevation cells ``(row_id, col_id, elevation)``; every 29th cell is missing."""
    ids = spark.range(meta.n_cells)
    a = (F.col("id") / meta.n_cols).cast("long")
    b = F.col("id") % meta.n_cols
    return (
        ids.filter(F.col("id") % 29 != 0)
        .select(
            a.cast("int").alias("row_id"),
            b.cast("int").alias("col_id"),
            ((a * 131 + b * 71) % 3000).cast("double").alias("elevation"),
        )
    )


# an elevation raster of its own resolution: 2.5 degrees (72 x 144 cells)
FINE_ELEVATION = RasterMeta(left=-180.0, top=90.0, res=2.5, n_rows=72, n_cols=144, nodata=None)
# a half-degree raster whose cells come from ``lineitem``
ORDER_RASTER = RasterMeta(left=-180.0, top=90.0, res=0.5, n_rows=360, n_cols=720, nodata=None)


def order_cells(spark: SparkSession, sf_dir: str, meta: RasterMeta = ORDER_RASTER) -> DataFrame:
    """Wide cells ``(row_id, col_id, n_lines, top_quantity)`` from ``lineitem``: the table grows with the data."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return li.groupBy(
        (F.col("l_orderkey") % meta.n_rows).cast("int").alias("row_id"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % meta.n_cols).cast("int").alias("col_id"),
    ).agg(F.count(F.lit(1)).alias("n_lines"), F.max("l_quantity").cast("double").alias("top_quantity"))


# the half-minute raster of the globe (21,600 x 43,200 cells); its cells come from ``lineitem``, in a window
FINE_RASTER = RasterMeta.global_grid(0.5, nodata=-9999.0)
FINE_WINDOW = (12_345, 20_321, 512)  # first row, first column, rows and columns


def fine_cells(spark: SparkSession, sf_dir: str, meta: RasterMeta = FINE_RASTER) -> DataFrame:
    """Long cells of two layers of the half-minute raster, in a window; the number of cells grows with ``lineitem``."""
    row0, col0, n = FINE_WINDOW
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    row = (F.col("l_orderkey") * 31 + F.col("l_suppkey")) % n + row0
    col = (F.col("l_partkey") * 7 + F.col("l_orderkey")) % n + col0
    per_cell = li.groupBy(row.cast("int").alias("row_id"), col.cast("int").alias("col_id")).agg(
        F.max("l_quantity").cast("float").alias("top"), F.count(F.lit(1)).cast("float").alias("lines")
    )
    empty = (F.col("row_id") + F.col("col_id")) % 23 == 0
    both = F.array(
        F.struct(F.lit(1).alias("var"), F.when(empty, F.lit(meta.nodata).cast("float")).otherwise(F.col("top")).alias("value")),
        F.struct(F.lit(12).alias("var"), F.col("lines").alias("value")),
    )
    return per_cell.select("row_id", "col_id", F.explode(both).alias("v")).select("v.var", "row_id", "col_id", "v.value")


def fine_points(spark: SparkSession, sf_dir: str, meta: RasterMeta = FINE_RASTER) -> DataFrame:
    """Points ``(key, latitude, longitude)`` from ``orders``, in and around the window of ``fine_cells``."""
    row0, col0, n = FINE_WINDOW
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    row = ((k * 31 + c) % (n + 20) + (row0 - 10)).cast("double") + F.lit(0.25)
    col = ((c * 7 + k) % (n + 20) + (col0 - 10)).cast("double") + F.lit(0.5)
    return o.select(
        k.alias("key"), (F.lit(meta.top) - row * F.lit(meta.res)).alias("latitude"), (F.lit(meta.left) + col * F.lit(meta.res)).alias("longitude")
    )


def request_pages(spark: SparkSession, sf_dir: str, size: int = 20, series: int = 7) -> DataFrame:
    """Pages ``(series, offset, total, page)`` of several paged fetches of the coordinate requests.

    Some pages are missing, some failed (null), some are short.
    """
    req = coordinate_requests(spark, sf_dir).withColumn("series", F.col("pos") % series)
    place = F.floor(F.col("pos") / series).cast("long")
    req = req.withColumn("index", F.floor(place / size).cast("long"))
    record = F.struct("pos", "latitude", "longitude")
    per_page = req.groupBy("series", "index").agg(F.array_sort(F.collect_list(record)).alias("all"))  # a page size of rows
    totals = req.groupBy("series").agg(F.count(F.lit(1)).alias("total"))
    code = F.col("series") * 31 + F.col("index") * 7
    short = F.when(code % 23 == 17, F.slice("all", 1, F.greatest(F.size("all") - 3, F.lit(0)))).otherwise(F.col("all"))
    pages = per_page.filter((F.col("series") * 13 + F.col("index")) % 29 != 5).join(totals, "series")
    page = F.when(code % 37 != 11, F.struct(short.alias("results")))
    return pages.select("series", (F.col("index") * size).alias("offset"), "total", page.alias("page"))


def coordinate_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies ``(arrival, latitude, longitude, elevation, bio1)`` to coordinates, several for the same ones, with gaps."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("arrival"),
        ((c * 7919) % 180 - 90).cast("double").alias("latitude"),
        F.when(k % 43 == 0, F.lit(None).cast("double")).otherwise(((c * 31) % 36 * 10 - 180).cast("double")).alias("longitude"),
        F.when(k % 3 != 0, ((k * 37) % 3000).cast("double")).alias("elevation"),
        F.when(k % 5 != 0, ((k * 11) % 400).cast("double")).alias("bio1"),
    )


def reply_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid rows ``(idx, latitude, longitude)`` of whole degrees from ``customer``, with rows that repeat."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return c.select(k.alias("idx"), ((k * 7919) % 180 - 90).cast("double").alias("latitude"), ((k * 17) % 36 * 10 - 180).cast("double").alias("longitude"))


def elevation_replies(spark: SparkSession, sf_dir: str, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """Requests ``(batch, pos, latitude, longitude)`` and the service's replies ``(batch, response)`` as JSON text.

    Some batches are refused, some replies are three points short, and some
    results name no location or no dataset.
    """
    req = coordinate_requests(spark, sf_dir).withColumn("batch", F.floor(F.col("pos") / size).cast("long"))
    pos = F.col("pos")
    location = F.when(pos % 11 != 0, F.struct((F.col("latitude") + 0.25).alias("lat"), (F.col("longitude") - 0.25).alias("lng")))
    result = F.struct(
        pos,
        ((pos * 37) % 3000).cast("double").alias("elevation"),
        F.when(pos % 13 != 0, F.lit("aster30m")).alias("dataset"),
        location.alias("location"),
    )
    batch = req.groupBy("batch").agg(F.array_sort(F.collect_list(result)).alias("all"))  # a batch size of rows
    kept = F.when(F.col("batch") % 5 == 2, F.slice("all", 1, F.greatest(F.size("all") - 3, F.lit(0)))).otherwise(F.col("all"))
    refused = F.col("batch") % 7 == 3
    reply = F.struct(F.when(refused, F.lit("OVER_QUERY_LIMIT")).otherwise(F.lit("OK")).alias("status"), F.when(~refused, kept).alias("results"))
    return req.select("batch", "pos", "latitude", "longitude"), batch.select("batch", F.to_json(reply).alias("response"))


def taxon_matches(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """Name-match documents: exact species, fuzzy species with speciesKey 0, genus."""
    rows = [
        (100, "EXACT", "SPECIES", 100, 900),
        (101, "FUZZY", "SPECIES", 0, 101),
        (102, "HIGHERRANK", "GENUS", None, 102),
    ]
    return spark.createDataFrame(rows, TAXON)


def _score(event_id: Column) -> Column:
    return ((event_id * 7919) % 1000).cast("double") / F.lit(1000.0)


def _label(event_id: Column) -> Column:
    return F.when(((event_id * 31) % 7 < 4) & ((event_id * 7919) % 1000 > 300), F.lit(1)).otherwise(F.lit(0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows ``(key, risk, label)`` from ``events``: both classes, many ties."""
    e = read_table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    return e.select(eid.alias("key"), _score(eid).alias("risk"), _label(eid).alias("label"))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of several models ``(model, key, risk, label)``; ``event_type`` names the model."""
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    eid = F.col("event_id")
    return e.select(
        F.col("event_type").alias("model"), eid.alias("key"), _score(eid).alias("risk"), _label(eid).alias("label")
    )


def coordinate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate request rows ``(pos, latitude, longitude)`` from ``customer``;
    about 5 % fall outside +-90 / +-180."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return c.select(
        k.alias("pos"),
        (((k * 7919) % 1900 - 950).cast("double") / F.lit(10.0)).alias("latitude"),
        (((k * 104729) % 3700 - 1850).cast("double") / F.lit(10.0)).alias("longitude"),
    )
