"""Point-in-raster sampling as equi-joins on integer cell indices.

A point never range-joins a raster: its (row, col) is computed with plain
arithmetic and then joined to the cell table.  The cell side is broadcast
only when its size, known from the raster geometry, is below a limit; beyond it
the join shuffles on (row, col).  Adaptive execution splits a hot cell (one
cell may hold a third of the points) across tasks; where it does not run
(streams), a salt spreads the points and repeats the cells.  Neither form runs
a job while the plan is built, so both work on streams.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelab.functions.formats import coordinate_key
from nichelab.operators.filters import coordinate_status
from nichelab.operators.joins import salted_left_join
from nichelab.schemas import ALL_LAYERS, CLIMATE_NUMBERS, SCALED_BY_TEN
from nichelab.sources.tables import RasterMeta

# broadcast a cell table only below this size (bytes, estimated from geometry)
DEFAULT_BROADCAST_LIMIT = 256 * 1024 * 1024
# tasks that share a cell's points in a stream, where adaptive execution does not split
STREAM_SALT = 8
# a row in a hash relation: null bits and 8 bytes per column for key and row, and the table's own share
_ROW_OVERHEAD = 48


def cell_index(meta: RasterMeta, lat: str = "latitude", lon: str = "longitude") -> tuple[Column, Column]:
    """(row_id, col_id) of the cell holding the point; null outside the raster.

    Cells are half-open, so latitude ``top - n_rows * res`` and longitude
    ``left + n_cols * res`` fall outside.
    """
    row = F.floor((F.lit(meta.top) - F.col(lat)) / F.lit(meta.res))
    col = F.floor((F.col(lon) - F.lit(meta.left)) / F.lit(meta.res))
    known = ~F.isnan(F.col(lat)) & ~F.isnan(F.col(lon))  # floor turns NaN into cell 0
    inside = known & row.between(0, meta.n_rows - 1) & col.between(0, meta.n_cols - 1)
    return (
        F.when(inside, row.cast("int")).alias("row_id"),
        F.when(inside, col.cast("int")).alias("col_id"),
    )


def with_cell(points: DataFrame, meta: RasterMeta, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    row, col = cell_index(meta, lat, lon)
    return points.withColumns({"row_id": row, "col_id": col})


def clean_value(value: Column, var: Column, nodata: float | None, scale_vars: list[int] = SCALED_BY_TEN) -> Column:
    """Nodata, NaN and +-Inf -> null; temperature layers divided by ten in float32."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    if nodata is not None:
        bad = bad | (value == F.lit(nodata).cast("float"))
    scaled = F.when(var.isin(scale_vars), (value / F.lit(10)).cast("float")).otherwise(value)
    return F.when(bad, F.lit(None).cast("double")).otherwise(scaled.cast("double"))


def clean_cells(cells: DataFrame, meta: RasterMeta, variables: list[int] = CLIMATE_NUMBERS) -> DataFrame:
    """Long cells restricted to ``variables`` (partition pruning on ``var``) with clean values.

    Each layer's own nodata value counts where ``meta.layer_nodata`` names one.
    """
    value = clean_value(F.col("value"), F.col("var"), meta.nodata)
    for var, nodata in (meta.layer_nodata or ()):
        value = F.when(F.col("var") == var, clean_value(F.col("value"), F.col("var"), nodata)).otherwise(value)
    return cells.filter(F.col("var").isin(variables)).select("var", "row_id", "col_id", value.alias("value"))


def widen_cells(cells: DataFrame, meta: RasterMeta, variables: list[int] = CLIMATE_NUMBERS) -> DataFrame:
    """One row per cell, one column ``bioN`` per layer (turns N joins into one).

    Conditional aggregation over a fixed layer list, i.e. a pivot without the
    extra pass that discovers pivot values.  Worth materialising once per
    raster as a parquet table in production.
    """
    clean = clean_cells(cells, meta, variables)
    return clean.groupBy("row_id", "col_id").agg(
        *[F.max(F.when(F.col("var") == F.lit(v), F.col("value"))).alias(f"bio{v}") for v in variables]
    )


def cell_table_bytes(meta: RasterMeta, n_values: int, n_keys: int = 2, rows_per_cell: int = 1) -> int:
    """Upper bound of a cell table's size as a hash relation, from the raster geometry alone.

    A wide table has one row per cell, a long one a row per cell and layer.
    """
    row = _ROW_OVERHEAD + 8 * n_keys + 8 * (n_keys + n_values)
    return meta.n_cells * rows_per_cell * row


def long_table_bytes(meta: RasterMeta, n_layers: int) -> int:
    """The bound for the long form: ``var, row_id, col_id`` and one value per row."""
    return cell_table_bytes(meta, 1, n_keys=3, rows_per_cell=n_layers)


def join_cells(
    points: DataFrame, cells: DataFrame, size: int, limit: int, keys: list[str] | None = None, salt: int | None = None
) -> DataFrame:
    """Left join points to a cell table of at most ``size`` bytes on the cell keys.

    Up to ``limit`` bytes (a bound from the geometry, not an estimate) the cell
    table is broadcast and the points never move; above it the join shuffles.
    The rows are the same either way.  ``salt`` (default: only for streams)
    spreads each cell's points over so many tasks.
    """
    keys = keys or ["row_id", "col_id"]
    if size <= limit:
        return points.join(F.broadcast(cells), keys, "left")
    return salted_left_join(points, cells, keys, salt or (STREAM_SALT if points.isStreaming else 1))


def sample_long(
    points: DataFrame,
    cells: DataFrame,
    meta: RasterMeta,
    variables: list[int] = CLIMATE_NUMBERS,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
) -> DataFrame:
    """One row per (point, layer): ``var`` name and nearest-cell value (no interpolation).

    The layer list is exploded from a literal array (a generator, not a
    join); the long cell table is then joined on (var, row, col).
    """
    clean = clean_cells(cells, meta, variables)
    pts = with_cell(points, meta).withColumn("var", F.explode(F.array(*[F.lit(v) for v in variables])))
    out = join_cells(pts, clean, long_table_bytes(meta, len(variables)), broadcast_limit, ["var", "row_id", "col_id"])
    return out.withColumn("var", F.concat(F.lit("bio"), F.col("var").cast("string")))


def sample_wide(
    points: DataFrame,
    cells: DataFrame,
    meta: RasterMeta,
    variables: list[int] = CLIMATE_NUMBERS,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    keep_cell: bool = False,
    wide: DataFrame | None = None,
) -> DataFrame:
    """Points with one column per layer: a single left join on (row, col).

    ``wide`` is a stored wide cell table (see ``sinks.write_wide_cells``);
    without it the long cells are pivoted in the job.
    """
    if wide is None:
        wide = widen_cells(cells, meta, variables)
    else:
        wide = wide.select("row_id", "col_id", *[f"bio{v}" for v in variables])
    out = join_cells(with_cell(points, meta), wide, cell_table_bytes(meta, len(variables)), broadcast_limit)
    return out if keep_cell else out.drop("row_id", "col_id")


def sample_wide_dedup(
    points: DataFrame,
    cells: DataFrame,
    meta: RasterMeta,
    variables: list[int] = CLIMATE_NUMBERS,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
) -> DataFrame:
    """Look each distinct cell up once, then join the values back to the points.

    The exact form of a coordinate cache: points sharing a cell share the
    lookup, and the looked-up table is bounded by the raster size, so it is
    broadcast back to the points under the same size check.
    """
    pts = with_cell(points, meta)
    needed = pts.select("row_id", "col_id").dropna().distinct()
    wide = widen_cells(cells, meta, variables)
    looked_up = needed.join(wide, ["row_id", "col_id"], "left")
    return join_cells(pts, looked_up, cell_table_bytes(meta, len(variables)), broadcast_limit).drop("row_id", "col_id")


def sample_wide_cached(
    points: DataFrame,
    cells: DataFrame,
    meta: RasterMeta,
    variables: list[int] = CLIMATE_NUMBERS,
    arrival: str = "key",
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    salt: int = STREAM_SALT,
    wide: DataFrame | None = None,
) -> DataFrame:
    """``sample_wide`` behind a cache on coordinates rounded to 3 decimals: of all points with one key the first to
    arrive is looked up, and all get its values, also where they lie in the next cell.

    ``sample_wide_dedup`` is the exact form; this one is for results that must equal those of a client with such a
    cache.  The first arrival is a ``min_by`` per key, combined before the shuffle; ``salt`` spreads a key
    that very many points share when the values go back.  A point without a coordinate has no key and no values.
    """
    keyed = points.withColumn("_cached", coordinate_key("latitude", "longitude"))
    first = keyed.filter(F.col("_cached").isNotNull()).groupBy("_cached")
    first = first.agg(F.min_by(F.struct("latitude", "longitude"), F.struct(arrival, "latitude", "longitude")).alias("_p"))
    asked = first.select("_cached", "_p.latitude", "_p.longitude")
    found = sample_wide(asked, cells, meta, variables, broadcast_limit, wide=wide).drop("latitude", "longitude")
    return salted_left_join(keyed, found, ["_cached"], salt).select(*points.columns, *[f"bio{v}" for v in variables])


def lookup_elevation(
    points: DataFrame,
    elev: DataFrame,
    meta: RasterMeta,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
) -> DataFrame:
    """Points with ``elevation`` of their cell and a ``status`` column:
    ``Invalid coordinates`` outside +-90/+-180 or without a number,
    ``missing_result`` when no cell answers, else ``ok``.  ``meta`` is the
    elevation raster's own geometry."""
    cells = elev.select("row_id", "col_id", "elevation").withColumn("_hit", F.lit(True))
    pts = with_cell(points, meta)
    error = coordinate_status()
    out = join_cells(pts, cells, cell_table_bytes(meta, 2), broadcast_limit)
    status = F.coalesce(error, F.when(F.col("_hit").isNull(), F.lit("missing_result")).otherwise(F.lit("ok")))
    keep = [c for c in out.columns if c not in ("_hit", "row_id", "col_id", "elevation")]
    return out.select(*keep, F.when(error.isNull(), F.col("elevation")).alias("elevation"), status.alias("status"))


def layer_check(cells: DataFrame, expected: list[str] = ALL_LAYERS) -> DataFrame:
    """Every expected layer with its cell count and a ``present`` flag.

    ``missing_layers`` (below) is the anti-join form a job fails on.
    """
    spark = cells.sparkSession
    exp = spark.createDataFrame([(name, int(name[3:])) for name in expected], "layer string, var int")
    counts = cells.groupBy("var").agg(F.count(F.lit(1)).alias("n_cells"))
    out = exp.join(counts, "var", "left")
    return out.select(
        "layer",
        F.coalesce(F.col("n_cells"), F.lit(0).cast("long")).alias("n_cells"),
        F.col("n_cells").isNotNull().alias("present"),
    )


def layer_coverage(
    points: DataFrame,
    cells: DataFrame,
    meta: RasterMeta,
    expected: list[str] = ALL_LAYERS,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
) -> DataFrame:
    """``layer_check`` plus, per layer, how many points fall in a cell with a value.

    Points are first counted per cell (map-side partial counts, at most one
    row per raster cell), so the layer totals never move the points
    themselves; a missing layer shows 0 covered points.
    """
    per_cell = with_cell(points, meta).dropna(subset=["row_id", "col_id"]).groupBy("row_id", "col_id").agg(
        F.count(F.lit(1)).alias("_pts")
    )
    valued = cells.select("var", "row_id", "col_id", clean_value(F.col("value"), F.col("var"), meta.nodata).alias("value"))
    valued = valued.filter(F.col("value").isNotNull()).select("var", "row_id", "col_id")
    n_layers = len(expected)
    # the valued cells are unique per (var, row, col); one point-count row per cell meets them
    if long_table_bytes(meta, n_layers) <= broadcast_limit:
        valued = F.broadcast(valued)
    hit = per_cell.join(valued, ["row_id", "col_id"], "inner")
    covered = hit.groupBy("var").agg(F.sum("_pts").alias("points_with_value"))
    check = layer_check(cells, expected)
    spark = cells.sparkSession
    names = spark.createDataFrame([(name, int(name[3:])) for name in expected], "layer string, var int")
    cov = names.join(covered, "var", "left").select(
        "layer", F.coalesce(F.col("points_with_value"), F.lit(0).cast("long")).alias("points_with_value")
    )
    return check.join(cov, "layer", "inner")


def missing_layers(cells: DataFrame, expected: list[str] = ALL_LAYERS) -> DataFrame:
    spark = cells.sparkSession
    exp = spark.createDataFrame([(name, int(name[3:])) for name in expected], "layer string, var int")
    return exp.join(cells.select("var").distinct(), "var", "left_anti").select("layer")


def layer_names(variables: list[int]) -> list[str]:
    return [f"bio{v}" for v in variables]


def known_layers(cells: DataFrame) -> set[int] | None:
    """The layers of a cell table as far as they are known without reading it: from its source (``layers``), or
    from the folders of a table that is stored by layer."""
    named = getattr(cells, "layers", None)
    if named is not None:
        return set(named)
    folders = [re.search(r"/var=(\d+)/", f) for f in cells.inputFiles()]
    return {int(m[1]) for m in folders} if folders and all(folders) else None


def require_layers(cells: DataFrame, expected: list[str] = ALL_LAYERS) -> None:
    """Fail early when a layer is missing (instead of silently empty output).

    No job runs where the layers are known; only a table that is neither read from raster files nor
    stored by layer is scanned, and at most one row per layer is read back.
    """
    known = known_layers(cells)
    if known is None:
        missing = [r["layer"] for r in missing_layers(cells, expected).collect()]
    else:
        missing = [name for name in expected if int(name[3:]) not in known]
    if missing:
        raise FileNotFoundError(f"raster layers missing: {', '.join(sorted(missing))}")
