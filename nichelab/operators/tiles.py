"""Packed raster tiles: a fine raster as one row per square of cells.

A raster of half a minute has 933 million cells; as a row each, every sampling
job would shuffle them.  Packed, a row is a tile of ``TILE`` x ``TILE`` cells with one
array per layer, in row order, and a point needs its tile's row and an offset:
points and tiles meet in one join on the tile, and the value is picked from the
array in the same projection, so no cell is ever a row.  A layer that is not asked
for is not read.

Building the table is one exchange by tile; every later step (strips of a tile's
rows, then the tile) groups within that partitioning, so a group holds at most a
tile's cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelab.operators.filters import coordinate_status
from nichelab.operators.raster import DEFAULT_BROADCAST_LIMIT, cell_index, clean_value, join_cells
from nichelab.schemas import CLIMATE_NUMBERS
from nichelab.sources.tables import RasterMeta

TILE = 128
TILE_KEYS = ["tile_row", "tile_col"]


def tile_count(meta: RasterMeta, tile: int = TILE) -> int:
    return -(-meta.n_rows // tile) * -(-meta.n_cols // tile)


def tile_table_bytes(meta: RasterMeta, n_layers: int, tile: int = TILE, value_bytes: int = 8) -> int:
    """Upper bound of a tile table's size as a hash relation, from the raster geometry alone."""
    return tile_count(meta, tile) * (96 + n_layers * (32 + tile * tile * value_bytes + tile * tile // 8))


def with_tile(points: DataFrame, meta: RasterMeta, tile: int = TILE, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Adds the point's tile and its cell's ``tile_offset`` there; null outside the raster."""
    row, col = cell_index(meta, lat, lon)
    at = points.withColumns({"_row": row, "_col": col})
    return at.withColumns(
        {
            "tile_row": F.floor(F.col("_row") / tile).cast("int"),
            "tile_col": F.floor(F.col("_col") / tile).cast("int"),
            "tile_offset": ((F.col("_row") % tile) * tile + F.col("_col") % tile).cast("int"),
        }
    ).drop("_row", "_col")


def pack_cells(cells: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """One row per tile that has a cell: ``tile_row``, ``tile_col`` and an array of ``tile * tile`` values per column.

    ``cells``: ``row_id``, ``col_id`` and the value columns, raw; of a cell that is there twice the
    largest value counts, as in the wide cell table.  Cells that are not there are null.
    """
    at = cells.select(
        F.floor(F.col("row_id") / tile).cast("int").alias("tile_row"),
        F.floor(F.col("col_id") / tile).cast("int").alias("tile_col"),
        (F.col("row_id") % tile).cast("int").alias("r"),
        (F.col("col_id") % tile).cast("int").alias("c"),
        *columns,
    )
    at = at.repartition(*TILE_KEYS)  # the one exchange: what follows groups by more than the tile
    one = at.groupBy(*TILE_KEYS, "r", "c").agg(*[F.max(v).alias(v) for v in columns])
    places = F.sequence(F.lit(0), F.lit(tile - 1))
    strips = one.groupBy(*TILE_KEYS, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct(*columns)))).alias("m"))
    strips = strips.select(*TILE_KEYS, "r", F.transform(places, lambda c: F.element_at("m", c)).alias("strip"))
    whole = strips.groupBy(*TILE_KEYS).agg(F.map_from_entries(F.collect_list(F.struct("r", "strip"))).alias("m"))
    nothing = F.array_repeat(F.lit(None).cast(strips.schema["strip"].dataType.elementType), tile)
    flat = whole.select(*TILE_KEYS, F.flatten(F.transform(places, lambda r: F.coalesce(F.element_at("m", r), nothing))).alias("v"))
    return flat.select(*TILE_KEYS, *[F.col(f"v.{v}").alias(v) for v in columns])


def pack_layers(cells: DataFrame, variables: list[int] = CLIMATE_NUMBERS, tile: int = TILE) -> DataFrame:
    """Tiles ``(tile_row, tile_col, bioN...)`` of the long cell table ``(var, row_id, col_id, value)``; values stay raw."""
    names = [f"bio{v}" for v in variables]
    wide = cells.filter(F.col("var").isin(variables)).select(
        "row_id", "col_id", *[F.when(F.col("var") == v, F.col("value")).alias(n) for v, n in zip(variables, names, strict=True)]
    )
    return pack_cells(wide, names, tile)


def _layer_value(var: int, raw: Column, meta: RasterMeta) -> Column:
    nodata = dict(meta.layer_nodata or ()).get(var, meta.nodata)
    return clean_value(raw, F.lit(var), nodata)


def sample_tiles(
    points: DataFrame,
    tiles: DataFrame,
    meta: RasterMeta,
    variables: list[int] = CLIMATE_NUMBERS,
    tile: int = TILE,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
) -> DataFrame:
    """Points with one clean column ``bioN`` per layer, as ``raster.sample_wide`` gives them, from packed tiles.

    The tile table is broadcast when its size bound, from the geometry, allows;
    beyond that one join shuffles points and tiles by tile, and a tile with very
    many points is split at run time.
    """
    names = [f"bio{v}" for v in variables]
    at = with_tile(points, meta, tile)
    out = join_cells(at, tiles.select(*TILE_KEYS, *names), tile_table_bytes(meta, len(names), tile), broadcast_limit, TILE_KEYS)
    picked = [_layer_value(v, F.get(F.col(n), F.col("tile_offset")), meta).alias(n) for v, n in zip(variables, names, strict=True)]
    return out.select(*points.columns, *picked)


def lookup_elevation_tiles(
    points: DataFrame, tiles: DataFrame, meta: RasterMeta, tile: int = TILE, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT
) -> DataFrame:
    """``raster.lookup_elevation`` on tiles with a column ``elevation`` (packed by ``pack_cells``): elevation and status."""
    at = with_tile(points, meta, tile)
    packed = tiles.select(*TILE_KEYS, F.col("elevation").alias("_packed"))
    out = join_cells(at, packed, tile_table_bytes(meta, 1, tile), broadcast_limit, TILE_KEYS)
    error, found = coordinate_status(), F.get("_packed", F.col("tile_offset")).cast("double")
    status = F.coalesce(error, F.when(found.isNull(), "missing_result").otherwise("ok"))
    return out.select(*points.columns, F.when(error.isNull(), found).alias("elevation"), status.alias("status"))
