"""Prediction grid and risk analytics: generation, enrichment, scores, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichelab.functions import bins, formats, temporal
from nichelab.functions.numeric import half_even, round6
from nichelab.operators import raster
from nichelab.operators.windows import exact_median
from nichelab.schemas import CLIMATE_VARIABLES, DEFAULT_REGION, GRID_FILL_VALUES, HOTSPOT_COUNT, REGIONS, RISK_HIGH, RISK_MEDIUM
from nichelab.sources.tables import RasterMeta

# lat_min, lat_max, lon_min, lon_max: numbers, or columns (scalar subqueries over data)
Bounds = tuple[float | Column, float | Column, float | Column, float | Column]


def region_bounds(
    region: str,
    lat_min: float | None = None,
    lat_max: float | None = None,
    lon_min: float | None = None,
    lon_max: float | None = None,
) -> Bounds:
    """Named region or checked custom bounds; an unknown name falls back to the default region."""
    if region == "custom":
        if any(v is None for v in (lat_min, lat_max, lon_min, lon_max)):
            raise ValueError("custom region requires lat_min, lat_max, lon_min, lon_max")
        if lat_min >= lat_max or lon_min >= lon_max:
            raise ValueError("invalid coordinate bounds")
        return float(lat_min), float(lat_max), float(lon_min), float(lon_max)
    return REGIONS.get(region, REGIONS[DEFAULT_REGION])


def check_grid_params(n: int, month: int, max_n: int | None = None) -> None:
    """n >= 5 (and <= max_n when given), 1 <= month <= 12."""
    if n < 5 or (max_n is not None and n > max_n):
        raise ValueError(f"grid size {n} out of range")
    if not 1 <= month <= 12:
        raise ValueError(f"month {month} out of range")


def data_extent(points: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One-row frame ``(lat_min, lat_max, lon_min, lon_max)`` of the points, kept lazy:
    a grid built on it reads the bounds as one merged scalar subquery."""
    return points.agg(
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max")
    )


def _bound_columns(bounds: Bounds | DataFrame) -> dict[str, Column]:
    names = ["lat_min", "lat_max", "lon_min", "lon_max"]
    if isinstance(bounds, DataFrame):
        return {f"_{c}": bounds.select(c).scalar() for c in names}
    return {f"_{c}": F.lit(float(v)) for c, v in zip(names, bounds)}


def linspace_value(lo: Column, hi: Column, n: int, k: Column) -> Column:
    """k-th of n evenly spaced values from lo to hi (the last is hi exactly)."""
    step = (hi - lo) / F.lit(float(n - 1))
    return F.when(k == F.lit(n - 1), hi).otherwise(k.cast("double") * step + lo)


GRID_COLUMNS = ["idx", "i", "j", "latitude", "longitude", "month"]


def grid_points(spark: SparkSession, bounds: Bounds | DataFrame, n: int, month: int) -> DataFrame:
    """n x n points, ``idx = i * n + j`` with latitude ``lats[j]`` and longitude ``lons[i]``.

    ``bounds`` are numbers or a one-row extent frame; the bounds are projected
    once and every coordinate refers to those columns.  ``lat_next`` /
    ``lon_next`` (``lats[j+1]``, ``lons[i+1]``) carry what a cell polygon
    needs, so cells never look up their neighbours with a join.
    """
    check_grid_params(n, month)
    ids = spark.range(n * n).withColumns(_bound_columns(bounds))
    i = (F.col("id") / n).cast("int")
    j = (F.col("id") % n).cast("int")
    lat0, lat1, lon0, lon1 = (F.col(c) for c in ("_lat_min", "_lat_max", "_lon_min", "_lon_max"))
    return ids.select(
        F.col("id").alias("idx"),
        i.alias("i"),
        j.alias("j"),
        linspace_value(lat0, lat1, n, j).alias("latitude"),
        linspace_value(lon0, lon1, n, i).alias("longitude"),
        F.lit(month).cast("int").alias("month"),
        linspace_value(lat0, lat1, n, j + 1).alias("lat_next"),
        linspace_value(lon0, lon1, n, i + 1).alias("lon_next"),
    )


ENV_COLUMNS = ["elevation", *CLIMATE_VARIABLES]


def enrich_grid(
    grid: DataFrame,
    cells: DataFrame,
    elev: DataFrame,
    meta: RasterMeta,
    elev_meta: RasterMeta | None = None,
    wide: DataFrame | None = None,
) -> DataFrame:
    """Climate and elevation of each grid point (left joins on the point's cell),
    a ``matched`` flag (any value found) and the cyclic month.  A missing layer is an error."""
    if wide is None:
        raster.require_layers(cells, CLIMATE_VARIABLES)
    sampled = raster.sample_wide(grid, cells, meta, wide=wide)
    with_elev = raster.lookup_elevation(sampled, elev, elev_meta or meta).drop("status")
    matched = F.lit(False)
    for c in ENV_COLUMNS:
        matched = matched | F.col(c).isNotNull()
    return with_elev.withColumns(
        {"matched": matched, "sin_month": temporal.sin_month("month"), "cos_month": temporal.cos_month("month")}
    )


def attach_replies(grid: DataFrame, replies: DataFrame, columns: list[str], idx: str = "idx", arrival: str = "arrival") -> DataFrame:
    """Grid rows with ``columns`` from replies that name the same latitude and longitude, exactly.

    Column by column the last reply to arrive with a value counts; a null never overwrites one.  Coordinates are equal as
    numbers (0.0 and -0.0 are, not-a-number is equal to nothing).  Of grid rows that repeat a coordinate the one
    with the largest ``idx`` gets the values, the others none, and a reply without a coordinate goes nowhere.
    The exact join by cell is ``enrich_grid``; this is for replies that carry coordinates only.
    """

    def placed(df: DataFrame) -> DataFrame:
        lat, lon = F.col("latitude"), F.col("longitude")
        known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
        return df.filter(known).withColumns({"_lat": lat + F.lit(0.0), "_lon": lon + F.lit(0.0)})

    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c) for c in columns]
    values = placed(replies).groupBy("_lat", "_lon").agg(*last, F.lit(True).alias("matched"))
    owners = placed(grid).groupBy("_lat", "_lon").agg(F.max(idx).alias(idx))
    filled = owners.join(values, ["_lat", "_lon"]).drop("_lat", "_lon")
    return grid.join(filled, idx, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def null_profile(df: DataFrame, cols: list[str] = ENV_COLUMNS) -> DataFrame:
    """(column, n_missing) per column, from one aggregate."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, n_missing)")


def match_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("matched").alias("points_filled"), F.count(F.lit(1)).alias("points_total"))


def fill_grid(df: DataFrame) -> DataFrame:
    """Missing environment values -> fixed defaults."""
    present = {k: v for k, v in GRID_FILL_VALUES.items() if k in df.columns}
    return df.fillna(present)


def density_score(grid: DataFrame, occurrence_points: DataFrame, meta: RasterMeta) -> DataFrame:
    """Deterministic stand-in for a model score: occurrences in the point's
    raster cell divided by the count of the busiest cell (0 where none).

    The occurrence side is pre-aggregated to one row per cell (map-side
    partial counts) before it meets the grid, so a hot cell costs nothing.
    """
    per_cell = (
        raster.with_cell(occurrence_points, meta)
        .dropna(subset=["row_id", "col_id"])
        .groupBy("row_id", "col_id")
        .agg(F.count(F.lit(1)).alias("n_occ"))
    )
    busiest = per_cell.agg(F.max("n_occ")).scalar()
    g = raster.join_cells(raster.with_cell(grid, meta), per_cell, raster.cell_table_bytes(meta, 1), raster.DEFAULT_BROADCAST_LIMIT)
    risk = F.coalesce(F.col("n_occ"), F.lit(0)).cast("double") / busiest.cast("double")
    return g.withColumn("risk", risk).drop("row_id", "col_id", "n_occ")


def risk_summary(scored: DataFrame, month: int, risk: str = "risk") -> DataFrame:
    """mean, max, min and the three-tier counts (> 0.7, (0.4, 0.7], <= 0.4)."""
    r = F.col(risk)
    return scored.agg(
        F.avg(r).alias("mean_risk"),
        F.max(r).alias("max_risk"),
        F.min(r).alias("min_risk"),
        F.count_if(r > RISK_HIGH).alias("high_risk_points"),
        F.count_if((r > RISK_MEDIUM) & (r <= RISK_HIGH)).alias("medium_risk_points"),
        F.count_if(r <= RISK_MEDIUM).alias("low_risk_points"),
    ).withColumn("month_name", temporal.month_name(F.lit(month)))


def risk_distribution(scored: DataFrame, risk: str = "risk") -> DataFrame:
    """Five bands of 0.2 and the critical band >= 0.9 (also inside >= 0.8),
    each with its share of all points in % at one decimal (ties to even)."""
    r = F.col(risk)
    bands = {
        "very_low": r < 0.2,
        "low": (r >= 0.2) & (r < 0.4),
        "moderate": (r >= 0.4) & (r < 0.6),
        "high": (r >= 0.6) & (r < 0.8),
        "very_high": r >= 0.8,
        "critical": r >= 0.9,
    }
    agg = scored.agg(F.count(F.lit(1)).alias("total_points"), *[F.count_if(c).alias(k) for k, c in bands.items()])
    pct = [half_even(F.col(k) / F.col("total_points") * F.lit(100.0), 1).alias(f"{k}_pct") for k in bands]
    return agg.select("total_points", *bands.keys(), *pct)


# up to this many rows an in-aggregate exact median is cheap and bounded
IN_AGGREGATE_MEDIAN_ROWS = 1_000_000


def risk_stats(scored: DataFrame, risk: str = "risk", max_rows: int | None = None) -> DataFrame:
    """mean, max, min, population std and exact median of the scores that are
    numbers (null and NaN are left out of all five), raw and as % at one decimal
    (ties to even).

    ``max_rows`` is a bound on the input known in advance (a grid has n x n
    points); below ``IN_AGGREGATE_MEDIAN_ROWS`` the median is Spark's exact
    ``median`` in the same aggregate, otherwise the distributed exact median.
    """
    scored = scored.filter(F.col(risk).isNotNull() & ~F.isnan(F.col(risk)))
    r = F.col(risk)
    small = max_rows is not None and max_rows <= IN_AGGREGATE_MEDIAN_ROWS
    aggs = [F.avg(r).alias("mean"), F.max(r).alias("max"), F.min(r).alias("min"), F.stddev_pop(r).alias("std")]
    if small:
        agg = scored.agg(*aggs, F.median(r).alias("median"))
    else:
        agg = scored.agg(*aggs).withColumn("median", exact_median(scored, risk, alias="median").select("median").scalar())
    names = ["mean", "max", "min", "std", "median"]
    return agg.select(
        *[round6(c).alias(c) for c in names],
        *[half_even(F.col(c) * F.lit(100.0), 1).alias(f"{c}_pct") for c in names],
    )


def categorize(scored: DataFrame, risk: str = "risk") -> DataFrame:
    return scored.withColumns(
        {
            "risk_category": bins.risk_category(risk),
            "risk_description": bins.risk_description(risk),
            "risk_color": bins.risk_color(risk),
        }
    )


def hotspots(scored: DataFrame, k: int = HOTSPOT_COUNT, risk: str = "risk", idx: str = "idx") -> DataFrame:
    """Top-k points by risk (ties: higher idx first) with rank, marker colour and level."""
    order = [F.col(risk).desc(), F.col(idx).desc()]
    top = scored.orderBy(*order).limit(k)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        F.col(idx),
        F.col("latitude"),
        F.col("longitude"),
        F.col(risk),
        bins.hotspot_color(risk).alias("icon_color"),
        bins.hotspot_level(risk).alias("level"),
    )


def grid_extent(points: DataFrame) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    agg = points.agg(
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max")
    )
    return agg.withColumn("center_lat", (F.col("lat_min") + F.col("lat_max")) / 2).withColumn(
        "center_lon", (F.col("lon_min") + F.col("lon_max")) / 2
    )


def grid_cells(scored: DataFrame, n: int, risk: str = "risk") -> DataFrame:
    """One polygon per grid cell (i, j), i, j < n - 1, scored by its corner (i, j).

    Corners follow the grid's own geometry: (i, j), (i, j+1), (i+1, j+1),
    (i+1, j) in (lat, lon) = (lats[j], lons[i]); the next latitude and
    longitude travel with each point, so no self-join is needed.
    """
    i, j = F.col("i"), F.col("j")
    lat_j, lat_j1, lon_i, lon_i1 = F.col("latitude"), F.col("lat_next"), F.col("longitude"), F.col("lon_next")
    corners = [(lat_j, lon_i), (lat_j1, lon_i), (lat_j1, lon_i1), (lat_j, lon_i1)]
    cells = scored.filter((i < n - 1) & (j < n - 1))
    out = cells.select(
        "idx",
        "i",
        "j",
        F.col(risk).alias("risk"),
        formats.percent_text(risk).alias("risk_percent"),
        bins.risk_category(risk).alias("risk_category"),
        bins.risk_description(risk).alias("risk_description"),
        lat_j.alias("lat"),
        lon_i.alias("lon"),
        *[c.alias(f"c{k}_lat") for k, (c, _) in enumerate(corners, 1)],
        *[c.alias(f"c{k}_lon") for k, (_, c) in enumerate(corners, 1)],
    )
    ring = formats.polygon_ring([(F.col(f"c{k}_lat"), F.col(f"c{k}_lon")) for k in range(1, 5)])
    return out.withColumn("ring", ring).withColumn("navigation_url", formats.navigation_url("lat", "lon"))
