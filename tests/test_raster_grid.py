"""Cell edges, value cleaning, grid geometry, classes and hotspots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichelab.functions import bins
from nichelab.operators import grid, raster
from nichelab.schemas import RISK_CATEGORIES, RISK_COLOR_BINS, RISK_COLOR_FLOOR
from nichelab.sources import tables
from nichelab.sources.tables import FIXTURE_RASTER as META


def test_cell_edges(spark):
    pts = spark.createDataFrame(
        [(1, 90.0, -180.0), (2, -90.0, 0.0), (3, 0.0, 180.0), (4, 89.999, 179.999), (5, -89.999, 0.0)],
        "key long, latitude double, longitude double",
    )
    got = {r["key"]: (r["row_id"], r["col_id"]) for r in raster.with_cell(pts, META).collect()}
    assert got[1] == (0, 0)
    assert got[2] == (None, None)  # bottom edge is outside (half-open cells)
    assert got[3] == (None, None)  # east edge is outside
    assert got[4] == (0, 71)
    assert got[5] == (35, 36)


def test_clean_values_float32_scaling(spark):
    vals = [(1, 123.0), (4, 7.0), (12, 800.0), (5, -9999.0), (6, float("nan")), (13, float("inf"))]
    df = spark.createDataFrame([(v, 0, 0, x) for v, x in vals], "var int, row_id int, col_id int, value float")
    got = {r["var"]: r["value"] for r in raster.clean_cells(df, META, [1, 4, 5, 6, 12, 13]).collect()}
    assert got[1] == float(np.float32(123.0) / np.float32(10.0))
    assert got[4] == float(np.float32(7.0) / np.float32(10.0))
    assert got[12] == 800.0
    assert got[5] is None and got[6] is None and got[13] is None


def test_dedup_equals_direct(spark):
    pts = spark.createDataFrame([(k, (k % 7) * 1.0, (k % 5) * 2.0) for k in range(200)], "key long, latitude double, longitude double")
    cells = tables.raster_cells(spark)
    a = sorted(map(tuple, raster.sample_wide(pts, cells, META).collect()))
    b = sorted(map(tuple, raster.sample_wide_dedup(pts, cells, META).collect()))
    assert a == b


def test_layer_check_reports_missing(spark):
    rows = {r["layer"]: r for r in raster.layer_check(tables.raster_cells(spark)).collect()}
    assert len(rows) == 19 and rows["bio1"]["present"] and not rows["bio2"]["present"]
    with pytest.raises(FileNotFoundError):
        raster.require_layers(tables.raster_cells(spark))


@pytest.mark.parametrize("n", [5, 8, 13])
def test_grid_matches_meshgrid(spark, n):
    b = (-34.2, -33.8, 18.2, 19.0)
    lats, lons = np.linspace(b[0], b[1], n), np.linspace(b[2], b[3], n)
    lat_grid, lon_grid = np.meshgrid(lats, lons)
    got = grid.grid_points(spark, b, n, 3).orderBy("idx").collect()
    ext = spark.createDataFrame([b], "lat_min double, lat_max double, lon_min double, lon_max double")
    lazy = grid.grid_points(spark, ext, n, 3).orderBy("idx").collect()
    assert [tuple(r) for r in lazy] == [tuple(r) for r in got]
    assert [r["idx"] for r in got] == list(range(n * n))
    assert [r["latitude"] for r in got] == lat_grid.flatten().tolist()
    assert [r["longitude"] for r in got] == lon_grid.flatten().tolist()


def test_grid_cells_corners(spark):
    n, b = 6, (-34.5, -32.0, 18.0, 21.0)
    lats, lons = np.linspace(b[0], b[1], n), np.linspace(b[2], b[3], n)
    lat_grid, lon_grid = np.meshgrid(lats, lons)
    scored = grid.grid_points(spark, b, n, 1).withColumn("risk", F.col("idx") / 100.0)
    cells = {(r["i"], r["j"]): r for r in grid.grid_cells(scored, n).collect()}
    assert len(cells) == (n - 1) ** 2
    for (i, j), r in cells.items():
        ring = [[lon_grid[i, j], lat_grid[i, j]], [lon_grid[i, j + 1], lat_grid[i, j + 1]],
                [lon_grid[i + 1, j + 1], lat_grid[i + 1, j + 1]], [lon_grid[i + 1, j], lat_grid[i + 1, j]]]
        assert [list(p) for p in r["ring"]] == ring + [ring[0]]
        assert r["risk"] == (i * n + j) / 100.0


def _py_color(r):
    for b, c in RISK_COLOR_BINS:
        if r >= b:
            return c
    return RISK_COLOR_FLOOR


def _py_category(r):
    for b, label, _ in RISK_CATEGORIES:
        if b is None or r >= b:
            return label


def test_classes_match_plain_python(spark):
    vals = sorted({i / 1000 for i in range(1001)} | {b for b, _ in RISK_COLOR_BINS})
    df = spark.createDataFrame([(v,) for v in vals], "risk double")
    for r in df.select("risk", bins.risk_color("risk").alias("c"), bins.risk_category("risk").alias("k")).collect():
        assert r["c"] == _py_color(r["risk"]) and r["k"] == _py_category(r["risk"])


def test_hotspots_order_and_labels(spark):
    rows = [(0, 0.0, 0.0, 0.95), (1, 0.0, 0.0, 0.95), (2, 0.0, 0.0, 0.85), (3, 0.0, 0.0, 0.5), (4, 0.0, 0.0, 0.99), (5, 0.0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "idx long, latitude double, longitude double, risk double")
    got = [(r["rank"], r["idx"], r["icon_color"], r["level"]) for r in grid.hotspots(df).collect()]
    assert got == [(1, 4, "darkred", "CRITICAL"), (2, 1, "darkred", "CRITICAL"), (3, 0, "darkred", "CRITICAL"),
                   (4, 2, "red", "VERY HIGH"), (5, 3, "orange", "HIGH")]


def test_region_bounds():
    assert grid.region_bounds("western_cape") == (-34.2, -33.8, 18.2, 19.0)
    assert grid.region_bounds("anything else") == (-34.2, -33.8, 18.2, 19.0)
    assert grid.region_bounds("custom", -1, 1, 2, 3) == (-1.0, 1.0, 2.0, 3.0)
    with pytest.raises(ValueError):
        grid.region_bounds("custom", 1, -1, 2, 3)
    with pytest.raises(ValueError):
        grid.check_grid_params(4, 1)
    with pytest.raises(ValueError):
        grid.check_grid_params(10, 13)


def test_distribution_tiers_sum(spark):
    df = spark.createDataFrame([(i / 97,) for i in range(98)], "risk double")
    d = grid.risk_distribution(df).first()
    assert d["very_low"] + d["low"] + d["moderate"] + d["high"] + d["very_high"] == d["total_points"]
    s = grid.risk_summary(df, 3).first()
    assert s["high_risk_points"] + s["medium_risk_points"] + s["low_risk_points"] == 98 and s["month_name"] == "March"


HOT_POINTS = [(k, 10.1 if k % 5 < 2 else (k % 170) - 85.0, 20.2 if k % 5 < 2 else (k % 350) - 175.0) for k in range(3000)]


def test_shuffled_join_equals_broadcast(spark):
    """The same rows on both sides of the size limit, and no job while the plan is built."""
    odd = [(5000, None, 1.0), (5001, float("nan"), 1.0), (5002, 91.0, 1.0), (5003, 1.0, None)]
    pts = spark.createDataFrame(HOT_POINTS + odd, "key long, latitude double, longitude double")
    cells, elev = tables.raster_cells(spark), tables.elevation_cells(spark)
    spark.sparkContext.setJobGroup("build", "plan only")
    split = raster.sample_wide(pts, cells, META, broadcast_limit=0)
    a = raster.lookup_elevation(pts, elev, META, broadcast_limit=0)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("build") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    same = lambda x, y: sorted(map(repr, map(tuple, x.collect()))) == sorted(map(repr, map(tuple, y.collect())))
    assert same(split, raster.sample_wide(pts, cells, META))
    assert same(a, raster.lookup_elevation(pts, elev, META))
    size = raster.cell_table_bytes(META, 8)
    keyed = raster.with_cell(pts, META)
    salted = raster.join_cells(keyed, raster.widen_cells(cells, META), size, 0, salt=4)
    assert same(salted, raster.join_cells(keyed, raster.widen_cells(cells, META), size, size))


def test_coordinates_without_a_number(spark):
    nan = float("nan")
    pts = spark.createDataFrame([(1, nan, 5.0), (2, 5.0, nan), (3, None, 5.0), (4, 5.0, 5.0)], "key long, latitude double, longitude double")
    wide = {r["key"]: r for r in raster.sample_wide(pts, tables.raster_cells(spark), META).collect()}
    assert all(wide[k]["bio1"] is None and wide[k]["bio12"] is None for k in (1, 2, 3))
    elev = {r["key"]: r for r in raster.lookup_elevation(pts, tables.elevation_cells(spark), META).collect()}
    assert [elev[k]["status"] for k in (1, 2, 3)] == ["Invalid coordinates"] * 3
    assert all(elev[k]["elevation"] is None for k in (1, 2, 3))


def test_size_bound_counts_long_rows():
    """At 10 minutes, eight layers: the long table is far beyond the limit, whatever the wide one is."""
    fine = tables.RasterMeta(-180.0, 90.0, 1 / 6, 1080, 2160, None)
    assert raster.long_table_bytes(fine, 8) > 1080 * 2160 * 8 * 100
    assert raster.long_table_bytes(fine, 8) > raster.DEFAULT_BROADCAST_LIMIT


def test_percentages_tie_to_even(spark):
    """49 of 400 points print as 12.2; both forms of the median leave NaN out."""
    rows = [(0.95 if k < 49 else 0.1,) for k in range(400)]
    assert grid.risk_distribution(spark.createDataFrame(rows, "risk double")).first()["very_high_pct"] == 12.2
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (float("nan"),), (None,)], "risk double")
    a, b = grid.risk_stats(df, max_rows=5).first(), grid.risk_stats(df).first()
    assert a == b and a["median"] == 0.2 and a["max"] == 0.3 and a["mean"] == 0.2


def test_shuffled_long_join_equals_broadcast(spark):
    rows = [(k, 10.1 if k % 3 == 0 else (k % 170) - 85.0, 20.2 if k % 3 == 0 else (k % 350) - 175.0) for k in range(2000)]
    pts = spark.createDataFrame(rows, "key long, latitude double, longitude double")
    cells = tables.raster_cells(spark)
    split = raster.sample_long(pts, cells, META, broadcast_limit=0)
    direct = raster.sample_long(pts, cells, META)
    cols = ["key", "var", "value"]
    assert sorted(map(tuple, split.select(cols).collect())) == sorted(map(tuple, direct.select(cols).collect()))
    assert split.count() == 2000 * 8
