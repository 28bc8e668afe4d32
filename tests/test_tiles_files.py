"""Packed tiles, raster files, page sequences, folds, caches and replies by coordinate."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from nichelab.operators import grid, raster, sampling, tiles
from nichelab.sources import rasterfile, readers, tables
from nichelab.sources.tables import FIXTURE_RASTER as META
from nichelab.sources.tables import RasterMeta

from conftest import SF001


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def _scatter(spark, n=4000):
    rng = random.Random(1)
    rows = [(k, rng.uniform(-95, 95), rng.uniform(-190, 190)) for k in range(n)]
    rows += [(n, None, 1.0), (n + 1, float("nan"), 1.0), (n + 2, 90.0, -180.0), (n + 3, -90.0, 180.0), (n + 4, -89.999999, 179.999999)]
    return spark.createDataFrame(rows, "key long, latitude double, longitude double")


@pytest.mark.parametrize("size,limit", [(7, 0), (16, 0), (128, 1 << 40)])
def test_tiles_give_what_the_wide_cells_give(spark, size, limit):
    """Also tiles that stick out of the raster, points outside, and both joins."""
    cells, pts = tables.raster_cells(spark), _scatter(spark)
    packed = tiles.pack_layers(cells, tile=size)
    assert packed.count() == tiles.tile_count(META, size)
    got = tiles.sample_tiles(pts, packed, META, tile=size, broadcast_limit=limit)
    want = raster.sample_wide(pts, cells, META)
    assert got.columns == want.columns and _rows(got) == _rows(want)


def test_tiles_of_sparse_cells_elevation_and_doubles(spark):
    cells, pts = tables.elevation_cells(spark), _scatter(spark)
    packed = tiles.pack_cells(cells.unionByName(cells.withColumn("elevation", F.col("elevation") - 1)), ["elevation"], 10)
    got = tiles.lookup_elevation_tiles(pts, packed, META, 10)
    assert _rows(got) == _rows(raster.lookup_elevation(pts, cells, META).select(*got.columns))
    assert tiles.pack_cells(cells.limit(0), ["elevation"], 10).count() == 0


def test_half_minute_raster_is_few_rows_and_one_join(spark):
    """A tile row stands for more than a thousand cells, and points meet tiles in one shuffle each."""
    meta = tables.FINE_RASTER
    assert meta.n_cells == 933_120_000 and tiles.tile_count(meta) < meta.n_cells / 1000
    n = tables.FINE_WINDOW[2]
    packed = tiles.pack_layers(tables.fine_cells(spark, SF001), [1, 12])
    assert packed.count() <= (n // tiles.TILE + 1) ** 2 < n * n / 1000
    stored = spark.range(9).select(F.col("id").cast("int").alias("tile_row"), F.col("id").cast("int").alias("tile_col"), F.array(F.lit(1.0)).alias("bio1"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tiles were as large as they are
    try:
        plan = tiles.sample_tiles(tables.fine_points(spark, SF001), stored, meta, [1])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(tile_row") == 2 and plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 2


def _write(folder, var, values, meta, **how):
    rasterfile.write_layer(f"{folder}/wc_bio_{var}.tif", values, meta, **how)


def _grid(meta, var):
    a, b = np.meshgrid(np.arange(meta.n_rows), np.arange(meta.n_cols), indexing="ij")
    return (a * 31 + b * 17 + var * 101) % 500


SMALL = RasterMeta(10.0, 50.0, 0.25, 37, 23, -9999.0)


@pytest.mark.parametrize("kind", ["<f4", ">f4", "<f8", ">i2", "<u1", "<i4"])
@pytest.mark.parametrize("deflated", [True, False])
def test_file_read_back_equals_its_cells(spark, tmp_dir, kind, deflated):
    values = (_grid(SMALL, 3) % 120).astype(kind)
    _write(tmp_dir, 3, values, SMALL, rows_per_strip=5, deflated=deflated, order=kind[0])
    cells = rasterfile.read_raster_files(spark, tmp_dir)
    got = np.full(values.shape, -1.0)
    rows = cells.collect()
    for r in rows:
        got[r["row_id"], r["col_id"]] = r["value"]
    assert len(rows) == SMALL.n_cells and {r["var"] for r in rows} == {3} and (got == values).all()
    assert rasterfile.raster_files_meta(tmp_dir) == SMALL


def test_some_layers_open_only_their_files(spark, tmp_dir, monkeypatch):
    for var in (1, 4, 12):
        _write(tmp_dir, var, _grid(SMALL, var).astype("f4"), SMALL)
    with open(f"{tmp_dir}/wc_bio_5.tif", "wb") as f:
        f.write(b"broken")
    opened = []
    read = rasterfile.read_layer
    monkeypatch.setattr(rasterfile, "read_layer", lambda p: opened.append(p) or read(p))
    reader = rasterfile.FilteringReader({"path": tmp_dir})
    assert list(reader.pushFilters([In(("var",), (1, 12)), GreaterThan(("row_id",), 3)])) == [GreaterThan(("row_id",), 3)]
    assert {p.layer.var for p in reader.partitions()} == {1, 12} and len(opened) == 2
    assert list(reader.pushFilters([EqualTo(("var",), 1)])) == [] and {p.layer.var for p in reader.partitions()} == {1}
    assert rasterfile.read_raster_files(spark, tmp_dir, [1, 12]).groupBy("var").count().count() == 2
    spark.conf.set(rasterfile.PUSHDOWN, "true")
    try:
        assert rasterfile.read_raster_files(spark, tmp_dir).filter("var IN (1, 4) AND row_id < 3").count() == 2 * 3 * SMALL.n_cols
    finally:
        spark.conf.unset(rasterfile.PUSHDOWN)
    with pytest.raises(FileNotFoundError, match="bio7"):
        rasterfile.read_raster_files(spark, tmp_dir, [1, 7])
    with pytest.raises(Exception, match="not a TIFF"):
        rasterfile.read_raster_files(spark, tmp_dir).count()


def test_strips_are_spread_and_other_files_refused(spark, tmp_dir, monkeypatch):
    _write(tmp_dir, 1, _grid(SMALL, 1).astype("f4"), SMALL, rows_per_strip=4)
    monkeypatch.setattr(rasterfile, "PARTITION_BYTES", 4 * 23 * 4 * 2)
    parts = rasterfile.RasterReader({"path": tmp_dir}).partitions()
    assert [(p.first, p.last) for p in parts] == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]
    raw = bytearray(rasterfile.encode_layer(_grid(SMALL, 1).astype("f4"), SMALL))
    at = raw.index(struct.pack("<HHI", rasterfile.COMPRESSION, 3, 1))
    raw[at + 8 : at + 10] = struct.pack("<H", 5)
    with open(f"{tmp_dir}/x_2.tif", "wb") as f:
        f.write(bytes(raw))
    with pytest.raises(ValueError, match="compression 5"):
        rasterfile.read_layer(f"{tmp_dir}/x_2.tif")


def test_files_serve_the_sampling(spark, tmp_dir):
    """A raster in files gives the points the values that its cell table gives."""
    cells = tables.raster_cells(spark).toPandas()
    for var, layer in cells.groupby("var"):
        values = np.zeros((META.n_rows, META.n_cols), np.float32)
        values[layer["row_id"], layer["col_id"]] = layer["value"]
        _write(tmp_dir, var, values, META, rows_per_strip=7)
    pts = _scatter(spark, 500)
    got = raster.sample_wide(pts, rasterfile.read_raster_files(spark, tmp_dir), rasterfile.raster_files_meta(tmp_dir))
    assert _rows(got) == _rows(raster.sample_wide(pts, tables.raster_cells(spark), META))


def _client(pages, size, total, limit=None):
    """A client's loop over the pages, by offset."""
    total, out, offset = min(total, limit or total), [], 0
    while offset < total:
        want = min(size, total - offset)
        page = pages.get(offset)
        if page is None:
            break
        out += [(offset, k, v) for k, v in enumerate(page[:want])]
        offset += size
        if len(page[:want]) < want:
            break
    return out


@pytest.mark.parametrize("limit", [None, 7, 23])
def test_page_sequence_reads_what_a_client_reads(spark, limit):
    rng = random.Random(limit)
    rows, want = [], []
    for series in range(40):
        n = rng.randrange(0, 40)
        pages = {k: list(range(k, min(k + 5, n))) for k in range(0, n, 5)}
        for k in list(pages):
            how = rng.random()
            if how < 0.08:
                del pages[k]
            elif how < 0.16:
                pages[k] = None
            elif how < 0.24:
                pages[k] = pages[k][:-2]
        rows += [(series, k, n, None if p is None else {"results": [{"v": v} for v in p]}) for k, p in pages.items()]
        want += [(series, *r) for r in _client(pages, 5, n, limit)]
    df = spark.createDataFrame(rows, "series int, offset long, total long, page struct<results: array<struct<v: int>>>")
    assert _rows(readers.read_page_sequence(df, 5, ["series"], limit=limit)) == sorted(map(repr, want))


def test_first_missing_page_over_many_ranges(spark):
    """Numbers over several ranges, with gaps in a range, between ranges, at the start, and none."""
    cases = {0: (set(range(100)), 100), 1: (set(range(100)) - {37, 60}, 37), 2: (set(range(32)) | set(range(48, 90)), 32), 3: (set(range(16, 50)), 0), 4: ({3, 5}, 0)}
    rows = [(g, i, True) for g, (held, _) in cases.items() for i in held] + [(5, 0, False), (0, 7, True)]
    out = readers.full_prefix(spark.createDataFrame(rows, "g int, i long, ok boolean"), ["g"], "i", "ok", span=16)
    assert {r["g"]: r["stop"] for r in out.collect()} == {g: stop for g, (_, stop) in cases.items()} | {5: 0}


def test_page_files(spark, tmp_dir):
    rec = lambda k: {"key": k, "taxonKey": 100, "decimalLatitude": 1.5}
    for offset in (0, 3, 6, 9, 12):
        with open(f"{tmp_dir}/p{offset}.json", "w") as f:
            f.write("no json {" if offset == 9 else json.dumps({"offset": offset, "count": 15, "results": [rec(offset + k) for k in range(3)]}))
    got = readers.read_occurrence_page_files(spark, tmp_dir, 3).select("key").collect()
    assert sorted(r["key"] for r in got) == list(range(9))


def test_stratified_folds_are_equal_in_every_class(spark):
    rows = [(k, 1 if k % 5 else 0) for k in range(1000)] + [(None, 1)] * 4 + [(7, 1)] * 3 + [(k, None) for k in range(10)]
    df = spark.createDataFrame(rows, "key long, presence int")
    for k in (3, 7):
        out = sampling.stratified_folds(df, k).groupBy("presence", "fold").count().collect()
        for label in (0, 1, None):
            counts = [r["count"] for r in out if r["presence"] == label]
            assert len(counts) == k and max(counts) - min(counts) <= 1 and sum(counts) == sum(r[1] == label for r in rows)


def test_cache_gives_the_first_arrivals_values(spark):
    """Points on both sides of a cell border share a rounded key: the cache and the exact form differ, as they should."""
    cells = tables.raster_cells(spark)
    rows = [(1, 44.9999, 10.0), (2, 45.0001, 10.0), (3, 45.00049, 10.0), (0, 20.0001, 3.0), (5, 19.9999, 3.0), (6, None, 1.0), (7, 45.0001, 10.0)]
    pts = spark.createDataFrame(rows, "key long, latitude double, longitude double")
    exact = {r["key"]: r["bio1"] for r in raster.sample_wide(pts, cells, META).collect()}
    cached = {r["key"]: r["bio1"] for r in raster.sample_wide_cached(pts, cells, META).collect()}
    assert exact[1] != exact[2] and exact[0] != exact[5] and exact[2] == exact[7]
    assert cached == {1: exact[1], 2: exact[1], 3: exact[1], 7: exact[1], 0: exact[0], 5: exact[0], 6: None}


def test_replies_by_coordinate_last_write_wins(spark):
    nan = float("nan")
    points = spark.createDataFrame([(1, 0.0, 5.0), (2, -0.0, 5.0), (3, 1.0, 1.0), (4, nan, 1.0), (5, None, 1.0), (6, 9.0, 9.0)], "idx long, latitude double, longitude double")
    replies = [(1, -0.0, 5.0, 10.0, 1.0), (2, 0.0, 5.0, 20.0, None), (3, 0.0, 5.0, None, 3.0), (4, 1.0, 1.0, None, None), (5, nan, 1.0, 7.0, 7.0), (6, None, 1.0, 8.0, 8.0), (7, 2.0, 2.0, 9.0, 9.0)]
    df = spark.createDataFrame(replies, "arrival long, latitude double, longitude double, elevation double, bio1 double")
    out = {r["idx"]: (r["elevation"], r["bio1"], r["matched"]) for r in grid.attach_replies(points, df, ["elevation", "bio1"]).collect()}
    nothing = (None, None, False)
    assert out == {1: nothing, 2: (20.0, 3.0, True), 3: (None, None, True), 4: nothing, 5: nothing, 6: nothing}
