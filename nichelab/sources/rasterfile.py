"""Raster files as a Spark data source: ``(var, row_id, col_id, value)`` from a folder of TIFF layers.

A layer is a file whose name ends in its number (``..._bio_12.tif``).  The driver reads
the directory of the files it needs, no cells; a task reads whole strips of one
file, each by a seek, so a layer of any size is spread over tasks.  Reading
some layers opens only their files: ``layers`` names them, and where Spark hands
filters down to such sources (``PUSHDOWN``), a filter on ``var`` does.

Read are single-band strip files of integers or floats, either byte order, classic and
big offsets, plain or deflated, north up.  Anything else (tiles, other
compression, predictors, rotation) is an error that names the file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from nichelab.sources.tables import RasterMeta

NAME = "rasterfile"
SCHEMA = "var int, row_id int, col_id int, value float"
LAYER = re.compile(r"(\d+)\.tiff?$", re.IGNORECASE)
#: Uncompressed bytes that one partition reads, about; cells per record batch.
PARTITION_BYTES = 32 << 20
#: Without this setting Spark refuses a reader that takes filters.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
BATCH_CELLS = 1 << 20

# fixed values of the file format: tags, value types (struct letter), compression and sample kinds
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, TRANSFORM, NODATA = 317, 322, 339, 33550, 33922, 34264, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
PLAIN, DEFLATED = 1, (8, 32946)
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Layer:
    """What a file's directory says."""

    path: str
    var: int
    n_rows: int
    n_cols: int
    dtype: str
    deflated: bool
    rows_per_strip: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    left: float
    top: float
    res: float
    nodata: float | None


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


def layer_files(path: str, layers: set[int] | None = None) -> dict[int, str]:
    """File by layer number, of a folder or a single file."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    out: dict[int, str] = {}
    for f in sorted(found, key=lambda f: f.path):
        named = LAYER.search(f.path)
        if f.type == pafs.FileType.File and named and (layers is None or int(named[1]) in layers):
            if int(named[1]) in out:
                raise ValueError(f"two files of layer {named[1]}: {out[int(named[1])]}, {f.path}")
            out[int(named[1])] = prefix + f.path
    return out


def read_layer(path: str) -> Layer:
    """The directory of one file."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        head = f.read(16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError(f"not a TIFF file: {path}")
        order = "<" if head[:2] == b"II" else ">"
        magic = struct.unpack(order + "H", head[2:4])[0]
        if magic not in (42, 43):
            raise ValueError(f"not a TIFF file: {path}")
        big = magic == 43
        (start,) = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])
        f.seek(start)
        count_size, entry_size, value_size = (8, 20, 8) if big else (2, 12, 4)
        (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(count_size))
        entries = f.read(n * entry_size)
        tags: dict[int, tuple] = {}
        for k in range(n):
            e = entries[k * entry_size : (k + 1) * entry_size]
            tag, kind = struct.unpack(order + "HH", e[:4])
            (many,) = struct.unpack(order + ("Q" if big else "I"), e[4 : entry_size - value_size])
            letter = TYPES.get(kind)
            if letter is None:
                continue
            size = struct.calcsize(order + letter) * many
            raw = e[entry_size - value_size :][:size]
            if size > value_size:
                f.seek(struct.unpack(order + ("Q" if big else "I"), e[entry_size - value_size :])[0])
                raw = f.read(size)
            tags[tag] = (raw,) if letter == "s" else struct.unpack(f"{order}{many}{letter}", raw)

    def one(tag: int, default=None):
        return tags[tag][0] if tag in tags else default

    compression, rows = one(COMPRESSION, PLAIN), one(HEIGHT)
    wrong = [
        (TILE_WIDTH in tags, "tiled"),
        (compression not in (PLAIN, *DEFLATED), f"compression {compression}"),
        (one(SAMPLES, 1) != 1, "several bands"),
        (one(PREDICTOR, 1) != 1, "a predictor"),
        (TRANSFORM in tags, "a transformation matrix"),
        (PIXEL_SCALE not in tags or TIE_POINT not in tags, "no position"),
        (one(SAMPLE_FORMAT, 1) not in KINDS, f"sample format {one(SAMPLE_FORMAT)}"),
    ]
    for bad, what in wrong:
        if bad:
            raise ValueError(f"raster file not supported ({what}): {path}")
    (scale_x, scale_y), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
    if scale_x != scale_y:
        raise ValueError(f"raster file not supported (cells are not square): {path}")
    text = one(NODATA)
    return Layer(
        path,
        int(LAYER.search(path)[1]),
        rows,
        one(WIDTH),
        f"{order}{KINDS[one(SAMPLE_FORMAT, 1)]}{one(BITS, 1) // 8}",
        compression in DEFLATED,
        min(one(ROWS_PER_STRIP, rows), rows),
        tuple(tags[STRIP_OFFSETS]),
        tuple(tags[STRIP_BYTES]),
        x - i * scale_x,
        y + j * scale_y,
        scale_x,
        float(text.rstrip(b"\x00 ").decode()) if text else None,
    )


@dataclass
class Strips(InputPartition):
    """Strips ``first`` to ``last`` of a file."""

    layer: Layer
    first: int
    last: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("name the folder of the raster files")
        self.path = options["path"]
        named = options.get("layers")
        self.layers = {int(v) for v in named.split(",")} if named else None

    def partitions(self) -> list[Strips]:
        out = []
        for path in layer_files(self.path, self.layers).values():
            layer = read_layer(path)
            strip = layer.rows_per_strip * layer.n_cols * np.dtype(layer.dtype).itemsize
            step = max(1, PARTITION_BYTES // strip)
            out += [Strips(layer, a, min(a + step, len(layer.offsets))) for a in range(0, len(layer.offsets), step)]
        return out

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        layer = partition.layer
        fs, at = file_system(layer.path)
        names = ["var", "row_id", "col_id", "value"]
        with fs.open_input_file(at) as f:
            for k in range(partition.first, partition.last):
                first = k * layer.rows_per_strip
                rows = min(layer.rows_per_strip, layer.n_rows - first)
                f.seek(layer.offsets[k])
                raw = f.read(layer.counts[k])
                values = np.frombuffer(zlib.decompress(raw) if layer.deflated else raw, layer.dtype)
                if len(values) < rows * layer.n_cols:
                    raise ValueError(f"strip {k} is short: {layer.path}")
                values = values[: rows * layer.n_cols].astype(np.float32)
                cell = np.arange(len(values))
                row, col = (first + cell // layer.n_cols).astype(np.int32), (cell % layer.n_cols).astype(np.int32)
                for a in range(0, len(values), BATCH_CELLS):
                    b = min(a + BATCH_CELLS, len(values))
                    cols = [np.full(b - a, layer.var, np.int32), row[a:b], col[a:b], values[a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


class FilteringReader(RasterReader):
    """A reader that takes over filters on the layer."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = None
            if isinstance(f, EqualTo) and f.attribute == ("var",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("var",):
                wanted = set(f.value)
            if wanted is None:
                yield f
            else:
                self.layers = wanted if self.layers is None else self.layers & wanted


class RasterFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        options = dict(self.options)
        return (FilteringReader if options.get("pushdown") == "true" else RasterReader)(options)


def read_raster_files(spark: SparkSession, path: str, variables: list[int] | None = None) -> DataFrame:
    """The cells of a folder of raster files, of some layers or all; a layer that is named and has no file is an error."""
    files = layer_files(path, set(variables) if variables is not None else None)
    if variables is not None:
        missing = set(variables) - set(files)
        if missing:
            raise FileNotFoundError(f"raster layers missing: {', '.join(f'bio{v}' for v in sorted(missing))}")
    spark.dataSource.register(RasterFiles)
    reader = spark.read.format(NAME).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    if variables is not None:
        reader = reader.option("layers", ",".join(map(str, variables)))
    cells = reader.load(path)
    cells.layers = set(files)  # known without a scan
    return cells


def raster_files_meta(path: str, variables: list[int] | None = None) -> RasterMeta:
    """The geometry of a folder's files, which must agree, with each layer's nodata value."""
    layers = [read_layer(p) for p in layer_files(path, set(variables) if variables else None).values()]
    if not layers:
        raise FileNotFoundError(f"no raster files: {path}")
    shapes = {(x.left, x.top, x.res, x.n_rows, x.n_cols) for x in layers}
    if len(shapes) > 1:
        raise ValueError(f"raster files differ in geometry: {path}")
    first = layers[0].nodata
    own = tuple((x.var, x.nodata) for x in layers if x.nodata != first)
    return RasterMeta(*shapes.pop(), first, own)


def encode_layer(values: np.ndarray, meta: RasterMeta, rows_per_strip: int = 64, deflated: bool = True, order: str = "<") -> bytes:
    """A layer as the bytes of a classic file, for rasters that fit in memory (fixtures, small exports)."""
    values = np.ascontiguousarray(values).astype(values.dtype.newbyteorder(order))
    strips = [values[a : a + rows_per_strip].tobytes() for a in range(0, len(values), rows_per_strip)]
    strips = [zlib.compress(s) if deflated else s for s in strips]
    kind = {v: k for k, v in KINDS.items()}[values.dtype.kind]
    nodata = b"" if meta.nodata is None else repr(float(meta.nodata)).encode() + b"\x00"
    tags = [
        (WIDTH, 4, (values.shape[1],)), (HEIGHT, 4, (len(values),)), (BITS, 3, (8 * values.dtype.itemsize,)),
        (COMPRESSION, 3, (DEFLATED[0] if deflated else PLAIN,)), (STRIP_OFFSETS, 4, (0,) * len(strips)), (SAMPLES, 3, (1,)),
        (ROWS_PER_STRIP, 4, (rows_per_strip,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (SAMPLE_FORMAT, 3, (kind,)),
        (PIXEL_SCALE, 12, (meta.res, meta.res, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, meta.left, meta.top, 0.0)),
    ]
    if nodata:
        tags.append((NODATA, 2, nodata))

    def layout(at: int) -> tuple[bytes, bytes]:
        """The directory at byte 8 and the values behind it, with strips from ``at`` on."""
        places = np.cumsum([at, *map(len, strips)])[:-1].tolist()
        directory, extra = struct.pack(order + "H", len(tags)), b""
        extra_at = 8 + 2 + 12 * len(tags) + 4
        for tag, type_, items in tags:
            items = tuple(places) if tag == STRIP_OFFSETS else items
            raw = items if type_ == 2 else struct.pack(f"{order}{len(items)}{TYPES[type_]}", *items)
            if len(raw) > 4:
                inline, extra = struct.pack(order + "I", extra_at + len(extra)), extra + raw + b"\x00" * (len(raw) % 2)
            else:
                inline = raw.ljust(4, b"\x00")
            directory += struct.pack(order + "HHI", tag, type_, len(items)) + inline
        return directory + struct.pack(order + "I", 0), extra

    directory, extra = layout(0)
    directory, extra = layout(8 + len(directory) + len(extra))
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    return head + directory + extra + b"".join(strips)


def write_layer(path: str, values: np.ndarray, meta: RasterMeta, **how) -> None:
    fs, at = file_system(path)
    with fs.open_output_stream(at) as f:
        f.write(encode_layer(values, meta, **how))
