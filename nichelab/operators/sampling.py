"""Deterministic sampling, splitting, paging and pseudo-absence generation.

Order and membership come from integer hashes of the record key, never
from ``rand()``: the answer does not depend on partitioning, and a task
recomputed after an executor loss produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichelab.functions.numeric import clip, hash_order, hash_unit
from nichelab.operators.windows import running_totals
from nichelab.schemas import SEED, WORLD_LAT_BOUNDS, WORLD_LON_BOUNDS

# multipliers of the three independent hash streams (sample order, lat, lon)
ORDER_MULT, LAT_MULT, LON_MULT = 7919, 104729, 130363


# samples up to this size are a top-n that one task merges; larger ones are cut by the hash
TOP_N_ROWS = 100_000
# width of a histogram cell in hash values (about a thousand cells)
CUT_WIDTH = 1000


def hash_sample(
    df: DataFrame, n: int, key: str = "key", seed: int = SEED, tiebreak: list[str] | None = None
) -> DataFrame:
    """``n`` rows chosen by hash order (ties by key, then ``tiebreak``).

    Up to ``TOP_N_ROWS`` it is a top-n: each task keeps at most n rows and only
    those are merged.  A larger sample takes every row below a cut of the hash,
    found from two histograms of about a thousand cells, and only the rows that
    share the hash value at the cut are ordered.  Rows without a key are the first
    cell, as they come first in order.  The rows are the same.
    """
    n = int(n)
    order = [F.col(key), *[F.col(c) for c in tiebreak or []]]
    if n <= TOP_N_ROWS:
        return df.orderBy(hash_order(key, ORDER_MULT, seed), *order).limit(n)
    h = hash_order(key, ORDER_MULT, seed)

    def cut(rows: DataFrame, cell: F.Column, want: int) -> tuple[bool, int | None, int]:
        """Whether there are ``want`` rows, the cell in which row number ``want`` stands, and the rows before it."""
        before = 0
        for r in sorted(rows.groupBy(cell.alias("c")).count().collect(), key=lambda r: (r["c"] is not None, r["c"])):
            if before + r["count"] >= want:
                return True, r["c"], before
            before += r["count"]
        return False, None, before

    cells = F.floor(h / CUT_WIDTH)
    reached, cell, before = cut(df, cells, n)
    if not reached:
        return df  # fewer rows than asked for
    if cell is None:  # enough rows without a key
        return df.filter(h.isNull()).orderBy(*order).limit(n)
    edge = df.filter(cells == cell)
    _, value, inside = cut(edge, h, n - before)
    below = df.filter(h.isNull() | (h < value))
    return below.unionByName(df.filter(h == value).orderBy(*order).limit(n - before - inside))


def background_points(
    presence: DataFrame,
    n: int,
    lat_bounds: tuple[float, float] = WORLD_LAT_BOUNDS,
    lon_bounds: tuple[float, float] = WORLD_LON_BOUNDS,
    key: str = "key",
    seed: int = SEED,
) -> DataFrame:
    """Pseudo-absence rows: min(n, rows) sampled presence rows moved by up to
    +-0.5 degree in latitude and longitude, clipped to the bounds, label 0;
    the environment columns are copied unchanged."""
    sample = hash_sample(presence, n, key, seed)
    d_lat = hash_unit(key, LAT_MULT, seed) - F.lit(0.5)
    d_lon = hash_unit(key, LON_MULT, seed) - F.lit(0.5)
    return sample.withColumns(
        {
            "latitude": clip(F.col("latitude") + d_lat, *lat_bounds),
            "longitude": clip(F.col("longitude") + d_lon, *lon_bounds),
            "presence": F.lit(0).cast("int"),
        }
    )


def class_presence(df: DataFrame, label: str = "presence") -> tuple[bool, bool]:
    """(has class 1, has class 0) from one aggregate row."""
    row = df.agg(
        F.max((F.col(label) == 1).cast("int")).alias("pos"), F.max((F.col(label) == 0).cast("int")).alias("neg")
    ).first()
    return bool(row["pos"]), bool(row["neg"])


def with_background(
    data: DataFrame,
    n: int,
    lat_bounds: tuple[float, float] = WORLD_LAT_BOUNDS,
    lon_bounds: tuple[float, float] = WORLD_LON_BOUNDS,
    label: str = "presence",
    known: tuple[bool, bool] | None = None,
) -> DataFrame:
    """Add background rows only when a class is missing (UNION ALL by name).

    ``known`` = (has class 1, has class 0) when the caller knows it (e.g. it
    just set every label to 1), which saves the checking aggregate.  Only
    presence rows can be jittered into absences: a frame holding nothing but
    absences is rejected.
    """
    has_pos, has_neg = known if known is not None else class_presence(data, label)
    if has_pos and has_neg:
        return data
    if not has_pos:
        raise ValueError("no presence rows: cannot build background points from absences")
    return data.unionByName(background_points(data, n, lat_bounds, lon_bounds))


def split_label(key: str = "key", train_percent: int = 80, seed: int = SEED) -> F.Column:
    """``train`` for about ``train_percent`` % of keys, else ``test``."""
    return F.when(hash_order(key, ORDER_MULT, seed) % 100 < train_percent, F.lit("train")).otherwise(F.lit("test"))


def fold_id(key: str = "key", k: int = 3, seed: int = SEED, label: str | None = None) -> F.Column:
    """Fold number 0..k-1 from a hash of the key (and label, for per-class folds)."""
    base = hash_order(key, LAT_MULT, seed)
    if label is not None:
        base = base + F.col(label).cast("long")
    return (base % k).cast("int")


def stratified_folds(
    df: DataFrame, k: int = 3, label: str = "presence", key: str = "key", seed: int = SEED, tiebreak: list[str] | None = None
) -> DataFrame:
    """``df`` with ``fold`` 0..k-1 such that every class's counts differ by one row at most between folds.

    A row's fold is its rank within its class, in hash order, modulo ``k``.  Rows are counted per class and hash value,
    running totals over bucketed ranges of the hash give the rank at which each value begins, and only the few rows that
    share a class and a hash value are ranked among themselves (by key, then ``tiebreak``).
    """
    # rows without a label are a class too, and rows without a key the first of theirs
    named = {"_class": F.coalesce(F.col(label).cast("string"), F.lit("")), "_h": F.coalesce(hash_order(key, LAT_MULT, seed), F.lit(-1))}
    hashed = df.withColumns(named)
    per_value = hashed.groupBy("_class", "_h").agg(F.count(F.lit(1)).alias("_n"))
    begins = running_totals(per_value, "_h", ["_n"], by=["_class"], inclusive=False, bounds=hash_bounds(df.sparkSession))
    order = [F.col(key), *[F.col(c) for c in tiebreak or []]]
    within = F.row_number().over(Window.partitionBy("_class", "_h").orderBy(*order)) - 1
    fold = ((F.col("cum__n") + F.col("_within")) % k).cast("int")
    joined = hashed.withColumn("_within", within).join(begins.select("_class", "_h", "cum__n"), ["_class", "_h"])
    return joined.select(*df.columns, fold.alias("fold"))


def hash_bounds(spark, modulus: int = 1000003) -> list[float]:
    """Bounds that cut the hash range into as many equal parts as there are shuffle partitions: no pass over the data."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return [modulus * i / n for i in range(1, n)]


def subsample(
    train: DataFrame,
    validation: DataFrame | None,
    limit_rows: int,
    key: str = "key",
    tiebreak: list[str] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Training: min(limit, rows); validation: max(min(max(limit // 4, 50), rows), 1).
    A falsy or negative limit keeps everything.  Ties go by the label by default:
    a background row has its parent's key."""
    if not limit_rows or limit_rows <= 0:
        return train, validation
    if tiebreak is None:
        tiebreak = ["presence"] if "presence" in train.columns else []
    train = hash_sample(train, limit_rows, key, tiebreak=tiebreak)
    if validation is not None:
        validation = hash_sample(validation, max(max(limit_rows // 4, 50), 1), key, tiebreak=tiebreak)
    return train, validation


def page(df: DataFrame, order_col: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset + limit`` in ``order_col`` order (deterministic paging)."""
    return df.orderBy(order_col).offset(int(offset)).limit(int(limit))
