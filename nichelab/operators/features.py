"""Documented feature set: interactions, indices and the distance from the median point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelab.operators.windows import exact_median_of_counts

# products of two layers, as (left, right)
INTERACTIONS = [("bio1", "bio12"), ("bio1", "bio13"), ("bio6", "bio14"), ("bio5", "bio6"), ("bio13", "bio15"), ("bio14", "bio15")]


def median_point(df: DataFrame, columns: tuple[str, ...] = ("latitude", "longitude")) -> dict[str, float | None]:
    """The exact median of each column: one number per column comes to the driver.

    The rows are read once: what is ranked is the persisted count per distinct
    value, one small table for all columns.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s"))
    stacked = stacked.select("s.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = stacked.groupBy("name", "value").agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        found = {r["name"]: r["m"] for r in exact_median_of_counts(counts, "value", by=["name"], alias="m").collect()}
    finally:
        counts.unpersist()
    return {c: found.get(c) for c in columns}


def enhanced_features(df: DataFrame) -> DataFrame:
    """``key`` with six interactions, temperature-precipitation, aridity, elevation-temperature and
    seasonality indices, and the planar distance from the median point (null where a ratio has no divisor)."""
    median = median_point(df)
    mid = {c: F.lit(v).cast("double") for c, v in median.items()}
    c = F.col
    return df.select(
        "key",
        *[(c(a) * c(b)).alias(f"{a}_x_{b}") for a, b in INTERACTIONS],
        (c("bio1") * c("bio12")).alias("temp_precip"),
        F.try_divide(c("bio12"), c("bio1") + F.lit(10.0)).alias("aridity"),
        (c("elevation") * c("bio1")).alias("elev_temp"),
        F.try_divide(c("bio13"), c("bio14")).alias("precip_seasonality_ratio"),
        F.sqrt(F.pow(c("latitude") - mid["latitude"], 2) + F.pow(c("longitude") - mid["longitude"], 2)).alias("dist_from_median"),
    )
