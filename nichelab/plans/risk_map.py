"""Risk map: grid -> environment -> score -> classes, summaries, hotspots, cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from nichelab.operators import grid as G
from nichelab.sources.tables import RasterMeta


@dataclass
class RiskMap:
    bounds: G.Bounds | DataFrame  # numbers, or the lazy extent frame
    n: int
    month: int
    points: DataFrame  # idx, i, j, latitude, longitude, month
    enriched: DataFrame  # + environment before filling, matched, sin/cos month
    filled: DataFrame  # environment with defaults
    scored: DataFrame  # + risk


def build_grid(
    spark: SparkSession,
    cells: DataFrame,
    elev: DataFrame,
    meta: RasterMeta,
    bounds: G.Bounds,
    n: int,
    month: int,
    elev_meta: RasterMeta | None = None,
    wide: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    points = G.grid_points(spark, bounds, n, month)
    enriched = G.enrich_grid(points, cells, elev, meta, elev_meta, wide)
    return points, enriched, G.fill_grid(enriched)


def density_risk_map(
    spark: SparkSession,
    occurrence_points: DataFrame,
    cells: DataFrame,
    elev: DataFrame,
    meta: RasterMeta,
    n: int = 50,
    month: int = 1,
    bounds: G.Bounds | DataFrame | None = None,
) -> RiskMap:
    """Risk map over the occurrences' extent (or given bounds) scored by occurrence density."""
    if bounds is None:
        bounds = G.data_extent(occurrence_points)
    points, enriched, filled = build_grid(spark, cells, elev, meta, bounds, n, month)
    scored = G.density_score(filled, occurrence_points, meta)
    return RiskMap(bounds, n, month, points, enriched, filled, scored)


def model_risk_map(
    spark: SparkSession,
    model,
    cells: DataFrame,
    elev: DataFrame,
    meta: RasterMeta,
    region: str = "western_cape",
    n: int = 50,
    month: int = 1,
    bounds: G.Bounds | None = None,
    elev_meta: RasterMeta | None = None,
    wide: DataFrame | None = None,
) -> RiskMap:
    """Risk map of a named region scored by a trained pipeline model (class-1 probability)."""
    from nichelab.plans.training import score

    bounds = bounds or G.region_bounds(region)
    points, enriched, filled = build_grid(spark, cells, elev, meta, bounds, n, month, elev_meta, wide)
    scored = score(model, filled)
    return RiskMap(bounds, n, month, points, enriched, filled, scored)


def outputs(rm: RiskMap) -> dict[str, DataFrame]:
    """All analytic outputs of a map; cache ``rm.scored`` first when several are collected."""
    scored = rm.scored
    return {
        "summary": G.risk_summary(scored, rm.month),
        "distribution": G.risk_distribution(scored),
        "stats": G.risk_stats(scored, max_rows=rm.n * rm.n),
        "categories": G.categorize(scored),
        "hotspots": G.hotspots(scored),
        "extent": G.grid_extent(rm.points),
        "cells": G.grid_cells(scored, rm.n),
        "null_profile": G.null_profile(rm.enriched),
        "coverage": G.match_coverage(rm.enriched),
    }
