"""Risk classes as ``when`` chains over fixed bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nichelab.schemas import (
    HOTSPOT_LEVELS,
    LEGEND_STOPS,
    RISK_CATEGORIES,
    RISK_COLOR_BINS,
    RISK_COLOR_FLOOR,
    RISK_HIGH,
    RISK_MEDIUM,
    THRESHOLD_COUNT,
    THRESHOLD_START,
    THRESHOLD_STEP,
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _chain(risk: Column, bins: list[tuple[float | None, str]]) -> Column:
    """First bin (from the top) whose lower bound the risk reaches."""
    expr = None
    fallback = None
    for bound, value in bins:
        if bound is None:
            fallback = value
            continue
        cond = risk >= F.lit(float(bound))
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(fallback)) if fallback is not None else expr


def risk_category(risk: Column | str) -> Column:
    """Six-tier label (0.9 / 0.8 / 0.6 / 0.4 / 0.2)."""
    return _chain(_c(risk), [(b, label) for b, label, _ in RISK_CATEGORIES])


def risk_description(risk: Column | str) -> Column:
    """Advice text of the six-tier label."""
    return _chain(_c(risk), [(b, text) for b, _, text in RISK_CATEGORIES])


def risk_color(risk: Column | str) -> Column:
    """Cell colour of the 60-bin scale (first bound reached from the top wins).

    A ``when`` chain on literal bounds stays inside whole-stage codegen and
    needs no join; a range join to a bin table would become a nested loop.
    """
    return _chain(_c(risk), [*RISK_COLOR_BINS, (None, RISK_COLOR_FLOOR)])


def hotspot_color(risk: Column | str) -> Column:
    return _chain(_c(risk), [(b, color) for b, color, _ in HOTSPOT_LEVELS])


def hotspot_level(risk: Column | str) -> Column:
    return _chain(_c(risk), [(b, level) for b, _, level in HOTSPOT_LEVELS])


def threshold_value(i: Column) -> Column:
    """Threshold number ``i`` of the 80-point search grid."""
    return F.lit(THRESHOLD_START) + i.cast("double") * F.lit(THRESHOLD_STEP)


def threshold_bin(score: Column | str) -> Column:
    """Number of search thresholds ``<= score`` (0..80), in O(1) per row.

    An arithmetic first guess is corrected by one comparison each way with
    the exact threshold values, so it equals counting the thresholds.
    """
    p = _c(score)
    n = THRESHOLD_COUNT
    guess = F.floor((p - F.lit(THRESHOLD_START)) / F.lit(THRESHOLD_STEP)).cast("long") + F.lit(1)
    k = F.least(F.greatest(guess, F.lit(0)), F.lit(n))
    return (
        F.when((k > 0) & (threshold_value(k - 1) > p), k - 1)
        .when((k < n) & (threshold_value(k) <= p), k + 1)
        .otherwise(k)
    )


def _channels(index: int) -> list[int]:
    return [int(stop[1 + 2 * index : 3 + 2 * index], 16) for stop in LEGEND_STOPS]


def legend_color(risk: Column | str) -> Column:
    """Colour of the continuous legend: linear per RGB channel between the
    11 stops at 0.0, 0.1, ..., 1.0 (risk clamped to [0, 1]), rounded to the
    nearest integer channel value."""
    r = _c(risk)
    seg = F.least(F.greatest(F.floor(r * F.lit(10.0)), F.lit(0)), F.lit(9)).cast("int")
    frac = F.least(F.greatest(r * F.lit(10.0) - seg.cast("double"), F.lit(0.0)), F.lit(1.0))
    parts = []
    for ch in range(3):
        vals = F.array(*[F.lit(v) for v in _channels(ch)])
        lo = F.element_at(vals, seg + 1)
        hi = F.element_at(vals, seg + 2)
        parts.append(F.round(lo.cast("double") + (hi - lo).cast("double") * frac).cast("int"))
    return F.format_string("#%02X%02X%02X", *parts)
