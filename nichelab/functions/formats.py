"""Text formats: coordinate keys, percentages, polygon rings, links, variable names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from nichelab.functions.numeric import half_even
from nichelab.schemas import NAVIGATION_URL_PREFIX


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def percent_text(risk: Column | str) -> Column:
    """``0.1234`` -> ``12.34%``, ties to even; null stays null."""
    value = _c(risk)
    return F.when(value.isNotNull(), F.format_string("%.2f%%", half_even(value * F.lit(100.0), 2)))


def coordinate_key(lat: Column | str, lon: Column | str) -> Column:
    """Cache key text ``lat,lon`` at 3 decimals; null when a coordinate is."""
    lat, lon = _c(lat), _c(lon)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.3f,%.3f", half_even(lat, 3), half_even(lon, 3)))


def location_list(pos: Column | str, lat: Column | str, lon: Column | str) -> Column:
    """Aggregate: ``lat,lon|lat,lon|...`` of a group (a request batch) in ``pos`` order.

    The group is a fixed-size batch, so the list it gathers is bounded.
    """
    item = F.struct(_c(pos).alias("pos"), F.concat_ws(",", _c(lat).cast("string"), _c(lon).cast("string")).alias("loc"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["loc"]), "|")


def batch_id(pos: Column | str, size: int) -> Column:
    """Fixed-size batch number ``pos div size``."""
    return F.floor(_c(pos) / F.lit(size)).cast("long")


def polygon_ring(corners: list[tuple[Column, Column]]) -> Column:
    """Closed GeoJSON ring ``[[lon, lat], ...]`` from (lat, lon) corners."""
    pts = [F.array(lon, lat) for lat, lon in corners]
    return F.array(*pts, pts[0])


def navigation_url(lat: Column | str, lon: Column | str) -> Column:
    """Directions link to a point."""
    return F.concat(F.lit(NAVIGATION_URL_PREFIX), _c(lat).cast("string"), F.lit(","), _c(lon).cast("string"))


def first_present(*cols: Column, zero_is_missing: bool = False) -> Column:
    """First non-null value; with ``zero_is_missing`` a 0 also counts as missing."""
    if zero_is_missing:
        cols = tuple(F.nullif(c, F.lit(0)) for c in cols)
    return F.coalesce(*cols)


def split_variable_list(text: Column | str) -> Column:
    """``"1, 4,5"`` -> array of trimmed items."""
    return F.transform(F.split(_c(text), ","), lambda s: F.trim(s))


def normalize_variable(name: str) -> str | None:
    """Request name -> layer name: ``"1"`` and ``"bio1"`` -> ``bio1``; a comma
    list keeps its first item; anything non-numeric -> None (a null column)."""
    text = str(name)
    digits = text[3:] if text.startswith("bio") else text
    digits = digits.split(",")[0]
    if not re.fullmatch(r"\s*[+-]?\d+\s*", digits):
        return None
    return f"bio{int(digits)}"
