"""Projections, predicates and column conformance of the occurrence pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nichelab.functions import temporal
from nichelab.schemas import (
    ACCEPTED_MATCH_TYPES,
    ACCEPTED_RANK,
    DEFAULT_DATE_TO,
    QUALITY_STATUS,
)


def project_occurrences(occ: DataFrame) -> DataFrame:
    """Keep and rename the fields the pipeline reads (plus the record key)."""
    return occ.select(
        F.col("key"),
        F.col("decimalLatitude").alias("latitude"),
        F.col("decimalLongitude").alias("longitude"),
        F.col("eventDate").alias("event_date"),
        F.col("year"),
        F.col("month"),
        F.col("day"),
    )


def drop_missing_coordinates(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["latitude", "longitude"])


def quality_filter(occ: DataFrame, enabled: bool = True) -> DataFrame:
    """hasCoordinate AND NOT hasGeospatialIssue AND occurrenceStatus = PRESENT."""
    if not enabled:
        return occ
    return occ.filter(
        (F.col("hasCoordinate") == F.lit(True))
        & (F.col("hasGeospatialIssue") == F.lit(False))
        & (F.col("occurrenceStatus") == F.lit(QUALITY_STATUS))
    )


def date_range_filter(occ: DataFrame, date_from: str | None, date_to: str | None = None) -> DataFrame:
    """Inclusive event-date range, applied only when ``date_from`` is given
    (``date_to`` defaults to 2024-12-31; ``date_to`` alone is ignored)."""
    if not date_from:
        return occ
    start = F.lit(date_from).cast("date")
    end = F.lit(date_to or DEFAULT_DATE_TO).cast("date")
    return occ.filter(temporal.parse_event_date("eventDate").between(start, end))


def country_filter(occ: DataFrame, country: str | None) -> DataFrame:
    if not country:
        return occ
    return occ.filter(F.col("country") == F.lit(country))


def uncertainty_filter(occ: DataFrame, max_meters: float | None) -> DataFrame:
    """Uncertainty in ``[0, max]``; unknown uncertainty does not match; a falsy max disables it."""
    if not max_meters:
        return occ
    return occ.filter(F.col("coordinateUncertaintyInMeters").between(F.lit(0.0), F.lit(float(max_meters))))


def occurrence_filters(
    occ: DataFrame,
    quality: bool = True,
    date_from: str | None = None,
    date_to: str | None = None,
    country: str | None = None,
    uncertainty_max: float | None = None,
) -> DataFrame:
    """All record filters of a search; Catalyst pushes the simple ones into the scan."""
    occ = quality_filter(occ, quality)
    occ = date_range_filter(occ, date_from, date_to)
    occ = country_filter(occ, country)
    return uncertainty_filter(occ, uncertainty_max)


def resolve_taxon(matches: DataFrame) -> DataFrame:
    """Accepted name matches -> ``(taxonKey, species_key, match_type)``.

    Accept EXACT or FUZZY at rank SPECIES; the key is ``speciesKey``, else
    ``usageKey`` (a 0 counts as missing); rows without a key are dropped.
    """
    key = F.coalesce(F.nullif(F.col("speciesKey"), F.lit(0)), F.nullif(F.col("usageKey"), F.lit(0)))
    return (
        matches.filter(F.col("matchType").isin(ACCEPTED_MATCH_TYPES) & (F.col("rank") == F.lit(ACCEPTED_RANK)))
        .select(F.col("taxonKey"), key.cast("long").alias("species_key"), F.col("matchType").alias("match_type"))
        .filter(F.col("species_key").isNotNull())
    )


# a name lookup answers with a handful of keys: so many travel as a broadcast or an IN list, more are joined by shuffle
MAX_RESOLVED_KEYS = 10000


class UnresolvedTaxonError(LookupError):
    """No accepted species key was found for a name."""


def occurrences_of_taxa(occ: DataFrame, resolved: DataFrame, max_broadcast: int = MAX_RESOLVED_KEYS) -> DataFrame:
    """Records whose ``taxonKey`` equals a resolved species key, with its match type.

    Names that resolve to one key count once (EXACT before FUZZY).  Up to
    ``max_broadcast`` keys are broadcast, so the record side -- where every row
    may carry the same key -- is not shuffled on that key; beyond that the join
    shuffles.  The rows are the same either way.
    """
    keys = resolved.groupBy("species_key").agg(F.min("match_type").alias("match_type"))
    if keys.limit(max_broadcast + 1).count() <= max_broadcast:
        keys = F.broadcast(keys)
    return occ.join(keys, occ["taxonKey"] == keys["species_key"], "inner")


def filter_taxa(occ: DataFrame, resolved: DataFrame, max_listed: int = MAX_RESOLVED_KEYS) -> DataFrame:
    """Records of the resolved species keys as a plain ``IN`` predicate, which
    Parquet evaluates in the scan (row groups without the key are skipped); a
    list longer than ``max_listed`` is joined instead.  No key at all is an error."""
    keys = resolved.select("species_key").distinct()
    found = [r["species_key"] for r in keys.limit(max_listed + 1).collect()]
    if not found:
        raise UnresolvedTaxonError("no species key was resolved")
    if len(found) > max_listed:
        return occ.join(keys, occ["taxonKey"] == keys["species_key"], "left_semi")
    return occ.filter(F.col("taxonKey").isin(found))


def add_temporal_features(df: DataFrame) -> DataFrame:
    """month, day_of_year, sin_month, cos_month (I1-I4)."""
    month = temporal.month_feature("month", "event_date")
    out = df.withColumns(
        {"day_of_year": temporal.day_of_year("year", "month", "day", "event_date"), "month": month.cast("int")}
    )
    return out.withColumns({"sin_month": temporal.sin_month("month"), "cos_month": temporal.cos_month("month")})


def conform(df: DataFrame, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Select ``schema``'s columns in order: missing ones become typed nulls,
    present ones are cast leniently (unparsable -> null)."""
    cols = [F.col(k) for k in (keep or [])]
    for field in schema.fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def drop_incomplete(df: DataFrame, required: list[str]) -> DataFrame:
    return df.dropna(subset=required)


def fill_defaults(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Fill nulls per column with fixed defaults, only for columns that exist."""
    present = {k: v for k, v in values.items() if k in df.columns}
    return df.fillna(present) if present else df


def add_presence_default(df: DataFrame, value: int = 1) -> DataFrame:
    """Add ``presence = value`` when the column is absent."""
    if "presence" in df.columns:
        return df
    return df.withColumn("presence", F.lit(value).cast("int"))


def coordinate_status(lat: str = "latitude", lon: str = "longitude") -> F.Column:
    """Null when the point is within +-90 / +-180, else the error text."""
    ok = F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0)
    return F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("Invalid coordinates"))


def validate_coordinates(points: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``error`` for out-of-range points; ``strict`` rejects the whole request instead."""
    out = points.withColumn("error", coordinate_status())
    if strict:
        bad = out.filter(F.col("error").isNotNull()).limit(1).count()
        if bad:
            raise ValueError("coordinate request has points outside +-90 / +-180")
    return out
