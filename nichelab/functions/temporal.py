"""Date parsing and temporal features of an occurrence (month, day of year, cyclic month)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nichelab.schemas import TWO_PI


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_event_date(event_date: Column | str) -> Column:
    """Lenient date parse of a free-form event date; failure gives null.

    Takes the start of an ``a/b`` range and the date part of a datetime
    (``2020-05-01T10:00:00+02:00`` -> 2020-05-01, local date, no zone
    shift); partial dates ``2020`` / ``2020-05`` are accepted; bad text,
    empty text and impossible dates are null.
    """
    start = F.split(_c(event_date), "/").getItem(0)
    return F.substring(start, 1, 10).try_cast("date")


def month_feature(month: Column | str, event_date: Column | str) -> Column:
    """Given month if present (kept as is, even out of range), else month of the parsed date."""
    return F.coalesce(_c(month), F.month(parse_event_date(event_date)))


def _truthy(col: Column) -> Column:
    return col.isNotNull() & (col != 0)


def day_of_year(year: Column | str, month: Column | str, day: Column | str, event_date: Column | str) -> Column:
    """Day of year from (year, month, day) when all three are set and non-zero.

    An impossible triple gives null without falling back to the event
    date; otherwise a non-empty event date is parsed leniently.
    """
    y, m, d, e = _c(year), _c(month), _c(day), _c(event_date)
    from_parts = F.dayofyear(F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date"))
    from_text = F.dayofyear(parse_event_date(e))
    return (
        F.when(_truthy(y) & _truthy(m) & _truthy(d), from_parts)
        .when(e.isNotNull() & (e != F.lit("")), from_text)
        .otherwise(F.lit(None).cast("int"))
    )


def _month_angle(month: Column) -> Column:
    return F.lit(TWO_PI) * (month - F.lit(1)) / F.lit(12.0)


def sin_month(month: Column | str) -> Column:
    """sin(2 pi (m - 1) / 12); null when the month is outside 1..12."""
    m = _c(month)
    return F.when(m.between(1, 12), F.sin(_month_angle(m)))


def cos_month(month: Column | str) -> Column:
    """cos(2 pi (m - 1) / 12); null when the month is outside 1..12."""
    m = _c(month)
    return F.when(m.between(1, 12), F.cos(_month_angle(m)))


def month_name(month: Column | str) -> Column:
    """English month name, e.g. 3 -> March."""
    return F.date_format(F.make_date(F.lit(2000), _c(month), F.lit(1)), "MMMM")


def iso_utc_now() -> Column:
    """Current UTC timestamp as ISO text (provenance only, never in compared output)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
