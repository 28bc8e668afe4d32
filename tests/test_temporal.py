"""Date leniency, day-of-year null rules and the cyclic month (table-driven)."""

import math

import pytest
from pyspark.sql import functions as F

from nichelab.functions import temporal
from nichelab.operators import filters

DATES = [
    ("2020-05-01", 5, 122),
    ("2020-05-01T10:00:00Z", 5, 122),
    ("2020-05-01T10:00", 5, 122),
    ("2020-01-01T00:30:00+02:00", 1, 1),
    ("2020-12-31T23:30:00-05:00", 12, 366),
    ("2020", 1, 1),
    ("2020-05", 5, 122),
    ("2020-03-05/2020-04-10", 3, 65),
    ("2020-05/2020-07", 5, 122),  # deliberate: range start always
    ("2020-1-5", 1, 5),
    ("14/08/2019", None, None),  # deliberate: day-first text is not parsed
    ("junk", None, None),
    ("", None, None),
    ("2020-02-30", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("text,month,doy", DATES)
def test_lenient_parse(spark, text, month, doy):
    df = spark.createDataFrame([(text,)], "event_date string")
    r = df.select(
        F.month(temporal.parse_event_date("event_date")).alias("m"),
        F.dayofyear(temporal.parse_event_date("event_date")).alias("d"),
    ).first()
    assert (r["m"], r["d"]) == (month, doy)


def _features(spark, rows):
    df = spark.createDataFrame(rows, "key long, year int, month int, day int, event_date string")
    return {r["key"]: r for r in filters.add_temporal_features(df).collect()}


def test_day_of_year_rules(spark):
    out = _features(
        spark,
        [
            (1, 2020, 3, 1, None),  # triple wins: 61 in a leap year
            (2, 2020, 2, 30, "2020-05-01"),  # impossible triple: null, no fallback
            (3, 2020, 0, 5, "2020-05-01"),  # zero part: falls back to the text
            (4, None, 5, 1, "2021-02-01"),  # missing part: falls back
            (5, 2021, 13, 1, None),  # month 13: null day, month kept, no sin/cos
            (6, None, None, None, "junk"),
        ],
    )
    assert out[1]["day_of_year"] == 61
    assert out[2]["day_of_year"] is None
    assert out[3]["day_of_year"] == 122
    assert out[4]["day_of_year"] == 32 and out[4]["month"] == 5
    assert out[5]["day_of_year"] is None and out[5]["month"] == 13 and out[5]["sin_month"] is None
    assert out[6]["month"] is None and out[6]["day_of_year"] is None


def test_month_from_text_when_missing(spark):
    out = _features(spark, [(1, None, None, None, "2019-08-14")])
    assert out[1]["month"] == 8 and out[1]["day_of_year"] == 226


@pytest.mark.parametrize("m", range(1, 13))
def test_cyclic_month(spark, m):
    out = _features(spark, [(1, None, m, None, None)])
    a = 2 * math.pi * (m - 1) / 12.0
    assert out[1]["sin_month"] == pytest.approx(math.sin(a), abs=1e-15)
    assert out[1]["cos_month"] == pytest.approx(math.cos(a), abs=1e-15)


def test_golden_row_month_one(spark):
    out = _features(spark, [(1, 2021, 1, 9, "2021-01-09")])
    assert out[1]["sin_month"] == 0.0 and out[1]["cos_month"] == 1.0 and out[1]["day_of_year"] == 9
