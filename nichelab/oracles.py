"""DuckDB SQL for every registered query with a relational equivalent.

The views of ``sources.tables`` are inlined as CTEs.  These statements are
written independently of the Spark code paths (plain windows over all rows,
a cross join with the threshold list, a recursive fold), so agreement
checks the distributed formulations against the direct ones.  Doubles are
rounded to 6 decimals and ``+ 0`` folds -0.0 into 0.0, as in ``queries``.
"""

from __future__ import annotations


def R(x: str) -> str:
    return f"(ROUND(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def RE(x: str) -> str:
    return f"(ROUND_EVEN(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def D(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def with_(ctes: list[str], body: str) -> str:
    recursive = any("fold AS (" in c for c in ctes)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


CLIMATE = [1, 4, 5, 6, 12, 13, 14, 15]
BIO = [f"bio{v}" for v in CLIMATE]
ML_COLS = ["latitude", "longitude", "elevation", *BIO, "month", "day_of_year", "sin_month", "cos_month"]
ML_DOUBLES = ["latitude", "longitude", "elevation", *BIO, "sin_month", "cos_month"]

# ---------------------------------------------------------------- views

OCCURRENCE = """occurrence AS (
SELECT o_orderkey AS key,
  CAST(100 + o_custkey % 3 AS BIGINT) AS taxonKey,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       ELSE CAST((o_custkey * 7919) % 17000 - 8500 AS DOUBLE) / CAST(100 AS DOUBLE) END AS decimalLatitude,
  CAST((o_custkey * 104729) % 36000 - 18000 AS DOUBLE) / CAST(100 AS DOUBLE) AS decimalLongitude,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL
       WHEN o_orderkey % 29 = 0 THEN 'junk'
       WHEN o_orderkey % 31 = 0 THEN concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '/2002-01-01')
       ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS eventDate,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 13
       ELSE CAST(month(o_orderdate) AS INTEGER) END AS month,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 31
       ELSE CAST(day(o_orderdate) AS INTEGER) END AS day,
  CASE WHEN o_custkey % 4 = 0 THEN 'ZA' ELSE 'XX' END AS country,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 15000 AS DOUBLE) END AS coordinateUncertaintyInMeters,
  o_orderkey % 17 <> 0 AS hasCoordinate,
  o_orderkey % 19 = 0 AS hasGeospatialIssue,
  CASE WHEN o_orderkey % 23 = 0 THEN 'ABSENT' ELSE 'PRESENT' END AS occurrenceStatus
FROM orders)"""

POINTS = """points AS (
SELECT key, decimalLatitude AS latitude, decimalLongitude AS longitude, eventDate AS event_date, year, month, day
FROM occurrence WHERE decimalLatitude IS NOT NULL AND decimalLongitude IS NOT NULL)"""

TAXON = """taxon AS (
SELECT CAST(100 AS BIGINT) AS taxonKey, 'EXACT' AS matchType, 'SPECIES' AS rank, CAST(100 AS BIGINT) AS speciesKey, CAST(900 AS BIGINT) AS usageKey
UNION ALL SELECT 101, 'FUZZY', 'SPECIES', 0, 101
UNION ALL SELECT 102, 'HIGHERRANK', 'GENUS', NULL, 102),
resolved AS (
SELECT taxonKey, CAST(COALESCE(NULLIF(speciesKey, 0), NULLIF(usageKey, 0)) AS BIGINT) AS species_key, matchType AS match_type
FROM taxon WHERE matchType IN ('EXACT', 'FUZZY') AND rank = 'SPECIES'
  AND COALESCE(NULLIF(speciesKey, 0), NULLIF(usageKey, 0)) IS NOT NULL)"""

SPECIES = """species AS (
SELECT o.* FROM occurrence o JOIN resolved r ON o.taxonKey = r.species_key
WHERE r.taxonKey = 100 AND o.hasCoordinate AND NOT o.hasGeospatialIssue AND o.occurrenceStatus = 'PRESENT'
  AND o.coordinateUncertaintyInMeters BETWEEN 0 AND 10000)"""

_VARS = " UNION ALL ".join(f"SELECT {v} AS var" for v in CLIMATE)

RASTER = f"""raster_cell AS (
SELECT v.var, CAST(a.n AS INTEGER) AS row_id, CAST(b.n AS INTEGER) AS col_id,
  CASE WHEN (a.n * 72 + b.n + v.var) % 23 = 0 THEN CAST(-9999 AS FLOAT)
       ELSE CAST((a.n * 31 + b.n * 17 + v.var * 101) % 500 AS FLOAT) END AS value
FROM (SELECT range AS n FROM range(36)) a CROSS JOIN (SELECT range AS n FROM range(72)) b
CROSS JOIN ({_VARS}) v),
cell_clean AS (
SELECT var, row_id, col_id,
  CASE WHEN value = CAST(-9999 AS FLOAT) OR isnan(value) OR isinf(value) THEN NULL
       WHEN var IN (1, 4, 5, 6, 7, 8, 9, 10, 11) THEN CAST(CAST(value / 10 AS FLOAT) AS DOUBLE)
       ELSE CAST(value AS DOUBLE) END AS value
FROM raster_cell),
wide AS (
SELECT row_id, col_id, {", ".join(f"MAX(CASE WHEN var = {v} THEN value END) AS bio{v}" for v in CLIMATE)}
FROM cell_clean GROUP BY row_id, col_id)"""

ELEV = """elev_cell AS (
SELECT CAST(a.n AS INTEGER) AS row_id, CAST(b.n AS INTEGER) AS col_id,
  CAST((a.n * 131 + b.n * 71) % 3000 AS DOUBLE) AS elevation
FROM (SELECT range AS n FROM range(36)) a CROSS JOIN (SELECT range AS n FROM range(72)) b
WHERE (a.n * 72 + b.n) % 29 <> 0)"""


def cell_cols(lat: str = "latitude", lon: str = "longitude") -> str:
    row = f"floor((CAST(90 AS DOUBLE) - {lat}) / CAST(5 AS DOUBLE))"
    col = f"floor(({lon} - CAST(-180 AS DOUBLE)) / CAST(5 AS DOUBLE))"
    inside = f"({row} BETWEEN 0 AND 35 AND {col} BETWEEN 0 AND 71)"
    return f"CASE WHEN {inside} THEN CAST({row} AS INTEGER) END AS row_id, CASE WHEN {inside} THEN CAST({col} AS INTEGER) END AS col_id"


PARSED = "TRY_CAST(substr(split_part(event_date, '/', 1), 1, 10) AS DATE)"
MONTH_F = f"COALESCE(month, CAST(month({PARSED}) AS INTEGER))"
DOY = f"""CASE WHEN year IS NOT NULL AND year <> 0 AND month IS NOT NULL AND month <> 0 AND day IS NOT NULL AND day <> 0
       THEN CAST(dayofyear(TRY_CAST(printf('%04d-%02d-%02d', year, month, day) AS DATE)) AS INTEGER)
     WHEN event_date IS NOT NULL AND event_date <> '' THEN CAST(dayofyear({PARSED}) AS INTEGER) END"""


def angle(m: str) -> str:
    return f"(2 * pi()) * ({m} - 1) / CAST(12 AS DOUBLE)"


def temporal_cte(name: str, src: str) -> str:
    return f"""{name}_m AS (SELECT *, {DOY} AS day_of_year_f, {MONTH_F} AS month_f FROM {src}),
{name} AS (
SELECT * EXCLUDE (month, month_f, day_of_year_f), month_f AS month, day_of_year_f AS day_of_year,
  CASE WHEN month_f BETWEEN 1 AND 12 THEN sin({angle('month_f')}) END AS sin_month,
  CASE WHEN month_f BETWEEN 1 AND 12 THEN cos({angle('month_f')}) END AS cos_month
FROM {name}_m)"""


def ml_ready_ctes(name: str, country: str | None) -> list[str]:
    where = f" AND country = '{country}'" if country else ""
    return [
        f"""{name}_pts AS (
SELECT key, decimalLatitude AS latitude, decimalLongitude AS longitude, eventDate AS event_date, year, month, day
FROM species WHERE decimalLatitude IS NOT NULL AND decimalLongitude IS NOT NULL{where})""",
        temporal_cte(f"{name}_feat", f"{name}_pts"),
        f"""{name}_env AS (
SELECT f.*, {", ".join(f"w.{b}" for b in BIO)},
  CASE WHEN f.latitude BETWEEN -90 AND 90 AND f.longitude BETWEEN -180 AND 180 THEN e.elevation END AS elevation
FROM (SELECT *, {cell_cols()} FROM {name}_feat) f
LEFT JOIN wide w ON f.row_id = w.row_id AND f.col_id = w.col_id
LEFT JOIN elev_cell e ON f.row_id = e.row_id AND f.col_id = e.col_id)""",
        f"""{name} AS (
SELECT key, {", ".join(RE(c) + " AS " + c if c in ML_DOUBLES else c for c in ML_COLS)}
FROM {name}_env
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*BIO, "month", "sin_month", "cos_month"])})""",
    ]


BASE = [OCCURRENCE, TAXON, SPECIES, RASTER, ELEV]
ML_GLOBAL = ml_ready_ctes("mlg", None)
ML_LOCAL = ml_ready_ctes("mll", "ZA")


def select_rounded(src: str, cols: list[str], doubles: list[str]) -> str:
    return "SELECT " + ", ".join(R(c) + " AS " + c if c in doubles else c for c in cols) + f" FROM {src}"


def hash_order(key: str, mult: int, seed: int = 42) -> str:
    return f"((({key}) % 1000003) * {mult} + {seed}) % 1000003"


def hash_unit(key: str, mult: int) -> str:
    return f"(CAST({hash_order(key, mult)} AS DOUBLE) / CAST(1000003 AS DOUBLE))"


def background(name: str, src: str, n: int, lat_b: tuple[float, float], lon_b: tuple[float, float]) -> str:
    cols = ", ".join(
        (
            f"GREATEST(LEAST(latitude + ({hash_unit('key', 104729)} - CAST(0.5 AS DOUBLE)), CAST({lat_b[1]} AS DOUBLE)), CAST({lat_b[0]} AS DOUBLE)) AS latitude"
            if c == "latitude"
            else f"GREATEST(LEAST(longitude + ({hash_unit('key', 130363)} - CAST(0.5 AS DOUBLE)), CAST({lon_b[1]} AS DOUBLE)), CAST({lon_b[0]} AS DOUBLE)) AS longitude"
            if c == "longitude"
            else c
        )
        for c in ML_COLS
    )
    return f"""{name}_s AS (SELECT * FROM {src} ORDER BY {hash_order('key', 7919)}, key LIMIT {n}),
{name} AS (
SELECT key, {", ".join(ML_COLS)}, CAST(1 AS INTEGER) AS presence FROM {src}
UNION ALL
SELECT key, {cols}, CAST(0 AS INTEGER) AS presence FROM {name}_s)"""


TRAINING = [
    *BASE,
    *ML_GLOBAL,
    *ML_LOCAL,
    background("train_set", "mlg", 500, (-90.0, 90.0), (-180.0, 180.0)),
    background("val_set", "mll", 100, (-35.0, -22.0), (16.0, 33.0)),
]

SCORED = """scored AS (
SELECT event_id AS key, CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS risk,
  CASE WHEN (event_id * 31) % 7 < 4 AND (event_id * 7919) % 1000 > 300 THEN 1 ELSE 0 END AS label
FROM events)"""

PREDICTION_LOG = """plog AS (
SELECT event_type AS model, event_id AS key, CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS risk,
  CASE WHEN (event_id * 31) % 7 < 4 AND (event_id * 7919) % 1000 > 300 THEN 1 ELSE 0 END AS label
FROM events)"""

REQUESTS = """requests AS (
SELECT c_custkey AS pos,
  CAST((c_custkey * 7919) % 1900 - 950 AS DOUBLE) / CAST(10 AS DOUBLE) AS latitude,
  CAST((c_custkey * 104729) % 3700 - 1850 AS DOUBLE) / CAST(10 AS DOUBLE) AS longitude
FROM customer),
requests_v AS (
SELECT *, CASE WHEN latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 THEN NULL ELSE 'Invalid coordinates' END AS error
FROM requests)"""


def metric_ctes(src: str, thr: str, by: list[str] | None = None) -> list[str]:
    """Confusion counts at ``thr`` (SQL expression), AUC and AP with plain windows."""
    by = by or []
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    g = ", ".join(by)
    gsel = (g + ", ") if by else ""
    join_on = " AND ".join(f"c.{k} = a.{k}" for k in by) if by else "TRUE"
    return [
        f"""sc AS (SELECT {gsel}risk, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label <> 1) AS neg
FROM {src} GROUP BY {gsel}risk)""",
        f"""cum AS (
SELECT {gsel}risk, pos, neg,
  COALESCE(SUM(neg) OVER ({part}ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
  SUM(pos) OVER ({part}ORDER BY risk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_cum,
  SUM(neg) OVER ({part}ORDER BY risk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_cum
FROM sc)""",
        f"""a AS (
SELECT {gsel}SUM(pos) AS P, SUM(neg) AS N,
  SUM({D('pos')} * ({D('neg_below')} + CAST(0.5 AS DOUBLE) * {D('neg')})) AS auc_num,
  SUM({D('pos')} * {D('tp_cum')} / ({D('tp_cum')} + {D('fp_cum')})) AS ap_num
FROM cum {"GROUP BY " + g if by else ""})""",
        f"""c AS (
SELECT {gsel}COUNT(*) FILTER (WHERE risk < {thr} AND label <> 1) AS tn,
  COUNT(*) FILTER (WHERE risk >= {thr} AND label <> 1) AS fp,
  COUNT(*) FILTER (WHERE risk < {thr} AND label = 1) AS fn,
  COUNT(*) FILTER (WHERE risk >= {thr} AND label = 1) AS tp
FROM {src} {"GROUP BY " + g if by else ""})""",
        f"""m AS (
SELECT {", ".join("c." + k for k in by) + ", " if by else ""}
  {ratio('c.tp + c.tn', 'c.tp + c.tn + c.fp + c.fn')} AS accuracy,
  CASE WHEN a.P > 0 AND a.N > 0 THEN a.auc_num / ({D('a.P')} * {D('a.N')}) END AS auc,
  {ratio('2 * c.tp', '2 * c.tp + c.fp + c.fn')} AS f1_score,
  {ratio('c.tp', 'c.tp + c.fn')} AS sensitivity,
  {ratio('c.tn', 'c.tn + c.fp')} AS specificity,
  {ratio('c.tp', 'c.tp + c.fp')} AS precision,
  CASE WHEN a.P > 0 THEN a.ap_num / {D('a.P')} END AS average_precision,
  c.tn, c.fp, c.fn, c.tp
FROM c JOIN a ON {join_on})""",
    ]


METRIC_COLS = ["accuracy", "auc", "f1_score", "sensitivity", "specificity", "precision", "average_precision", "tn", "fp", "fn", "tp"]
METRIC_DOUBLES = METRIC_COLS[:7]

SWEEP = f"""th AS (
SELECT CAST(range AS INTEGER) AS i, CAST(0.1 AS DOUBLE) + CAST(range AS DOUBLE) * (CAST(0.11 AS DOUBLE) - CAST(0.1 AS DOUBLE)) AS threshold
FROM range(80)),
sw0 AS (
SELECT th.i, th.threshold,
  COUNT(*) FILTER (WHERE s.risk < th.threshold AND s.label <> 1) AS tn,
  COUNT(*) FILTER (WHERE s.risk >= th.threshold AND s.label <> 1) AS fp,
  COUNT(*) FILTER (WHERE s.risk < th.threshold AND s.label = 1) AS fn,
  COUNT(*) FILTER (WHERE s.risk >= th.threshold AND s.label = 1) AS tp
FROM th CROSS JOIN scored s GROUP BY th.i, th.threshold),
sw1 AS (
SELECT i, threshold, tn, fp, fn, tp,
  {ratio('2 * tp', '2 * tp + fp + fn')} AS f1_score,
  {ratio('tp', 'tp + fn')} AS sensitivity,
  {ratio('tn', 'tn + fp')} AS specificity,
  {ratio('tp', 'tp + fp')} AS precision
FROM sw0),
sweep AS (
SELECT *, sqrt(pow(CAST(1 AS DOUBLE) - sensitivity, 2) + pow(CAST(1 AS DOUBLE) - specificity, 2)) AS balance FROM sw1),
fold AS (
SELECT -1 AS i, CAST(0.5 AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS f1, CAST('inf' AS DOUBLE) AS bal
UNION ALL
SELECT s.i,
  CASE WHEN s.f1_score > f.f1 AND s.balance < f.bal * CAST(1.1 AS DOUBLE) THEN s.threshold ELSE f.t END,
  CASE WHEN s.f1_score > f.f1 AND s.balance < f.bal * CAST(1.1 AS DOUBLE) THEN s.f1_score ELSE f.f1 END,
  CASE WHEN s.f1_score > f.f1 AND s.balance < f.bal * CAST(1.1 AS DOUBLE) THEN s.balance ELSE f.bal END
FROM fold f JOIN sweep s ON s.i = f.i + 1),
best AS (SELECT t AS threshold FROM fold WHERE i = 79)"""

SWEEP_COLS = ["i", "threshold", "tn", "fp", "fn", "tp", "f1_score", "sensitivity", "specificity", "precision", "balance"]

# ---------------------------------------------------------------- grid

GRID_N = 50


def grid_ctes() -> list[str]:
    n = GRID_N
    step_lat = f"((ext.lat_max - ext.lat_min) / CAST({n - 1} AS DOUBLE))"
    step_lon = f"((ext.lon_max - ext.lon_min) / CAST({n - 1} AS DOUBLE))"
    return [
        """sp AS (SELECT key, decimalLatitude AS latitude, decimalLongitude AS longitude FROM species
WHERE decimalLatitude IS NOT NULL AND decimalLongitude IS NOT NULL)""",
        """ext AS (SELECT MIN(latitude) AS lat_min, MAX(latitude) AS lat_max, MIN(longitude) AS lon_min, MAX(longitude) AS lon_max FROM sp)""",
        f"""gp AS (
SELECT CAST(r.range AS BIGINT) AS idx, CAST(r.range // {n} AS INTEGER) AS i, CAST(r.range % {n} AS INTEGER) AS j,
  CASE WHEN r.range % {n} = {n - 1} THEN ext.lat_max ELSE CAST(r.range % {n} AS DOUBLE) * {step_lat} + ext.lat_min END AS latitude,
  CASE WHEN r.range // {n} = {n - 1} THEN ext.lon_max ELSE CAST(r.range // {n} AS DOUBLE) * {step_lon} + ext.lon_min END AS longitude,
  CAST(1 AS INTEGER) AS month
FROM range({n * n}) r CROSS JOIN ext)""",
        f"""gc AS (SELECT *, {cell_cols()} FROM gp)""",
        f"""genv AS (
SELECT g.idx, g.i, g.j, g.latitude, g.longitude, g.month, g.row_id, g.col_id, e.elevation, {", ".join(f"w.{b}" for b in BIO)},
  ({" OR ".join(f"{c} IS NOT NULL" for c in ["e.elevation", *[f"w.{b}" for b in BIO]])}) AS matched,
  sin({angle('g.month')}) AS sin_month, cos({angle('g.month')}) AS cos_month
FROM gc g LEFT JOIN wide w ON g.row_id = w.row_id AND g.col_id = w.col_id
LEFT JOIN elev_cell e ON g.row_id = e.row_id AND g.col_id = e.col_id)""",
        """gfill AS (
SELECT idx, i, j, latitude, longitude, month, row_id, col_id, matched, sin_month, cos_month,
  COALESCE(elevation, CAST(500 AS DOUBLE)) AS elevation, COALESCE(bio1, CAST(1.6 AS DOUBLE)) AS bio1,
  COALESCE(bio4, CAST(35 AS DOUBLE)) AS bio4, COALESCE(bio5, CAST(2.6 AS DOUBLE)) AS bio5,
  COALESCE(bio6, CAST(0.6 AS DOUBLE)) AS bio6, COALESCE(bio12, CAST(750 AS DOUBLE)) AS bio12,
  COALESCE(bio13, CAST(120 AS DOUBLE)) AS bio13, COALESCE(bio14, CAST(20 AS DOUBLE)) AS bio14,
  COALESCE(bio15, CAST(55 AS DOUBLE)) AS bio15
FROM genv)""",
        f"""occ_cell AS (SELECT row_id, col_id, COUNT(*) AS n_occ FROM (SELECT {cell_cols()} FROM sp) WHERE row_id IS NOT NULL AND col_id IS NOT NULL GROUP BY row_id, col_id)""",
        """gs AS (
SELECT g.*, CAST(COALESCE(o.n_occ, 0) AS DOUBLE) / CAST((SELECT MAX(n_occ) FROM occ_cell) AS DOUBLE) AS risk
FROM gfill g LEFT JOIN occ_cell o ON g.row_id = o.row_id AND g.col_id = o.col_id)""",
    ]


GRID = [*BASE, *grid_ctes()]

CATEGORY = """CASE WHEN risk >= 0.9 THEN '⛔ CRITICAL' WHEN risk >= 0.8 THEN '🟥 VERY HIGH' WHEN risk >= 0.6 THEN '🟧 HIGH'
  WHEN risk >= 0.4 THEN '🟨 MODERATE' WHEN risk >= 0.2 THEN '🟩 LOW' ELSE '🟦 VERY LOW' END"""
DESCRIPTION = """CASE WHEN risk >= 0.9 THEN 'Highest invasion probability. Priority intervention required.'
  WHEN risk >= 0.8 THEN 'Optimal conditions for invasion. Immediate management required.'
  WHEN risk >= 0.6 THEN 'Favorable conditions for spread. Early intervention advised.'
  WHEN risk >= 0.4 THEN 'Conditions support establishment. Regular monitoring recommended.'
  WHEN risk >= 0.2 THEN 'Low invasion potential. Monitor for occasional occurrences.'
  ELSE 'Minimal invasion risk. Environmental conditions not favorable.' END"""


# fixed values, written out so that the tables under test are not their own expectation
CELL_COLORS = [
    (0.99, "#660000"), (0.98, "#750000"), (0.97, "#850000"), (0.96, "#940000"), (0.95, "#A30000"), (0.94, "#B20000"),
    (0.93, "#C10000"), (0.92, "#D00000"), (0.91, "#E00000"), (0.90, "#F00000"), (0.89, "#FF0000"), (0.88, "#FF0F0F"),
    (0.87, "#FF1E1E"), (0.86, "#FF2D2D"), (0.85, "#FF3C3C"), (0.84, "#FF4B00"), (0.83, "#FF5500"), (0.82, "#FF6000"),
    (0.81, "#FF6A00"), (0.80, "#FF7500"), (0.78, "#FF8000"), (0.76, "#FF8A00"), (0.74, "#FF9500"), (0.72, "#FF9F00"),
    (0.70, "#FFA500"), (0.68, "#FFB000"), (0.66, "#FFBA00"), (0.64, "#FFC500"), (0.62, "#FFCF00"), (0.60, "#FFD700"),
    (0.58, "#FFE000"), (0.56, "#FFE800"), (0.54, "#FFF000"), (0.52, "#FFF800"), (0.50, "#FFFF00"), (0.48, "#F8FF00"),
    (0.46, "#F0FF00"), (0.44, "#E8FF00"), (0.42, "#E0FF00"), (0.40, "#D8FF00"), (0.38, "#CCFF00"), (0.36, "#BFFF00"),
    (0.34, "#B3FF00"), (0.32, "#A6FF00"), (0.30, "#99FF00"), (0.28, "#80FF00"), (0.26, "#66FF00"), (0.24, "#4DFF00"),
    (0.22, "#33FF00"), (0.20, "#1AFF1A"), (0.18, "#00FF33"), (0.16, "#00FF4D"), (0.14, "#00FF66"), (0.12, "#00FF80"),
    (0.10, "#00FF99"), (0.08, "#00FFB3"), (0.06, "#00FFCC"), (0.04, "#00FFE6"), (0.02, "#00FFFF"),
]
CELL_COLOR_BELOW = "#00E6FF"
LEGEND = "#00E6FF #00FF99 #1AFF1A #99FF00 #D8FF00 #FFFF00 #FFD700 #FFA500 #FF7500 #FF0000 #660000".split()


def color_case() -> str:
    parts = " ".join(f"WHEN risk >= CAST({b!r} AS DOUBLE) THEN '{c}'" for b, c in CELL_COLORS)
    return f"CASE {parts} ELSE '{CELL_COLOR_BELOW}' END"


def legend_case() -> str:
    """Per-channel linear interpolation between the 11 legend stops."""
    seg = "LEAST(GREATEST(CAST(floor(risk * CAST(10 AS DOUBLE)) AS INTEGER), 0), 9)"
    frac = f"LEAST(GREATEST(risk * CAST(10 AS DOUBLE) - CAST({seg} AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"
    chans = []
    for ch in range(3):
        vals = [int(s[1 + 2 * ch : 3 + 2 * ch], 16) for s in LEGEND]
        lo = "[" + ", ".join(map(str, vals)) + f"][{seg} + 1]"
        hi = "[" + ", ".join(map(str, vals)) + f"][{seg} + 2]"
        chans.append(f"CAST(ROUND(CAST({lo} AS DOUBLE) + CAST({hi} - {lo} AS DOUBLE) * {frac}) AS INTEGER)")
    return f"printf('#%02X%02X%02X', {', '.join(chans)})"


def lin(lo: str, hi: str, k: str) -> str:
    return f"CASE WHEN {k} = {GRID_N - 1} THEN {hi} ELSE CAST({k} AS DOUBLE) * (({hi} - {lo}) / CAST({GRID_N - 1} AS DOUBLE)) + {lo} END"


# ---------------------------------------------------------------- statements


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    occ_cols = ["key", "taxonKey", "decimalLatitude", "decimalLongitude", "eventDate", "year", "month", "day", "country"]

    q["occ_scan_project"] = with_(
        [OCCURRENCE, POINTS],
        select_rounded("points", ["key", "latitude", "longitude", "event_date", "year", "month", "day"], ["latitude", "longitude"]),
    )
    q["occ_pages_explode"] = with_([OCCURRENCE], select_rounded("occurrence", occ_cols, ["decimalLatitude", "decimalLongitude"]))
    q["taxon_resolve"] = with_(
        [OCCURRENCE, TAXON],
        "SELECT o.key, o.taxonKey, r.species_key, r.match_type FROM occurrence o JOIN resolved r ON o.taxonKey = r.species_key",
    )
    q["occ_quality_filter"] = with_(
        [OCCURRENCE],
        f"""SELECT key, taxonKey, {R('decimalLatitude')} AS decimalLatitude, {R('decimalLongitude')} AS decimalLongitude, eventDate, country,
  {R('coordinateUncertaintyInMeters')} AS coordinateUncertaintyInMeters
FROM occurrence
WHERE hasCoordinate AND NOT hasGeospatialIssue AND occurrenceStatus = 'PRESENT'
  AND TRY_CAST(substr(split_part(eventDate, '/', 1), 1, 10) AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2024-12-31'
  AND country = 'ZA' AND coordinateUncertaintyInMeters BETWEEN 0 AND 10000""",
    )
    q["occ_count"] = with_(
        [OCCURRENCE, TAXON, SPECIES],
        "SELECT COUNT(*) AS n_global, COUNT(*) FILTER (WHERE country = 'ZA') AS n_local FROM species",
    )
    q["occ_limit_offset"] = with_(
        [OCCURRENCE, TAXON, SPECIES],
        f"""SELECT key, {R('decimalLatitude')} AS decimalLatitude, {R('decimalLongitude')} AS decimalLongitude, eventDate
FROM (SELECT * FROM species ORDER BY key LIMIT 600 OFFSET 300)""",
    )
    q["temporal_features"] = with_(
        [OCCURRENCE, POINTS, temporal_cte("tf", "points")],
        f"SELECT key, month, day_of_year, {R('sin_month')} AS sin_month, {R('cos_month')} AS cos_month FROM tf",
    )
    pc = f"pc AS (SELECT key, latitude, longitude, {cell_cols()} FROM points)"
    q["raster_sample"] = with_(
        [OCCURRENCE, POINTS, RASTER, pc],
        f"""SELECT p.key, 'bio' || CAST(v.var AS VARCHAR) AS var, {R('c.value')} AS value
FROM pc p CROSS JOIN ({_VARS}) v
LEFT JOIN cell_clean c ON c.var = v.var AND c.row_id = p.row_id AND c.col_id = p.col_id""",
    )
    wide_sel = f"""SELECT p.key, {R('p.latitude')} AS latitude, {R('p.longitude')} AS longitude, {", ".join(R('w.' + b) + ' AS ' + b for b in BIO)}
FROM pc p LEFT JOIN wide w ON p.row_id = w.row_id AND p.col_id = w.col_id"""
    q["raster_sample_wide"] = with_([OCCURRENCE, POINTS, RASTER, pc], wide_sel)
    q["raster_dedup_sample"] = q["raster_sample_wide"]
    q["raster_file_sample"] = with_(
        [OCCURRENCE, POINTS, RASTER, pc],
        f"""SELECT p.key, {R('p.latitude')} AS latitude, {R('p.longitude')} AS longitude, {R('w.bio1')} AS bio1, {R('w.bio12')} AS bio12
FROM pc p LEFT JOIN wide w ON p.row_id = w.row_id AND p.col_id = w.col_id""",
    )
    fine_res = "(CAST(0.5 AS DOUBLE) / CAST(60 AS DOUBLE))"
    q["raster_tile_sample"] = with_(
        [
            """cells AS (
SELECT CAST((l_orderkey * 31 + l_suppkey) % 512 + 12345 AS BIGINT) AS row_id, CAST((l_partkey * 7 + l_orderkey) % 512 + 20321 AS BIGINT) AS col_id,
  CAST(MAX(l_quantity) AS FLOAT) AS top, CAST(COUNT(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL)""",
            f"""fp AS (
SELECT o_orderkey AS key, CAST(90 AS DOUBLE) - (CAST((o_orderkey * 31 + o_custkey) % 532 + 12335 AS DOUBLE) + CAST(0.25 AS DOUBLE)) * {fine_res} AS latitude,
  CAST(-180 AS DOUBLE) + (CAST((o_custkey * 7 + o_orderkey) % 532 + 20311 AS DOUBLE) + CAST(0.5 AS DOUBLE)) * {fine_res} AS longitude FROM orders)""",
            f"""fc AS (
SELECT *, CAST(floor((CAST(90 AS DOUBLE) - latitude) / {fine_res}) AS BIGINT) AS row_id,
  CAST(floor((longitude + CAST(180 AS DOUBLE)) / {fine_res}) AS BIGINT) AS col_id FROM fp)""",
        ],
        f"""SELECT p.key, {R('p.latitude')} AS latitude, {R('p.longitude')} AS longitude,
  {R('CASE WHEN (c.row_id + c.col_id) % 23 <> 0 THEN CAST(c.top / 10 AS FLOAT) END')} AS bio1, {R('c.n')} AS bio12
FROM fc p LEFT JOIN cells c USING (row_id, col_id)""",
    )
    shifted = f"""shifted AS (
SELECT key, latitude + CAST(key % 9 AS DOUBLE) * CAST(1e-4 AS DOUBLE) - CAST(4e-4 AS DOUBLE) AS latitude, longitude FROM points)"""
    q["raster_cached_sample"] = with_(
        [
            OCCURRENCE, POINTS, RASTER, shifted,
            "keyed AS (SELECT *, printf('%.3f,%.3f', latitude, longitude) AS k FROM shifted)",
            "firsts AS (SELECT k, arg_min(latitude, key) AS latitude, arg_min(longitude, key) AS longitude FROM keyed GROUP BY k)",
            f"placed AS (SELECT k, {cell_cols()} FROM firsts)",
        ],
        f"""SELECT d.key, {", ".join(R('w.' + b) + ' AS ' + b for b in BIO)}
FROM keyed d JOIN placed p USING (k) LEFT JOIN wide w ON p.row_id = w.row_id AND p.col_id = w.col_id""",
    )
    q["layer_check"] = with_(
        [OCCURRENCE, POINTS, RASTER, pc],
        f"""SELECT 'bio' || CAST(e.range AS VARCHAR) AS layer, COALESCE(c.n, 0) AS n_cells, c.n IS NOT NULL AS present,
  COALESCE(v.pts, 0) AS points_with_value
FROM range(1, 20) e
LEFT JOIN (SELECT var, COUNT(*) AS n FROM raster_cell GROUP BY var) c ON c.var = e.range
LEFT JOIN (SELECT cc.var, COUNT(*) AS pts FROM pc p JOIN cell_clean cc ON cc.row_id = p.row_id AND cc.col_id = p.col_id
           WHERE cc.value IS NOT NULL GROUP BY cc.var) v ON v.var = e.range""",
    )
    q["elevation_lookup"] = with_(
        [OCCURRENCE, POINTS, ELEV, pc],
        f"""SELECT p.key, {R('p.latitude')} AS latitude, {R('p.longitude')} AS longitude,
  {R("CASE WHEN p.latitude BETWEEN -90 AND 90 AND p.longitude BETWEEN -180 AND 180 THEN e.elevation END")} AS elevation,
  CASE WHEN NOT (p.latitude BETWEEN -90 AND 90 AND p.longitude BETWEEN -180 AND 180) THEN 'Invalid coordinates'
       WHEN e.elevation IS NULL THEN 'missing_result' ELSE 'ok' END AS status
FROM pc p LEFT JOIN elev_cell e ON p.row_id = e.row_id AND p.col_id = e.col_id""",
    )
    q["coord_validation"] = with_(
        [REQUESTS],
        f"SELECT pos, {R('latitude')} AS latitude, {R('longitude')} AS longitude, error, error IS NULL AS valid FROM requests_v",
    )
    q["env_extract_batch"] = with_(
        [RASTER, ELEV, REQUESTS, f"rc AS (SELECT *, {cell_cols()} FROM requests_v)"],
        f"""SELECT r.pos, {R('r.latitude')} AS latitude, {R('r.longitude')} AS longitude, {", ".join(R('w.' + b) + ' AS ' + b for b in BIO)},
  {R("CASE WHEN r.error IS NULL THEN e.elevation END")} AS elevation, r.error,
  CASE WHEN r.error IS NOT NULL THEN 'Invalid coordinates' WHEN e.elevation IS NULL THEN 'missing_result' ELSE 'ok' END AS elevation_status
FROM rc r LEFT JOIN wide w ON r.row_id = w.row_id AND r.col_id = w.col_id
LEFT JOIN elev_cell e ON r.row_id = e.row_id AND r.col_id = e.col_id""",
    )
    q["elevation_request_batches"] = with_(
        [REQUESTS],
        """SELECT CAST(floor(pos / 50) AS BIGINT) AS batch, COUNT(*) AS n_points,
  string_agg(CAST(latitude AS VARCHAR) || ',' || CAST(longitude AS VARCHAR), '|' ORDER BY pos) AS locations
FROM requests GROUP BY CAST(floor(pos / 50) AS BIGINT)""",
    )
    fine = "floor((CAST(90 AS DOUBLE) - r.latitude) / CAST(2.5 AS DOUBLE))", "floor((r.longitude + CAST(180 AS DOUBLE)) / CAST(2.5 AS DOUBLE))"
    q["elevation_extract"] = with_(
        [REQUESTS],
        f"""SELECT r.pos, {R('r.latitude')} AS latitude, {R('r.longitude')} AS longitude,
  {R("CASE WHEN r.error IS NULL THEN e.elevation END")} AS elevation, 'srtm30m' AS dataset,
  CASE WHEN r.error IS NOT NULL THEN 'Invalid coordinates' WHEN e.elevation IS NULL THEN 'missing_result' ELSE 'ok' END AS status
FROM requests_v r LEFT JOIN (
  SELECT a.n AS row_id, b.n AS col_id, CAST((a.n * 131 + b.n * 71) % 3000 AS DOUBLE) AS elevation
  FROM (SELECT range AS n FROM range(72)) a CROSS JOIN (SELECT range AS n FROM range(144)) b WHERE (a.n * 144 + b.n) % 29 <> 0
) e ON e.row_id = {fine[0]} AND e.col_id = {fine[1]}""",
    )
    q["elevation_tile_lookup"] = q["elevation_extract"].replace(" 'srtm30m' AS dataset,", "")
    q["occ_page_sequence"] = with_(
        [
            REQUESTS,
            "placed AS (SELECT *, pos % 7 AS series, CAST(floor(floor(pos / 7) / 20) AS BIGINT) AS idx FROM requests)",
            """pages AS (
SELECT *, least(20, least(total, 300) - idx * 20) AS asked, (series * 31 + idx * 7) % 37 = 11 AS failed,
  held - CASE WHEN (series * 31 + idx * 7) % 23 = 17 THEN 3 ELSE 0 END AS n
FROM (SELECT series, idx, COUNT(*) AS held FROM placed GROUP BY ALL) JOIN (SELECT series, COUNT(*) AS total FROM placed GROUP BY ALL) USING (series)
WHERE (series * 13 + idx) % 29 <> 5 AND least(total, 300) > idx * 20)""",
            """stops AS (
SELECT series, MIN(i) AS stop FROM (SELECT DISTINCT series FROM pages) s, range(0, 20) r(i)
WHERE NOT EXISTS (FROM pages p WHERE p.series = s.series AND p.idx = i AND NOT p.failed AND p.n >= p.asked) GROUP BY series)""",
            "nth AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, idx ORDER BY pos) - 1 AS nth FROM placed)",
        ],
        f"""SELECT series, idx * 20 AS "offset", CAST(nth AS INTEGER) AS nth, pos, {R('latitude')} AS latitude, {R('longitude')} AS longitude
FROM nth JOIN pages p USING (series, idx) JOIN stops USING (series) WHERE idx <= stop AND NOT failed AND nth < least(n, asked)""",
    )
    q["grid_attach_replies"] = f"""WITH g AS (
SELECT c_custkey AS idx, CAST((c_custkey * 7919) % 180 - 90 AS DOUBLE) AS latitude, CAST((c_custkey * 17) % 36 * 10 - 180 AS DOUBLE) AS longitude FROM customer),
r AS (
SELECT o_orderkey AS arrival, CAST((o_custkey * 7919) % 180 - 90 AS DOUBLE) AS latitude,
  CASE WHEN o_orderkey % 43 <> 0 THEN CAST((o_custkey * 31) % 36 * 10 - 180 AS DOUBLE) END AS longitude,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST((o_orderkey * 37) % 3000 AS DOUBLE) END AS elevation,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST((o_orderkey * 11) % 400 AS DOUBLE) END AS bio1 FROM orders),
v AS (
SELECT latitude, longitude, arg_max(elevation, arrival) FILTER (WHERE elevation IS NOT NULL) AS elevation,
  arg_max(bio1, arrival) FILTER (WHERE bio1 IS NOT NULL) AS bio1 FROM r WHERE longitude IS NOT NULL GROUP BY ALL)
SELECT g.idx, {R('g.latitude')} AS latitude, {R('g.longitude')} AS longitude, {R('v.elevation')} AS elevation, {R('v.bio1')} AS bio1, v.latitude IS NOT NULL AS matched
FROM g LEFT JOIN (SELECT latitude, longitude, MAX(idx) AS idx FROM g GROUP BY ALL) o ON o.idx = g.idx
LEFT JOIN v ON v.latitude = o.latitude AND v.longitude = o.longitude"""
    q["request_formats"] = with_(
        [REQUESTS],
        f"""SELECT pos, printf('%.3f,%.3f', latitude, longitude) AS coordinate_key,
  {R("CASE WHEN pos % 3 = 0 THEN 0 WHEN pos % 5 = 0 THEN longitude ELSE latitude END")} AS first_value,
  {R("CASE WHEN pos % 3 = 0 OR pos % 5 = 0 OR latitude = 0 THEN NULLIF(longitude, 0) ELSE latitude END")} AS first_nonzero,
  'bio1|4|' || CAST(pos % 19 + 1 AS VARCHAR) AS variables FROM requests""",
    )
    q["elevation_replies"] = with_(
        [
            REQUESTS,
            """rb AS (SELECT *, CAST(floor(pos / 50) AS BIGINT) AS batch FROM requests)""",
            """rn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY batch ORDER BY pos) AS nth, COUNT(*) OVER (PARTITION BY batch) AS n FROM rb)""",
            """ra AS (SELECT *, batch % 7 <> 3 AND NOT (batch % 5 = 2 AND nth > n - 3) AS answered FROM rn)""",
        ],
        f"""SELECT batch, pos,
  {R("CASE WHEN answered AND pos % 11 <> 0 THEN latitude + CAST(0.25 AS DOUBLE) ELSE latitude END")} AS latitude,
  {R("CASE WHEN answered AND pos % 11 <> 0 THEN longitude - CAST(0.25 AS DOUBLE) ELSE longitude END")} AS longitude,
  CASE WHEN answered THEN CAST((pos * 37) % 3000 AS DOUBLE) END AS elevation,
  CASE WHEN answered THEN CASE WHEN pos % 13 <> 0 THEN 'aster30m' ELSE 'srtm30m' END END AS dataset,
  CASE WHEN answered THEN 'ok' ELSE 'missing_result' END AS status FROM ra""",
    )
    half_deg = "floor((CAST(90 AS DOUBLE) - p.latitude) / CAST(0.5 AS DOUBLE))", "floor((p.longitude + CAST(180 AS DOUBLE)) / CAST(0.5 AS DOUBLE))"
    q["raster_sample_shuffle"] = with_(
        [OCCURRENCE, POINTS],
        f"""SELECT p.key, {R('p.latitude')} AS latitude, {R('p.longitude')} AS longitude, c.n_lines, c.top_quantity
FROM points p LEFT JOIN (
  SELECT l_orderkey % 360 AS row_id, (l_partkey * 7 + l_suppkey) % 720 AS col_id, COUNT(*) AS n_lines, CAST(MAX(l_quantity) AS DOUBLE) AS top_quantity
  FROM lineitem GROUP BY 1, 2
) c ON c.row_id = {half_deg[0]} AND c.col_id = {half_deg[1]}""",
    )
    text = lambda c: f"CAST({c} AS VARCHAR) AS {c}" if c in ("month", "day_of_year", "key") else f"CASE WHEN {c} IS NOT NULL THEN printf('%.6f', ROUND({c}, 6) + CAST(0 AS DOUBLE)) END AS {c}"
    q["ml_ready_csv_text"] = with_([*BASE, *ML_GLOBAL], "SELECT " + ", ".join(text(c) for c in ["key", *ML_COLS]) + " FROM mlg")
    ml_out = ["key", *ML_COLS]
    q["ml_ready_global"] = with_([*BASE, *ML_GLOBAL], select_rounded("mlg", ml_out, ML_DOUBLES))
    q["ml_ready_local"] = with_([*BASE, *ML_LOCAL], select_rounded("mll", ml_out, ML_DOUBLES))
    q["holdout_global"] = with_(
        [*BASE, *ML_GLOBAL, *ML_LOCAL],
        select_rounded("(SELECT * FROM mlg WHERE key NOT IN (SELECT key FROM mll))", ml_out, ML_DOUBLES),
    )
    q["presence_default"] = with_(
        [*BASE, *ML_LOCAL],
        select_rounded("(SELECT *, CAST(1 AS INTEGER) AS presence FROM mll)", [*ml_out, "presence"], ML_DOUBLES),
    )
    bal = lambda name, src: f"""SELECT '{name}' AS dataset, COUNT(*) AS n_rows, CAST(COALESCE(SUM(presence), 0) AS BIGINT) AS n_presence,
  COUNT(*) - CAST(COALESCE(SUM(presence), 0) AS BIGINT) AS n_background,
  COALESCE(BOOL_OR(presence = 1), FALSE) AS has_presence, COALESCE(BOOL_OR(presence = 0), FALSE) AS has_background FROM {src}"""  # noqa: E731
    q["class_balance"] = with_(TRAINING, bal("train", "train_set") + "\nUNION ALL\n" + bal("validation", "val_set"))
    q["label_class_balance"] = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS label_name, COUNT(*) AS n_rows, CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS n_presence,
  COUNT(*) - CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS n_background,
  COALESCE(BOOL_OR({c} = 1), FALSE) AS has_presence, COALESCE(BOOL_OR({c} = 0), FALSE) AS has_background FROM labels"""
        for c in ("quality", "toxic")
    )
    q["background_points"] = with_(TRAINING, select_rounded("train_set", ["key", "presence", *ML_COLS], ML_DOUBLES))
    q["split_80_20"] = with_(
        [*BASE, *ML_GLOBAL],
        f"SELECT key, CASE WHEN {hash_order('key', 7919)} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM mlg",
    )
    q["folds"] = with_(
        TRAINING, f"SELECT key, presence, CAST(({hash_order('key', 104729)} + presence) % 3 AS INTEGER) AS fold FROM train_set"
    )
    q["stratified_folds"] = with_(
        TRAINING,
        f"""SELECT key, presence, CAST((ROW_NUMBER() OVER (PARTITION BY presence ORDER BY {hash_order('key', 104729)}, key) - 1) % 3 AS INTEGER) AS fold
FROM train_set""",
    )
    sub_cols = f"key, presence, {R('latitude')} AS latitude, {R('longitude')} AS longitude"
    q["subsample"] = with_(
        TRAINING,
        f"""SELECT 'train' AS dataset, {sub_cols} FROM (SELECT * FROM train_set ORDER BY {hash_order('key', 7919)}, key, presence LIMIT 1000)
UNION ALL
SELECT 'validation' AS dataset, {sub_cols} FROM (SELECT * FROM val_set ORDER BY {hash_order('key', 7919)}, key, presence LIMIT 250)""",
    )

    # metrics
    half = "CAST(0.5 AS DOUBLE)"
    q["confusion_at_threshold"] = with_(
        [SCORED],
        f"""SELECT COUNT(*) FILTER (WHERE risk < {half} AND label <> 1) AS tn, COUNT(*) FILTER (WHERE risk >= {half} AND label <> 1) AS fp,
  COUNT(*) FILTER (WHERE risk < {half} AND label = 1) AS fn, COUNT(*) FILTER (WHERE risk >= {half} AND label = 1) AS tp FROM scored""",
    )
    q["standard_metrics"] = with_([SCORED, *metric_ctes("scored", half)], select_rounded("m", METRIC_COLS, METRIC_DOUBLES))
    q["roc_auc"] = with_([SCORED, *metric_ctes("scored", half)], f"SELECT {R('auc')} AS auc FROM m")
    q["average_precision"] = with_(
        [SCORED, *metric_ctes("scored", half)], f"SELECT {R('average_precision')} AS average_precision FROM m"
    )
    q["roc_points"] = with_(
        [SCORED, *metric_ctes("scored", half)],
        f"""SELECT {R('risk')} AS threshold, {R(f"{D('fp_cum')} / {D('(SELECT N FROM a)')}")} AS fpr,
  {R(f"{D('tp_cum')} / {D('(SELECT P FROM a)')}")} AS tpr FROM cum""",
    )
    q["threshold_sweep"] = with_([SCORED, SWEEP], select_rounded("sweep", SWEEP_COLS, ["threshold", "f1_score", "sensitivity", "specificity", "precision", "balance"]))
    q["optimal_threshold"] = with_(
        [SCORED, SWEEP, *metric_ctes("scored", "(SELECT threshold FROM best)")],
        select_rounded("(SELECT (SELECT threshold FROM best) AS threshold, * FROM m)", ["threshold", *METRIC_COLS], ["threshold", *METRIC_DOUBLES]),
    )
    cr = f"""cc AS (SELECT COUNT(*) FILTER (WHERE risk < {half} AND label <> 1) AS tn, COUNT(*) FILTER (WHERE risk >= {half} AND label <> 1) AS fp,
  COUNT(*) FILTER (WHERE risk < {half} AND label = 1) AS fn, COUNT(*) FILTER (WHERE risk >= {half} AND label = 1) AS tp FROM scored),
k AS (SELECT tn, fp, fn, tp, tn + fp + fn + tp AS n,
  {ratio('tn', 'tn + fn')} AS p0, {ratio('tn', 'tn + fp')} AS r0, {ratio('2 * tn', '2 * tn + fn + fp')} AS f0, tn + fp AS s0,
  {ratio('tp', 'tp + fp')} AS p1, {ratio('tp', 'tp + fn')} AS r1, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS s1,
  {ratio('tp + tn', 'tn + fp + fn + tp')} AS acc FROM cc)"""
    w = lambda a, b: ratio(f"{a} * s0 + {b} * s1", "n")
    q["classification_report"] = with_(
        [SCORED, cr],
        f"""SELECT label, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1_score')} AS f1_score, CAST(support AS BIGINT) AS support FROM (
SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM k
UNION ALL SELECT '1', p1, r1, f1, s1 FROM k
UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM k
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM k
UNION ALL SELECT 'weighted avg', {w('p0', 'p1')}, {w('r0', 'r1')}, {w('f0', 'f1')}, n FROM k)""",
    )
    score = " + ".join(
        f"CAST({wt} AS DOUBLE) * {c}"
        for c, wt in [("auc", 0.25), ("f1_score", 0.25), ("accuracy", 0.15), ("specificity", 0.15), ("sensitivity", 0.10), ("average_precision", 0.10)]
    )
    q["model_scores"] = with_(
        [PREDICTION_LOG, *metric_ctes("plog", half, ["model"]), f"ms AS (SELECT *, 0 + {score} AS score FROM m)"],
        f"""SELECT model, {", ".join(R(c) + " AS " + c for c in ["auc", "f1_score", "accuracy", "specificity", "sensitivity", "average_precision", "score"])},
  score = MAX(score) OVER () AS is_best, CAST(DENSE_RANK() OVER (ORDER BY score DESC) AS INTEGER) AS rank FROM ms""",
    )
    fold = f"CAST(({hash_order('key', 104729)} + label) % 3 AS INTEGER) AS fold"
    q["fold_mean_auc"] = with_(
        [PREDICTION_LOG, f"pf AS (SELECT *, {fold} FROM plog)", *metric_ctes("pf", half, ["model", "fold"])],
        f"SELECT model, COUNT(auc) AS n_folds, {R('AVG(auc)')} AS mean_auc FROM m GROUP BY model",
    )
    split = f"{hash_order('key', 7919)} % 100 < 80"
    correct = f"(CASE WHEN risk >= {half} THEN 1 ELSE 0 END) = label"
    q["transfer_gap"] = with_(
        [PREDICTION_LOG],
        f"""SELECT model, {R('ta')} AS train_accuracy, {R('va')} AS validation_accuracy, {R('ta - va')} AS gap FROM (
SELECT model, {ratio(f"COUNT(*) FILTER (WHERE {split} AND {correct})", f"COUNT(*) FILTER (WHERE {split})")} AS ta,
  {ratio(f"COUNT(*) FILTER (WHERE NOT ({split}) AND {correct})", f"COUNT(*) FILTER (WHERE NOT ({split}))")} AS va
FROM plog GROUP BY model)""",
    )

    # grid and risk analytics
    q["grid_points"] = with_(GRID, select_rounded("gp", ["idx", "i", "j", "latitude", "longitude", "month"], ["latitude", "longitude"]))
    q["grid_enriched"] = with_(
        GRID,
        select_rounded(
            "gfill",
            ["idx", "latitude", "longitude", "elevation", *BIO, "matched", "sin_month", "cos_month"],
            ["latitude", "longitude", "elevation", *BIO, "sin_month", "cos_month"],
        ),
    )
    env = ["elevation", *BIO]
    q["null_profile"] = with_(
        GRID, "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM genv" for c in env)
    )
    q["match_coverage"] = with_(GRID, "SELECT COUNT(*) FILTER (WHERE matched) AS points_filled, COUNT(*) AS points_total FROM genv")
    q["risk_summary"] = with_(
        GRID,
        f"""SELECT {R('AVG(risk)')} AS mean_risk, {R('MAX(risk)')} AS max_risk, {R('MIN(risk)')} AS min_risk,
  COUNT(*) FILTER (WHERE risk > 0.7) AS high_risk_points, COUNT(*) FILTER (WHERE risk > 0.4 AND risk <= 0.7) AS medium_risk_points,
  COUNT(*) FILTER (WHERE risk <= 0.4) AS low_risk_points, strftime(make_date(2000, 1, 1), '%B') AS month_name FROM gs""",
    )
    bands = {
        "very_low": "risk < 0.2",
        "low": "risk >= 0.2 AND risk < 0.4",
        "moderate": "risk >= 0.4 AND risk < 0.6",
        "high": "risk >= 0.6 AND risk < 0.8",
        "very_high": "risk >= 0.8",
        "critical": "risk >= 0.9",
    }
    q["risk_distribution"] = with_(
        GRID,
        f"""SELECT total_points, {", ".join(bands)}, {", ".join(R(f"CAST(printf('%.1f', CAST({b} AS DOUBLE) / CAST(total_points AS DOUBLE) * CAST(100 AS DOUBLE)) AS DOUBLE)") + f" AS {b}_pct" for b in bands)}
FROM (SELECT COUNT(*) AS total_points, {", ".join(f"COUNT(*) FILTER (WHERE {c}) AS {b}" for b, c in bands.items())} FROM gs)""",
    )
    stats = ["mean", "max", "min", "std", "median"]
    q["risk_stats"] = with_(
        GRID,
        f"""SELECT {", ".join(R(s) + " AS " + s for s in stats)}, {", ".join(R(f"CAST(printf('%.1f', {s} * CAST(100 AS DOUBLE)) AS DOUBLE)") + f" AS {s}_pct" for s in stats)}
FROM (SELECT AVG(risk) AS mean, MAX(risk) AS max, MIN(risk) AS min, STDDEV_POP(risk) AS std, MEDIAN(risk) AS median FROM gs)""",
    )
    q["risk_category"] = with_(
        GRID, f"SELECT idx, {R('risk')} AS risk, {CATEGORY} AS risk_category, {DESCRIPTION} AS risk_description FROM gs"
    )
    q["risk_color"] = with_(GRID, f"SELECT idx, {R('risk')} AS risk, {color_case()} AS risk_color, {legend_case()} AS legend_color FROM gs")
    q["hotspots_top5"] = with_(
        GRID,
        f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY risk DESC, idx DESC) AS INTEGER) AS rank, idx, {R('latitude')} AS latitude,
  {R('longitude')} AS longitude, {R('risk')} AS risk,
  CASE WHEN risk >= 0.9 THEN 'darkred' WHEN risk >= 0.8 THEN 'red' ELSE 'orange' END AS icon_color,
  CASE WHEN risk >= 0.9 THEN 'CRITICAL' WHEN risk >= 0.8 THEN 'VERY HIGH' ELSE 'HIGH' END AS level
FROM (SELECT * FROM gs ORDER BY risk DESC, idx DESC LIMIT 5)""",
    )
    q["grid_extent"] = with_(
        GRID,
        f"""SELECT {R('lat_min')} AS lat_min, {R('lat_max')} AS lat_max, {R('lon_min')} AS lon_min, {R('lon_max')} AS lon_max,
  {R('(lat_min + lat_max) / 2')} AS center_lat, {R('(lon_min + lon_max) / 2')} AS center_lon
FROM (SELECT MIN(latitude) AS lat_min, MAX(latitude) AS lat_max, MIN(longitude) AS lon_min, MAX(longitude) AS lon_max FROM gp)""",
    )
    lat_j = lin("ext.lat_min", "ext.lat_max", "g.j")
    lat_j1 = lin("ext.lat_min", "ext.lat_max", "(g.j + 1)")
    lon_i = lin("ext.lon_min", "ext.lon_max", "g.i")
    lon_i1 = lin("ext.lon_min", "ext.lon_max", "(g.i + 1)")
    corners = [(lat_j, lon_i), (lat_j1, lon_i), (lat_j1, lon_i1), (lat_j, lon_i1)]
    q["grid_cells_geojson"] = with_(
        GRID,
        f"""SELECT g.idx, g.i, g.j, {R('g.risk')} AS risk, printf('%.2f%%', g.risk * CAST(100 AS DOUBLE)) AS risk_percent,
  {CATEGORY.replace("risk", "g.risk")} AS risk_category, {R(lat_j)} AS lat, {R(lon_i)} AS lon,
  {", ".join(R(a) + f" AS c{k}_lat" for k, (a, _) in enumerate(corners, 1))},
  {", ".join(R(b) + f" AS c{k}_lon" for k, (_, b) in enumerate(corners, 1))}
FROM gs g CROSS JOIN ext WHERE g.i < {GRID_N - 1} AND g.j < {GRID_N - 1}""",
    )

    q["geojson_text_parsed"] = with_(
        GRID,
        f"""SELECT 'Feature' AS feature_type, 'Polygon' AS geometry_type, 5 AS n_ring, {R('g.risk')} AS risk,
  printf('%.2f%%', g.risk * CAST(100 AS DOUBLE)) AS risk_percent, {CATEGORY.replace("risk", "g.risk")} AS risk_category,
  {R(lat_j)} AS link_lat, {R(lon_i)} AS link_lon,
  {", ".join(R(a) + f" AS p{k}_lat" for k, (a, _) in enumerate([*corners, corners[0]]))},
  {", ".join(R(b) + f" AS p{k}_lon" for k, (_, b) in enumerate([*corners, corners[0]]))}
FROM gs g CROSS JOIN ext WHERE g.i < {GRID_N - 1} AND g.j < {GRID_N - 1}""",
    )

    # documented feature set
    pairs = [("bio1", "bio12"), ("bio1", "bio13"), ("bio6", "bio14"), ("bio5", "bio6"), ("bio13", "bio15"), ("bio14", "bio15")]
    q["enhanced_features"] = with_(
        [*BASE, *ML_GLOBAL, "med AS (SELECT MEDIAN(latitude) AS mlat, MEDIAN(longitude) AS mlon FROM mlg)"],
        f"""SELECT key, {", ".join(R(f"{a} * {b}") + f" AS {a}_x_{b}" for a, b in pairs)},
  {R('bio1 * bio12')} AS temp_precip,
  {R("CASE WHEN bio1 + CAST(10 AS DOUBLE) = 0 THEN NULL ELSE bio12 / (bio1 + CAST(10 AS DOUBLE)) END")} AS aridity,
  {R('elevation * bio1')} AS elev_temp,
  {R("CASE WHEN bio14 = 0 THEN NULL ELSE bio13 / bio14 END")} AS precip_seasonality_ratio,
  {R('sqrt(pow(latitude - med.mlat, 2) + pow(longitude - med.mlon, 2))')} AS dist_from_median
FROM mlg CROSS JOIN med""",
    )
    return q
