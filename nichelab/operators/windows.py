"""Running totals and exact order statistics without a single-task window.

``Window.orderBy(x)`` without ``partitionBy`` moves every row to one task;
a hot group in ``partitionBy(g)`` does the same for that group.  Here the
order key is cut into value ranges at approximate quantiles (a bounded list
of boundaries on the driver), each (group, range) is a separate window
partition, and the totals of earlier ranges -- a table of groups x ranges
rows -- are added back.  The result is exact; the boundaries only decide
how evenly the work is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket_expr(col: Column, bounds: list[float]) -> Column:
    """Number of ``bounds`` that are <= col.

    ``width_bucket`` over the sorted bounds would need equal widths, so the bounds
    are one array constant, searched by halving: the expression is as long as the
    logarithm of the number of bounds, not as long as the list.
    """
    array = F.expr("cast(split('" + ",".join(repr(float(b)) for b in bounds) + "', ',') as array<double>)")
    value, at = col.cast("double"), F.lit(0)
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        # move on by ``step`` where the bound there still is <= the value
        ahead = F.get(array, at + F.lit(step - 1))
        at = at + F.when(ahead <= value, F.lit(step)).otherwise(F.lit(0))
        step //= 2
    return at.cast("int")


def range_buckets(df: DataFrame, order_col: str, buckets: int | None = None) -> Column:
    """Bucket column over ``order_col`` with about equal row counts per bucket."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n <= 1:
        return F.lit(0)
    probs = [i / n for i in range(1, n)]
    bounds = sorted({b for b in df.approxQuantile(order_col, probs, 1.0 / (4 * n)) if b == b})
    if not bounds:
        return F.lit(0)
    return _bucket_expr(F.col(order_col), bounds)


def running_totals(
    df: DataFrame,
    order_col: str,
    sum_cols: list[str],
    by: list[str] | tuple[str, ...] = (),
    ascending: bool = True,
    inclusive: bool = True,
    buckets: int | None = None,
    prefix: str = "cum_",
    bounds: list[float] | None = None,
) -> DataFrame:
    """Add ``cum_<c>``: the total of ``c`` over rows of the same ``by`` group
    that come before this row in ``order_col`` order (and this row, when
    ``inclusive``).  Rows must be unique per (by, order_col), e.g. the output
    of ``groupBy(*by, order_col)``.  ``bounds`` cut the order where its
    distribution is known; otherwise they are quantiles, found by a job.
    """
    by = list(by)
    bucket = range_buckets(df, order_col, buckets) if bounds is None else _bucket_expr(F.col(order_col), bounds) if bounds else F.lit(0)
    d = df.withColumn("_bkt", bucket)
    bkt_order = F.col("_bkt").asc() if ascending else F.col("_bkt").desc()
    totals = d.groupBy(*by, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*by).orderBy(bkt_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bkt", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols]
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per bucket: bounded by the bucket count
    key_order = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    local = Window.partitionBy(*by, "_bkt").orderBy(key_order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    joined = d.join(offsets, [*by, "_bkt"], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0))).alias(f"{prefix}{c}")
            for c in sum_cols
        ],
    )


def exact_median(df: DataFrame, col: str, by: list[str] | tuple[str, ...] = (), alias: str | None = None) -> DataFrame:
    """Exact median per group (mean of the two middle values for even counts).

    Values are counted per distinct value, ranked with ``running_totals``,
    and the one or two middle ranks are picked; no group is gathered in one
    task or on the driver.
    """
    vals = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col)))
    counts = vals.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    return exact_median_of_counts(counts, col, by, alias)


def exact_median_of_counts(counts: DataFrame, col: str, by: list[str] | tuple[str, ...] = (), alias: str | None = None) -> DataFrame:
    """``exact_median`` of values that are already counted (``_n`` rows per group and value)."""
    by = list(by)
    name = alias or f"median_{col}"
    ranked = running_totals(counts, col, ["_n"], by=by)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    if by:
        r = ranked.join(sizes, by, "inner")
    else:  # one number: a scalar subquery, not a join
        r = ranked.withColumn("_total", sizes.scalar())
    lo_rank = F.floor((F.col("_total") + 1) / 2)
    hi_rank = F.floor(F.col("_total") / 2) + 1
    start = F.col("cum__n") - F.col("_n")
    holds = lambda k: (start < k) & (k <= F.col("cum__n"))
    picked = r.filter(holds(lo_rank) | holds(hi_rank))
    agg = picked.groupBy(*by).agg(
        F.max(F.when(holds(lo_rank), F.col(col))).alias("_lo"),
        F.max(F.when(holds(hi_rank), F.col(col))).alias("_hi"),
    )
    return agg.select(*by, ((F.col("_lo") + F.col("_hi")) / F.lit(2.0)).alias(name))
