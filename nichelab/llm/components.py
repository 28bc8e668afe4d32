"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelab.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b.  Returns node and comp (smallest node it is connected with), for nodes that have an edge.

    Every step is a minimum per node (combined before the shuffle) and a join
    with it; only counts come to the driver.  The result of each step is a table
    in the shared folder.  The number of steps grows with the logarithm of the
    longest path.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = stage(e, "edges")
    while True:
        # large star: all larger neighbours of a node go to the smallest of its neighbourhood
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(first, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = stage(moved.unionAll(first.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        n, nodes = e.agg(F.count(F.lit(1)), F.count_distinct("hi")).first()
        if n == nodes and e.join(e.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionAll(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct()
    )
