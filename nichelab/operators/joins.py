"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], salt: int = 1) -> DataFrame:
    """``left LEFT JOIN right USING keys`` as a shuffle join, without a job at build time.

    In batch, adaptive execution splits the partition of a hot key on the left
    and reads the right side's part once per split, so ``salt`` stays 1.  Where
    it does not run (streams), ``salt`` spreads each key over so many tasks and
    repeats the right side as often.
    """
    if salt <= 1:
        return left.join(right, keys, "left")
    columns = [*keys, *[c for c in (*left.columns, *right.columns) if c not in keys]]
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salt)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return spread.join(copies, [*keys, "_salt"], "left").select(*columns)
