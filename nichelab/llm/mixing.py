"""Mixing sources to target weights: a time-varying curriculum over training positions.

Every source has a weight schedule ``w(t) = W * (1 + slope * (1 - 2 t))`` over the
run ``t`` in [0, 1]; its integral over the whole run is the weight ``W``, and
``slope`` says whether the source is shown rather early (> 0) or late (< 0).
The integral up to ``t`` is the source's cumulative demand for words.  Laying a
source's documents end to end (pass after pass, each in the same hashed order)
and inverting that demand gives each copy of a document its training position;
``training_stream`` range-sorts the copies by it.

Word budgets: the mix takes ``share`` times all words.  Weights are applied to
the budget, a source stops at ``max_repeat`` times its own words, and what it
cannot take is reshared among the others by weight until none is above.

Edge cases: a null text has size 0 and takes 0 words; a null source is a source
of its own, the last in order; a null doc_id is ordered as an empty id; rows
that repeat a doc_id are separate rows; rows that tie in the order go by size and a hash of the text;
texts of any length are counted whole; an empty table gives an empty result;
columns but doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichelab.llm.common import TOKEN, shuffle_partitions, stage

WEIGHTS = (5, 2, 1)
SLOPES = (0.5, 0.0, -0.5)
SHARE = 1.5
MAX_REPEAT = 2
#: Hex digits of the order hash that cut a source into pieces: 16 ** 3 pieces, so that no task gets a whole source.
PIECE_DIGITS = 3


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source key, number of white-space words, order hash and text hash of every row."""
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order_hash"),
        F.xxhash64("text").alias("tag"),
    )


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """One row per source with its words and its rank by code point, null last.

    The rank is the row's place in a range-sorted table plus the rows of the
    ranges before it, so that no task sorts all sources.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    at = stage(
        per.repartitionByRange(shuffle_partitions(spark), "no_source", "source")
        .sortWithinPartitions("no_source", "source")
        .withColumn("at", F.monotonically_increasing_id()),
        "sources",
    )
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranges = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    starts = ranges.select("part", before.alias("start"))
    return at.withColumn("part", part).join(starts, "part").select("no_source", "source", "source_size", (F.col("start") + row).alias("rank"))


def pick(values: tuple, rank: Column) -> Column:
    """``values`` repeated along the ranks."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds weight, slope and target words: ``min(max_repeat * size, rate * weight)`` with targets summing to the budget.

    Each round takes the sources above their limit out and reshares the rest of
    the budget; a round is one aggregate over the sources, of which two numbers
    come to the driver.
    """
    cap = F.col("source_size") * F.lit(float(max_repeat))
    src = stage(sources.withColumn("weight", pick(tuple(float(w) for w in weights), F.col("rank"))).withColumn("cap", cap), "targets")
    budget = share * float(src.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0])
    rate, capped = None, -1
    while True:
        full = F.lit(False) if rate is None else F.col("cap") <= F.lit(rate) * F.col("weight")
        row = src.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["n"] == capped:
            break
        capped = row["n"]
        if row["open"] <= 0:
            rate = rate or 0.0
            break
        rate = (budget - row["taken"]) / row["open"]
    return src.select(
        "no_source", "source", "source_size", "rank", "weight", F.least(F.col("cap"), F.lit(float(rate)) * F.col("weight")).alias("target")
    )


def position(x: Column, slope: Column) -> Column:
    """The time ``t`` at which a source has been asked for the share ``x`` of its words: inverse of ``t + slope * (t - t * t)``."""
    a = F.lit(1.0) + slope
    return F.lit(2.0) * x / (a + F.sqrt(F.greatest(a * a - F.lit(4.0) * slope * x, F.lit(0.0))))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per input row: size, its source's words and target, the words taken, and the position of its first copy.

    Whole passes over a source come first; in the last pass documents are
    taken in order until the target is met (the one at the border in part).
    ``before`` is where a document starts in its source's order.
    """
    sizes = stage(word_sizes(docs), "sizes")
    targets = source_targets(ranked_sources(sizes), weights, share, max_repeat)
    key = ["no_source", "source"]
    piece = F.substring("order_hash", 1, PIECE_DIGITS)
    pieces = sizes.groupBy(*key, piece.alias("piece")).agg(F.sum("size").alias("words"))
    start = F.coalesce(F.sum("words").over(W.partitionBy(*key).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.join(targets, key).select(*key, "piece", start.alias("start"), "source_size", "target", "rank")
    inside = W.partitionBy(*key, "piece").orderBy("order_hash", "size", "tag").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        sizes.withColumn("piece", piece)
        .join(offsets, [*key, "piece"])
        .withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )
    asked = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    size, total = F.col("size"), F.col("source_size")
    passes = F.when(total > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = asked - F.col("passes") * total
    first = F.when(F.col("taken") > 0, position(F.least(F.col("before") / F.col("target"), F.lit(1.0)), pick(slopes, F.col("rank"))))
    return (
        placed.withColumn("passes", passes)
        .withColumn("taken", F.col("passes") * size + F.least(F.greatest(rest - F.col("before"), F.lit(0)), size))
        .withColumn("position", F.round(first, 9))
        .select("doc_id", "tag", "source", "no_source", "rank", "size", "source_size", "target", "before", "passes", "taken", "position")
    )


def training_stream(mixed: DataFrame, slopes: tuple = SLOPES) -> DataFrame:
    """Every copy of a document that the mix takes, range-sorted by training position: doc_id, copy, words, position."""
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    words = F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(F.col("taken") - F.col("passes") * F.col("size"))
    x = (F.col("copy") * F.col("source_size") + F.col("before")) / F.col("target")
    return (
        copies.withColumn("words", words)
        .filter(F.col("words") > 0)
        .select("doc_id", "copy", "words", F.round(position(F.least(x, F.lit(1.0)), pick(slopes, F.col("rank"))), 9).alias("position"))
        .orderBy("position", "doc_id", "copy")
    )


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    from nichelab.llm.common import table

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", F.round("position", 6).alias("position")).orderBy(
        F.col("position").asc_nulls_last(), "doc_id"
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS order_hash FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
c AS (
  SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS w, [0.5, 0.0, -0.5][rank % 3 + 1]::DOUBLE AS slope, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, rank) AS k,
         coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER (ORDER BY cap / w DESC, rank DESC) AS w_from FROM c),
r AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - cap_before) / w_from AS rate FROM o),
t AS (
  SELECT source, source_size, slope, least(cap, w * (SELECT rate FROM r WHERE rate <= cap / w ORDER BY k LIMIT 1)) AS target FROM r),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.order_hash, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         floor(t.target + 0.5)::BIGINT AS asked
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN asked // source_size ELSE 0 END AS passes FROM p),
u AS (
  SELECT *, (passes * size + least(greatest(asked - passes * source_size - before, 0), size))::BIGINT AS taken FROM q)
SELECT doc_id, size, source_size, round(target, 4) AS target, taken,
       CASE WHEN taken > 0 THEN round(round(2 * least(before / target, 1.0) /
         ((1 + slope) + sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * least(before / target, 1.0), 0.0))), 9), 6) END AS position
FROM u
"""
