"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs`` as they came, extra ones
included.  ``run`` writes every stage's result as Parquet in the shared folder
and reads it again for the next.

Rows are told apart by doc_id and text.  Rows that repeat both are exact copies,
of which one stays; a null doc_id is an ordinary value (the largest, where order
matters to near copies).  An empty table passes through empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichelab.llm import decontaminate, exact, jaccard, langid, mixing
from nichelab.llm.common import ascii_lower, stage, table


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column beside their keys, so that no name in ``docs`` can clash."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("key_tag"))


def _same(tag: str = "key_tag") -> Column:
    return F.col("d.key_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{tag}") == F.col("k.tag"))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters go, and those that all training text together explains better than any
    language does.  Names of languages do not matter, so one language under several names loses nothing; without
    a training row, or a null ``lang`` everywhere, all documents with letters stay."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    judged = langid.predict(rows, model, ["row"])
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("gain") >= langid.MIN_GAIN)).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays."""
    kept = exact.exact_dedup(docs.select("doc_id", "text")).filter("kept").select("doc_id", F.col("text_sha256").alias("tag")).distinct()
    rows = _rows(docs).withColumn("sha", F.sha2(ascii_lower(F.coalesce(F.col("row.text"), F.lit(""))).cast("binary"), 256))
    left = rows.alias("d").join(kept.alias("k"), _same("sha"), "left_semi")
    # rows that repeat an id and a text (up to the case of A-Z) are copies too
    first = F.row_number().over(W.partitionBy("key_id", "sha").orderBy("key_tag"))
    return left.withColumn("copy", first).filter("copy = 1").select("row.*")


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Whole rows beside a number of their own, made of the file they stand in and their place in it.

    It moves and copies nothing, and a rerun numbers alike.  ``docs`` that do not come straight from files are written first.
    """

    def places(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select(F.struct("*").alias("row"), place.getField("file_path").alias("file"), place.getField("row_index").alias("index"))

    try:
        rows = places(docs)
    except AnalysisException:
        rows = places(stage(docs, "rows"))
    paths = sorted(r["file"] for r in rows.select("file").distinct().collect())  # the input files' names, as the scan's plan has them
    files = spark.createDataFrame(list(enumerate(paths)), "ordinal long, file string")
    number = F.shiftleft("ordinal", 36) + F.col("index")
    return rows.join(F.broadcast(files), "file").select("row", number.alias("number"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest doc_id stays (a null one last)."""
    # rows may share an id or have none: they are compared by a number of their own
    rows = _numbered(spark, docs)
    comps = jaccard.near_components(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    ids = rows.select("number", F.col("row.doc_id").alias("key_id"), F.xxhash64("row.text").alias("key_tag"))
    first = F.struct(F.col("key_id").isNull(), "key_id", "number")
    of = comps.select(F.col("doc_id").alias("number"), "n_shingles", "component_id").join(ids, "number")
    # texts without words are in no group, but rows that repeat an id and such a text are copies
    group = F.when(F.col("n_shingles") > 0, F.struct(F.col("component_id").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(
        F.struct(F.col("key_id").alias("a"), F.col("key_tag").alias("b"))
    )
    kept = of.groupBy(group.alias("group"), (F.col("n_shingles") > 0).alias("words")).agg(F.min_by("number", first).alias("number"))
    kept = stage(kept.select("number"), "kept")
    return rows.join(kept, "number", "left_semi").select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of a benchmark item go."""
    hits = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    leaks = hits.filter("n_hit > 0").select("doc_id", "tag").distinct()
    return _rows(docs).alias("d").join(stage(leaks, "leaks").alias("k"), _same(), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the documents that the mix takes, in training order, with ``mix_words`` (words taken, repeats
    counted) and ``mix_position`` (of the first copy); columns of these names in ``docs`` are replaced."""
    mixed = mixing.mix(docs.select("doc_id", "source", "text")).filter("taken > 0")
    per_row = mixed.groupBy("doc_id", "tag").agg(F.max("taken").alias("mix_words"), F.min("position").alias("mix_position"))
    joined = _rows(docs.drop("mix_words", "mix_position")).alias("d").join(per_row.alias("k"), _same())
    return joined.select("row.*", "mix_words", "mix_position").orderBy("mix_position", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: A trained model and set similarity are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
