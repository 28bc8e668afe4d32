"""Helpers shared by the corpus operators: input reading, shared-folder tables, ASCII text columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of letters and digits: everything from U+0080 up counts as a letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"

#: A runtime setting of Spark: a query's shuffle files are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may lack it (tests); it then gets a private folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="nichelab-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back.

    Cuts the lineage so that a lost executor costs no more than the running
    step, gives the planner true sizes, and fixes what is computed once.  The
    step's shuffle files go when it is written (``SHUFFLE_CLEANUP``), the table's
    files with ``discard`` or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(where)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stage`` returned, once all that is made of them is staged itself."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` changes other alphabets as well, so it serves pure ASCII texts)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column) -> Column:
    """The ``WORD``s of a text, A-Z lower-cased; null has none.

    Splitting at the gaps is linear; extracting every match would copy the text per match.
    """
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), WORD_GAP), "")


def hash_limit(df: DataFrame, key: str, n: int) -> int | None:
    """The ``n``-th smallest hash of ``key``: rows up to it are a sample of about ``n`` rows (null for an empty table)."""
    return df.select(F.xxhash64(key).alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
