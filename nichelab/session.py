"""Session builder with the settings every job in the package assumes."""

from __future__ import annotations

import logging
import os
import tempfile

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "nichelab",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with UTC time, AQE, skew-join splitting and no UI.

    ``master`` and ``shuffle_partitions`` default to the environment
    (``NICHELAB_MASTER`` / ``NICHELAB_SHUFFLE_PARTITIONS``) so the same code runs
    under ``local[8]`` in tests and under a cluster manager in production,
    where ``spark-submit`` supplies the master and the partition count is
    sized to the data (about 128-256 MB of shuffle data per partition).
    """
    builder = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("NICHELAB_MASTER")
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or os.environ.get("NICHELAB_SHUFFLE_PARTITIONS")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if parts:
        conf["spark.sql.shuffle.partitions"] = str(parts)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Point ``SparkContext`` at the shared checkpoint folder of the cluster.

    The folder comes from ``spark.checkpoint.dir``; ``fallback`` is used only
    when that setting is absent (tests).  Returns the folder in use, or None.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if path:
        spark.sparkContext.setCheckpointDir(path)
    else:
        logging.getLogger(__name__).warning("spark.checkpoint.dir is not set: long lineages are not cut")
    return path


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, for files a job writes and reads again: the checkpoint folder.

    Only a local session may lack it (tests); it then gets a private one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="nichelab-files-")
    return path.rstrip("/")
