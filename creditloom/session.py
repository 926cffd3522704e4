"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app_name: str = "creditloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; cluster sizing is left to spark-submit.

    ``SPARK_MASTER``, ``SPARK_SHUFFLE_PARTITIONS`` and ``SPARK_MAX_PARTITION_BYTES`` are
    honoured where set, ``conf`` wins over all of them.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # files of checkpoints that nothing refers to any more are deleted
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # recording a Python call site for every column expression slows plan building
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if "SPARK_SHUFFLE_PARTITIONS" in os.environ:
        settings["spark.sql.shuffle.partitions"] = os.environ["SPARK_SHUFFLE_PARTITIONS"]
    if "SPARK_MAX_PARTITION_BYTES" in os.environ:
        settings["spark.sql.files.maxPartitionBytes"] = os.environ["SPARK_MAX_PARTITION_BYTES"]
    settings.update(conf)

    builder = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("SPARK_MASTER")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where they start in another folder; elsewhere ship it as usual."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{root}".strip(":")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fresh = tempfile.mkdtemp(prefix="creditloom-")
    context.setCheckpointDir(fresh)
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark).rstrip('/')}/creditloom/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder; one that isn't there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
