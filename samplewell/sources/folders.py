"""The folder that driver and executors share, and what is written there for a while."""

from __future__ import annotations

import atexit

from pyspark.sql import SparkSession

_left: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is set and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("/tmp/checkpoints/samplewell")
    return named or sc.getCheckpointDir()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """For tables that a lazy result still reads: they go when the driver ends, as far as the file system can still be reached then."""
    if not _left:
        atexit.register(_clean, spark)
    _left.append(folder)


def _clean(spark: SparkSession) -> None:
    for folder in _left:
        try:
            delete(spark, folder)
        except Exception:  # the JVM is gone: the folder's owner cleans up
            return
