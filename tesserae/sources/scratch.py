"""A folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def spark_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of our own only where a session within one process names none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder in the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Containers are read by position with the operating system's files, so the folder must be mounted.
    """
    top = spark_folder(spark)
    path = re.sub(r"^file:/+", "/", top)
    if "://" in path:
        raise OSError(f"{top} is not mounted; read containers from it with catalog_from_bytes")
    folder = os.path.join(path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder
