"""A folder of the shared file system for what a job writes and reads back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.raster import checkpointed


def shared_folder(spark: SparkSession) -> str:
    """A new name below spark.checkpoint.dir, as a URI; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base if ':/' in base else 'file://' + base}/rooflines-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def through_folder(spark: SparkSession, job: Callable[[str], DataFrame]) -> DataFrame:
    """What job makes of a new folder, computed and kept by a checkpoint; the folder is removed."""
    folder = shared_folder(spark)
    try:
        return checkpointed(job(folder))
    finally:
        removed(spark, folder)
