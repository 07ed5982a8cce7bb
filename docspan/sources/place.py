"""Folders for files that more than one machine reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the one that the cluster shares; it is deleted when the driver ends.

    Where the session names no shared folder, a temporary one serves a session whose driver and tasks are one
    process; on a cluster that is an error, as other machines would not see the files.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{place or tempfile.gettempdir() + '/docspan-local'}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
