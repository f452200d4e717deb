"""The folder that the driver and all executors share, and fresh paths in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Fresh paths that this process has handed out and not removed.
_PATHS: list[str] = []


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder of this machine, in local mode alone; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        current = context.getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            folder = "file://" + tempfile.mkdtemp(prefix="urlsieve-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, to be removed by clean(), which also runs as the process ends while Spark does."""
    path = f"{shared(spark)}/urlsieve/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers name it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def clean(spark: SparkSession) -> None:
    """Deletes all fresh paths; what was read from them can't be read again."""
    while _PATHS:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _end() -> None:
    spark = SparkSession.getActiveSession()
    if spark and not spark.sparkContext._jsc.sc().isStopped():
        clean(spark)
