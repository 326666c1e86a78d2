"""A folder for files that executors have to see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _own_folder(spark: SparkSession) -> str:
    """A temp folder of this machine, where driver and executors are one process."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="gridloom-")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; it goes when the session's JVM ends.

    Where that is unset a local session takes a temp folder and another raises.
    """
    jvm = spark.sparkContext._jvm
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{_own_folder(spark)}"
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/gridloom-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, into the checkpoint folder that all executors share: every later use sees the same partitions."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_own_folder(spark))
    return df.checkpoint(eager=True)


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """Write bytes to a path in any store that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content))
    out.close()
    return path
