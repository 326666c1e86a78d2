"""Helpers that the operators share: lineage cuts, text batches, row removal."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a Python worker turns into Python objects at a time.
SLICE_ROWS = 256
#: Bytes of a batch that goes to a Python worker, about.
BATCH_BYTES = 8 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; set a folder of our own only where none is named and driver and executors are one process."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; it goes when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once, as a table in the shared checkpoint folder, and read it back.

    As ``cut``, but what is read has the size of its files, where a checkpoint
    keeps the estimate of its plan: loops of joins multiply that without end.
    """
    path = shared_folder(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_value(spark: SparkSession, value):
    """A function that returns ``value`` on executors, sent to each of them once.

    A broadcast is pickled by reference to its classes; this one holds them by
    value, as functions of this package do, so that workers need no copy of it.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, over all its tasks.

    Only the cache asked for last stays, so that a worker which serves one
    operator after another does not hold the words of all of them.
    """
    caches = sys.__dict__.setdefault("_gridloom_caches", {})
    for other in [k for k in caches if k != name]:
        caches.pop(other).clear()
    return caches.setdefault(name, {})


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES: a task holds a batch in the JVM and in Python at the same time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that few texts are Python objects at any time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def drop_rows(docs: DataFrame, key: Column, decisions: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``decisions`` (id, key, kept) turned down.

    A row is known by its id and ``key``, a hash of its text, so the texts are
    not kept a second time. Rows that share both are repeats: if one of them
    stays, one row comes back, that of the least text; which one it is among
    rows of equal text that differ elsewhere is not defined. Columns and other
    rows are untouched.
    """
    ident = [F.col("_gl_id"), F.col("_gl_key")]
    marked = docs.withColumns({"_gl_id": F.col("doc_id"), "_gl_key": key})
    found = decisions.select(F.col("id").alias("_gl_id"), F.col("key").alias("_gl_key"), "kept")
    pairs = found.groupBy(*ident).agg(F.max(F.col("kept").cast("int")).alias("stays"), F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs.filter((F.col("stays") == 0) | (F.col("n") > 1)))

    def on(right: DataFrame, how: str) -> DataFrame:
        r = right.select(F.col("_gl_id").alias("_gl_rid"), F.col("_gl_key").alias("_gl_rkey"))
        same = (F.col("_gl_key") == F.col("_gl_rkey")) & F.col("_gl_id").eqNullSafe(F.col("_gl_rid"))
        return marked.join(r, same, how)

    kept = on(pairs, "left_anti")
    repeated = pairs.filter("stays = 1")
    if not repeated.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        firsts = on(repeated, "left_semi").groupBy(*ident).agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("_gl_row"))
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(firsts.select("_gl_row.*"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
