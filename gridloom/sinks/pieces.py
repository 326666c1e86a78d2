"""What the sinks share: leaf columns, row order, pieces of encoded rows, targets."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice
from typing import IO, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRow
from ..options import Options
from ..plans.headers import HeaderPaths
from ..rowid import ROW_ID
from ..sources.files import check_path


def leaves(df: DataFrame, options: Options) -> tuple[DataFrame, HeaderPaths]:
    """The cells to write as c0, c1, ... (and the row id, if there is one), and the header over them.

    Given headers choose and order the columns of a named frame; a frame whose
    columns have other names is taken by position.
    """
    data = df.drop(ROW_ID)
    own = HeaderPaths.of_frame(data)
    header = own
    if options.headers:
        given = HeaderPaths.injected(options.headers, options.header_rows, options.header_normalizer)
        if set(given.paths) <= set(own.paths):
            if options.strict and len(given) != len(own):
                raise InvalidRow(f"Row 1 has {len(own)} columns, expected {len(given)}", 1)
            header = own = given
        elif len(given) == len(own):
            header = given
        elif options.strict:
            raise InvalidRow(f"Row 1 has {len(own)} columns, expected {len(given)}", 1)
        else:
            header = given
    flat = [F.col(".".join("`" + n.replace("`", "``") + "`" for n in path)).alias(f"c{i}") for i, path in enumerate(own.paths)]
    return df.select(*flat, *([F.col(ROW_ID)] if ROW_ID in df.columns else [])), header


def pieces(cells: DataFrame, line: Column) -> Iterator[str]:
    """Encoded rows in the frame's order, by row id if it has one; one partition at a time comes to the driver."""
    ordered = cells.orderBy(ROW_ID) if ROW_ID in cells.columns else cells
    for row in ordered.select(line.alias("line")).toLocalIterator(prefetchPartitions=True):
        yield row[0]


def joined(lines: Iterator[str], rows: int = 1000) -> Iterator[str]:
    """Encoded rows, many at a time."""
    while part := list(islice(lines, rows)):
        yield "".join(part)


@contextmanager
def target(spark: SparkSession, path: str, temp_path: str | None = None) -> Iterator[IO[bytes]]:
    """A stream to a path, local or in any store that Spark knows; a partial file goes if writing fails.

    A local file is built beside the path, or in the folder ``temp_path``.
    """
    check_path(path)
    if "://" not in path and not path.startswith("file:"):
        part = os.path.join(temp_path or os.path.dirname(path), f"{os.path.basename(path)}.part-{os.getpid()}")
        try:
            with open(part, "wb") as out:
                yield out
            shutil.move(part, path)
        finally:
            if os.path.exists(part):
                os.unlink(part)
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = _HadoopStream(spark, fs.create(where, True))
    try:
        yield out  # type: ignore[misc]
    except BaseException:
        out.close()
        fs.delete(where, False)
        raise
    out.close()


class _HadoopStream:
    """A write-only stream over a Hadoop output stream."""

    def __init__(self, spark: SparkSession, out: Any):
        self.spark, self.out, self.at, self.buffer = spark, out, 0, bytearray()

    def write(self, data: bytes) -> int:
        self.buffer += data
        self.at += len(data)
        if len(self.buffer) >= 1 << 20:
            self.flush()
        return len(data)

    def append_file(self, path: str) -> None:
        """Copy a file of a store that Spark knows to the end, without its bytes passing through Python."""
        self.flush()
        jvm, spark = self.spark.sparkContext._jvm, self.spark
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size, source = fs.getFileStatus(where).getLen(), fs.open(where)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, self.out, 1 << 20, False)
        finally:
            source.close()
        self.at += size

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return False

    def flush(self) -> None:
        if self.buffer:
            self.out.write(bytearray(self.buffer))
            self.buffer.clear()

    def close(self) -> None:
        self.flush()
        self.out.close()
