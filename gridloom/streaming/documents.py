"""A stream of the rows of documents that arrive in a folder."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..options import Options, make_options
from ..sources.files import binary_files, check_path, known_format
from ..sources.frames import finish, plan_files, row_decoder


def read_stream(spark: SparkSession, folder: str, like: str, format: str, options: Options | None = None, *, row_id: bool = False, file_column: bool = False, pattern: str | None = None, **changes: Any) -> DataFrame:
    """The rows of every document that arrives in ``folder``, each file once.

    A stream's columns are fixed before its first file comes, so they are taken
    from the document at ``like``; a file with another header raises. All row
    transforms but those that number rows anew work on the stream as they do on
    a frame.
    """
    kind, chosen = known_format(format), make_options(options, **changes)
    header, plain_width, types = plan_files(binary_files(spark, like), kind, chosen)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if pattern:
        files = files.option("pathGlobFilter", pattern)
    run, schema = row_decoder(kind, chosen, plain_width, types, header)
    rows = files.load(check_path(folder)).select("path", "content").mapInArrow(run, T.StructType(schema))
    return finish(rows, header, chosen.assoc, row_id, file_column)
