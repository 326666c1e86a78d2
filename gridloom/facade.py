"""The engine's front: read and write tabular documents as frames."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession

from .options import Options, make_options
from .sinks import csv as csv_sink
from .sinks import ods as ods_sink
from .sinks import parts
from .sinks import xlsx as xlsx_sink
from .sinks.pieces import target
from .sources import files
from .sources.frames import frame, read_files


def read(spark: SparkSession, path: str | list[str], options: Options | None = None, *, row_id: bool = False, file_column: bool = False, format: str | None = None, types: Sequence[str] | None = None, **changes: Any) -> DataFrame:
    """Read documents at a path, a folder, a pattern or a list of paths.

    The format goes by the extension, else by the content. ``types`` of the
    columns of workbooks in native mode (string, long, double, boolean,
    timestamp_ntz) save the pass over the rows that finds them. ``changes`` are
    options by name.
    """
    kind = files.known_format(format) if format else files.format_of(spark, path)
    return read_files(spark, path, kind, make_options(options, **changes), row_id, file_column, types)


def read_bytes(spark: SparkSession, content: bytes, format: str | None = None, options: Options | None = None, *, row_id: bool = False, **changes: Any) -> DataFrame:
    """Read a document that is in memory."""
    kind = files.known_format(format) if format else files.sniff(content[: files.SNIFF_BYTES])
    rows = spark.createDataFrame([("memory", bytearray(content))], "path string, content binary")
    return frame(rows, kind, make_options(options, **changes), row_id)


def reader(format: str) -> Callable[..., DataFrame]:
    """``read`` for one format."""
    kind = files.known_format(format)
    return lambda spark, path, options=None, **more: read(spark, path, options, format=kind, **more)


def write_stream(df: DataFrame, out: IO[bytes], format: str, options: Options | None = None, **changes: Any) -> None:
    """Write a frame as a document to a binary stream."""
    kind, chosen = files.known_format(format), make_options(options, **changes)
    {"csv": csv_sink, "xlsx": xlsx_sink, "ods": ods_sink}[kind].write(df, out, chosen)


def write(df: DataFrame, path: str, options: Options | None = None, *, format: str | None = None, **changes: Any) -> str:
    """Write a frame as one document; the path it went to."""
    kind = files.known_format(format or files.extension(path))
    chosen = make_options(options, **changes)
    with target(df.sparkSession, path, chosen.temp_path) as out:
        write_stream(df, out, kind, chosen)
    return path


def write_parts(df: DataFrame, folder: str, format: str, options: Options | None = None, *, rows: int = parts.DOCUMENT_ROWS, **changes: Any) -> str:
    """Write a frame as a folder of documents of up to ``rows`` rows, all of it on executors; the folder.

    A folder of workbooks reads back as one frame. CSV parts have no header.
    """
    kind, chosen = files.known_format(format), make_options(options, **changes)
    files.check_path(folder)
    if kind == "csv":
        csv_sink.write_parts(df, folder, chosen, rows)
    else:
        parts.write_parts(df, folder, kind, chosen, rows)
    return folder


def write_bytes(df: DataFrame, format: str, options: Options | None = None, **changes: Any) -> bytes:
    """A frame as the bytes of a document."""
    out = io.BytesIO()
    write_stream(df, out, format, options, **changes)
    return out.getvalue()


def writer(format: str) -> Callable[..., str]:
    """``write`` for one format."""
    kind = files.known_format(format)
    return lambda df, path, options=None, **more: write(df, path, options, format=kind, **more)


def download(df: DataFrame, name: str, format: str, options: Options | None = None, **changes: Any) -> tuple[str, dict[str, str], Iterator[bytes]]:
    """(media type, HTTP headers, bytes piece by piece) of a document to hand out; encoding problems show at once."""
    kind, chosen = files.known_format(format), make_options(options, **changes)
    media = files.MIME_TYPES[kind]
    headers = {"Content-Type": media, "Content-Disposition": f'attachment; filename="{files.ensure_extension(name, kind)}"', "Cache-Control": "max-age=0"}
    if kind == "csv" and chosen.stream:
        csv_sink.check_encoding(chosen)
        return media, headers, csv_sink.chunks(df, chosen)
    body = write_bytes(df, kind, chosen)
    return media, headers | {"Content-Length": str(len(body))}, iter([body])
