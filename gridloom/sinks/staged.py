"""Encoded rows of one document, written in order by executors and put together by the driver.

Each partition writes one file into a staging folder; to the driver come its
name, sizes and checksum only. The driver copies the files one after another
into the document and drops each. Rows of workbooks are deflated on executors:
a segment ends with a full flush, so segments that follow one another are one
deflated entry, and each can be read alone.
"""

from __future__ import annotations

import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import IO, Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rowid import ROW_ID
from ..scratch import scratch_folder
from ..segments import Segment, crc_joined, extra_field
from ..stores import store_of

#: Bytes of rows, before they are deflated, after which a segment ends.
SEGMENT_BYTES = 16 << 20
#: Rows that are deflated at a time.
SLICE_ROWS = 1000


@dataclass(frozen=True)
class Staged:
    """The files of a document's rows, in order, and their segments."""

    folder: str
    files: list[tuple[str, list[Segment]]]

    def append(self, out: IO[bytes]) -> None:
        """Copy the files to the end of a stream, each dropped when it is there."""
        store, root = store_of(self.folder)
        for name, _ in self.files:
            if hasattr(out, "append_file"):
                out.append_file(f"{self.folder}/{name}")
            else:
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    while data := source.read(1 << 20):
                        out.write(data)
            store.delete_file(f"{root}/{name}")


def _bytes(column: pa.Array) -> memoryview:
    """The texts of a column without nulls, one after another, as they stand in memory."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return memoryview(b"")
    at = memoryview(offsets).cast("q" if wide else "i")
    return memoryview(data)[at[column.offset] : at[column.offset + len(column)]]


def _writer(folder: str, deflate: bool, encoding: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, out, done = f"{part:06d}-{uuid.uuid4().hex}", None, []
        pack, packed, raw, crc, rows = None, 0, 0, 0, 0

        def put(data: Any) -> None:
            nonlocal packed
            packed += len(data)
            out.write(data)

        def end() -> None:
            nonlocal pack, packed, raw, crc, rows
            if rows:
                if pack is not None:
                    put(pack.flush(zlib.Z_FULL_FLUSH))
                done.append((packed, raw, crc, rows))
            pack, packed, raw, crc, rows = None, 0, 0, 0, 0

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    store, root = store_of(folder)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                column = batch.column(0)
                for first in range(0, len(column), SLICE_ROWS):
                    some = column.slice(first, SLICE_ROWS)
                    text = _bytes(some)
                    if encoding is not None:
                        text = str(text, "utf-8").encode(encoding)
                    raw, crc, rows = raw + len(text), zlib.crc32(text, crc) if deflate else 0, rows + len(some)
                    if deflate:
                        pack = pack or zlib.compressobj(wbits=-15)
                        put(pack.compress(text))
                    else:
                        put(text)
                    if deflate and raw >= SEGMENT_BYTES:
                        end()
            end()
        finally:
            if out is not None:
                out.close()
        n = len(done)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([name] * n, pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in range(4))],
            names=["part", "at", "name", "packed", "raw", "crc", "rows"],
        )

    return run


def stage(cells: DataFrame, line: Column, deflate: bool = False, encoding: str | None = None) -> Staged | None:
    """Write the encoded rows in the frame's order, by row id if it has one; None where executors reach the shared folder by Spark only."""
    spark = cells.sparkSession
    folder = scratch_folder(spark)
    try:
        store, root = store_of(folder)
        store.create_dir(root)
    except Exception:  # noqa: BLE001 (no store of pyarrow's)
        return None
    ordered = cells.orderBy(ROW_ID) if ROW_ID in cells.columns else cells
    said = ordered.select(line.alias("line")).mapInArrow(_writer(folder, deflate, encoding), "part long, at long, name string, packed long, raw long, crc long, rows long").collect()
    files: list[tuple[str, list[Segment]]] = []
    for r in sorted(said):
        if not files or files[-1][0] != r["name"]:
            files.append((r["name"], []))
        files[-1][1].append(Segment(r["packed"], r["raw"], r["crc"], r["rows"]))
    return Staged(folder, files)


def write_entry(package: zipfile.ZipFile, name: str, opening: bytes, header_rows: int, staged: Staged, closing: bytes) -> None:
    """An entry of a package that is being written: an opening, the staged rows, and a closing."""

    def deflated(data: bytes, mode: int) -> bytes:
        pack = zlib.compressobj(wbits=-15)
        return pack.compress(data) + pack.flush(mode)

    first, last = deflated(opening, zlib.Z_FULL_FLUSH), deflated(closing, zlib.Z_FINISH)
    segments = [Segment(len(first), len(opening), zlib.crc32(opening), header_rows), *(s for _, found in staged.files for s in found), Segment(len(last), len(closing), zlib.crc32(closing), 0)]
    info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    info.compress_type = zipfile.ZIP_DEFLATED
    info.file_size, info.compress_size, info.CRC = sum(s.raw for s in segments), sum(s.packed for s in segments), 0
    for s in segments:
        info.CRC = crc_joined(info.CRC, s.crc, s.raw)
    stream: Any = package.fp
    info.header_offset = stream.tell()
    stream.write(info.FileHeader(zip64=True))
    stream.write(first)
    if hasattr(stream, "append_file") or not hasattr(stream, "fp") or not hasattr(stream.fp, "append_file"):
        staged.append(stream)
    else:  # zipfile counts what goes through it
        stream.fp.flush()
        before = stream.fp.tell()
        staged.append(stream.fp)
        stream.offset += stream.fp.tell() - before
    stream.write(last)
    info.extra = extra_field(segments)
    package.filelist.append(info)
    package.NameToInfo[name] = info
    package.start_dir = stream.tell()
    package._didModify = True
