"""Documents as frames.

A first pass over the files, on executors, finds each file's header and, where a
frame's columns depend on the rows, their width and kinds; only a few short
descriptions come to the driver. The second pass decodes the rows. A workbook
is not splittable: a task reads a file. Large CSV files with plain dialects can
be read in splits by ``read_csv_splits``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from typing import IO, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, InvalidDocument, decode_error, encode_error
from ..functions import values as V
from ..options import Options, detect_bom
from ..plans.headers import HeaderPaths
from ..rowid import ROW_ID
from ..scratch import written
from ..segments import Segment, segments_of
from ..stores import can_open, open_file
from . import csv, ods, xlsx
from .files import binary_files, check_path, file_size
from .blocks import Block
from .package import check_size, open_package
from .rows import Assembled, Piece, Row, Wanted, assemble

BATCH_ROWS = 4096
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}


def decoded(content: bytes | IO[bytes], kind: str, options: Options, piece: Piece | None = None, blocks: bool = False) -> Assembled:
    """The data rows of a document's bytes or file; some as blocks, if those are taken."""
    wanted = Wanted(takes_blocks=blocks)
    source: Iterator[Row] = csv.records(content, options) if kind == "csv" else (xlsx if kind == "xlsx" else ods).rows(content, options, wanted, piece)
    return assemble(source, options, wanted)


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long"
    if isinstance(value, float):
        return "double"
    if isinstance(value, datetime):
        return "timestamp_ntz"
    return "string"


def column_type(kinds: set[str]) -> str:
    """One type for the kinds of cells in a column: integers and decimals make a double, other mixtures text."""
    kinds = kinds - {"null"}
    if len(kinds) == 1:
        return next(iter(kinds))
    return "double" if kinds == {"long", "double"} else "string"


#: (path, content, piece) of the documents that a batch stands for.
Documents = Callable[[pa.RecordBatch], Iterator[tuple[str, "bytes | IO[bytes]", "Piece | None"]]]


def whole_documents(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes | IO[bytes], None]]:
    """The documents of rows (path, content); those without content are read from their path a piece at a time."""
    for path, content in zip(batch.column(0), batch.column(1)):
        if content.is_valid:
            yield path.as_py(), content.as_py(), None
        else:
            with open_file(path.as_py()) as source:
                yield path.as_py(), source, None


def describe(content: bytes | IO[bytes], kind: str, options: Options, whole: bool, piece: Piece | None = None) -> dict[str, Any]:
    """Header, width and kinds of a document; with ``whole``, by all of its rows."""
    found = decoded(content, kind, options, piece, True)
    width = 0
    kinds: dict[int, set[str]] = {}
    if whole:
        for row in found.rows:
            if isinstance(row, Block):
                width = max(width, len(row.columns))
                for i, column in enumerate(row.columns if not options.stringify_values else ()):
                    if column is not None and (seen := column.kinds()):
                        kinds.setdefault(i, set()).update(seen)
                continue
            width = max(width, len(row))
            if not options.stringify_values:
                for i, cell in enumerate(row):
                    if cell is not None and cell != "":
                        kinds.setdefault(i, set()).add(_kind(cell))
    header = None if found.header is None else {"paths": found.header.paths, "indices": found.header.indices}
    return {"header": header, "width": width, "kinds": {str(i): sorted(k) for i, k in kinds.items()}}


def _describer(kind: str, options: Options, whole: bool, documents: Documents) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, content, piece in documents(batch):
                try:
                    said = json.dumps(describe(content, kind, options, whole, piece))
                except EngineError as error:
                    said = encode_error(error)
                yield pa.RecordBatch.from_arrays([pa.array([said])], names=["said"])

    return run


def _converted(values: list[Any], kind: str) -> pa.Array:
    if kind == "string":
        return pa.array([v if v is None or isinstance(v, str) else V.stringify(v) for v in values], pa.string())
    try:
        if kind == "double":
            return pa.array([None if v is None or v == "" else float(v) for v in values], pa.float64())
        return pa.array([None if v == "" else v for v in values], _ARROW[kind])
    except (ValueError, TypeError, pa.ArrowException) as error:  # only where the caller named the types
        raise InvalidDocument(f"A column has cells that are no {kind}: {error}") from error


def row_decoder(kind: str, options: Options, plain_width: int | None, kinds: list[str], header: HeaderPaths | None, documents: Documents = whole_documents) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], list[T.StructField]]:
    """A mapInArrow function from (path, content) to ``_file``, ``_row_id`` and physical columns, and its schema."""
    fields = [T.StructField("_file", T.StringType()), T.StructField(ROW_ID, T.LongType()), *[T.StructField(f"_c{i}", T._parse_datatype_string(k)) for i, k in enumerate(kinds)]]
    paths = header.paths if header is not None else None
    names = ["_file", ROW_ID, *(f"_c{i}" for i in range(len(kinds)))]

    def batch_of(path: str, first: int, rows: list[Row]) -> pa.RecordBatch:
        columns = [[row[i] for row in rows] for i in range(len(kinds))]
        arrays = [pa.array([path] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), *map(_converted, columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def block_of(path: str, first: int, block: Block, picked: Sequence[int]) -> pa.RecordBatch:
        arrays = [pa.array([path] * block.rows), pa.array(range(first, first + block.rows), pa.int64())]
        for i, k in zip(picked, kinds):
            column = block.columns[i] if i < len(block.columns) else None
            found = pa.nulls(block.rows, _ARROW[k]) if column is None else column.array(k)
            arrays.append(_converted(column.values(), k) if found is None else found)
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, piece in documents(batch):
                try:
                    found = decoded(content, kind, options, piece, True)
                    if found.header is not None and found.header.paths != paths:
                        raise InvalidDocument("The files have different headers: " + ", ".join(found.header.names))
                    picked = range(plain_width) if plain_width is not None else found.header.indices if found.header else ()
                    part, first = [], 0
                    for row in found.rows:
                        if isinstance(row, Block):
                            if part:
                                yield batch_of(path, first, part)
                                first, part = first + len(part), []
                            yield block_of(path, first, row, picked)
                            first += row.rows
                            continue
                        part.append([row[i] if i < len(row) else None for i in picked])
                        if len(part) == BATCH_ROWS:
                            yield batch_of(path, first, part)
                            first += len(part)
                            part = []
                    if part:
                        yield batch_of(path, first, part)
                except EngineError as error:
                    raise RuntimeError(encode_error(error)) from error

    return run, fields


def plan_files(files: DataFrame, kind: str, options: Options, given: Sequence[str] | None = None, documents: Documents = whole_documents) -> tuple[HeaderPaths | None, int | None, list[str]]:
    """(header, plain width, column types) that fit all files; with the types given, rows are looked at in strict mode only."""
    named = bool(options.headers) or options.assoc or options.header_offset == "auto"
    whole = (given is None and (not named or not options.stringify_values)) or options.strict
    said = files.mapInArrow(_describer(kind, options, whole, documents), "said string").distinct().collect()
    header, width, kinds = None, 0, {}
    for line in said:
        if error := decode_error(line["said"]):
            raise error
        found = json.loads(line["said"])
        if found["header"] is not None:
            own = HeaderPaths(tuple(map(tuple, found["header"]["paths"])), tuple(found["header"]["indices"]))
            if header is not None and own.paths != header.paths:
                raise InvalidDocument("The files have different headers: " + ", ".join(header.names) + " and " + ", ".join(own.names))
            header = own
        width = max(width, found["width"])
        by = {i: k for k, i in enumerate(own.indices)} if found["header"] is not None else None
        for i, ks in found["kinds"].items():
            at = int(i) if by is None else by.get(int(i))
            if at is not None:
                kinds.setdefault(at, set()).update(ks)
    plain = header is None or not options.assoc
    count = len(header) if header is not None else width
    if header is not None and plain and not options.columns:
        count = max(count, width)  # plain rows keep cells beyond the header
    if given is not None:
        if header is not None and options.assoc and len(header) != len(given):
            raise ValueError(f"{len(given)} types are given for {len(header)} columns")
        if unknown := [t for t in given if t not in _ARROW]:
            raise ValueError(f"unknown types: {', '.join(unknown)}")
        count = len(given)
    types = list(given) if given is not None else ["string" if options.stringify_values else column_type(kinds.get(i, set())) for i in range(count)]
    return header, None if header is not None and (options.assoc or options.columns) else count, types


def finish(df: DataFrame, header: HeaderPaths | None, named: bool, row_id: bool, file_column: bool) -> DataFrame:
    """Physical columns ``_c0``, ``_c1``, ... under their names, nested where the header is."""
    count = len([c for c in df.columns if c.startswith("_c")])
    extra: list[Column] = [F.col("_file")] * file_column + [F.col(ROW_ID)] * row_id
    if header is None or not named:
        return df.select(*extra, *[F.col(f"_c{i}") for i in range(count)])
    placed = HeaderPaths(header.paths, tuple(range(len(header))))
    if placed.is_flat:
        flat = df.select(*extra, *[F.col(f"_c{i}") for i in range(count)])
        return flat.toDF(*[c for c, on in (("_file", file_column), (ROW_ID, row_id)) if on], *[p[0] for p in placed.paths])
    return df.select(*extra, *placed.project(lambda i: F.col(f"_c{i}")))


def frame(files: DataFrame, kind: str, options: Options, row_id: bool = False, file_column: bool = False, types: Sequence[str] | None = None, documents: Documents = whole_documents) -> DataFrame:
    """The rows of ``files`` (path, content), in order within a file.

    With ``row_id`` the column ``_row_id`` numbers the data rows of each file
    from 0; with ``file_column`` the column ``_file`` has the file's path.
    Offset and limit count for each file. ``types`` of the columns (string,
    long, double, boolean, timestamp_ntz) save the pass that finds them.
    """
    if options.header_offset == "auto" and not options.required_columns:
        raise ValueError("header_offset='auto' needs required_columns")
    header, plain_width, kinds = plan_files(files, kind, options, types, documents)
    run, schema = row_decoder(kind, options, plain_width, kinds, header, documents)
    rows = files.mapInArrow(run, T.StructType(schema))
    return finish(rows, header, options.assoc, row_id, file_column)


def read_files(spark: SparkSession, paths: str | list[str], kind: str, options: Options, row_id: bool = False, file_column: bool = False, types: Sequence[str] | None = None) -> DataFrame:
    """The documents at paths as one frame."""
    if kind == "csv" and types is None:
        paths = [check_path(p) for p in ([paths] if isinstance(paths, str) else paths)]
        heads = file_heads(spark, spark.read.text(paths).inputFiles())
        if (layout := split_layout(spark, paths, heads, options)) is not None:
            return split_rows(spark, paths, layout, options, row_id, file_column)
        if heads and (most := max(size for size, _ in heads)) > STREAM_BYTES:
            names = spark.read.text(paths).inputFiles()
            if len(names) == len(heads) and all(can_open(n, size) for n, (size, _) in zip(names, heads)):
                return frame(_by_path(spark, names), kind, options, row_id, file_column, types)
        if heads and most > WHOLE_FILE_BYTES:
            raise InvalidDocument(f"A CSV file of {most} bytes cannot be read in splits with these options or signs, and whole files end at {WHOLE_FILE_BYTES} bytes")
    elif isinstance(paths, str) and (found := file_size(spark, check_path(paths))) and can_open(*found):
        name, size = found
        if size > SPLIT_BYTES and not row_id and (pieces := _pieces(name, kind, options)):
            tasks = min(pieces[0], 4 * spark.sparkContext.defaultParallelism)
            return frame(spark.range(0, pieces[0], 1, tasks), kind, options, False, file_column, types, pieces[1])
        if size > STREAM_BYTES:
            return frame(_by_path(spark, [name]), kind, options, row_id, file_column, types)
    return frame(binary_files(spark, paths).select("path", "content"), kind, options, row_id, file_column, types)


def _by_path(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, None) for n in names], "path string, content binary").repartition(len(names), "path")


def _pieces(path: str, kind: str, options: Options) -> tuple[int, Documents] | None:
    """(count, documents by number) of the pieces that a workbook of one sheet can be read in; None if it has to be read as a whole.

    Pieces are the segments in which the sheet was written. Each is read with
    the header before it, so header rows must be all that stands there.
    """
    if options.strict or options.offset or options.limit is not None or options.header_offset is not None:
        return None
    try:
        with open_file(path) as source, open_package(source) as package:
            name = "content.xml" if kind == "ods" else xlsx.sheet_path(package, options.sheet)
            info = package.getinfo(name)
            segments = segments_of(info)
            own_header = options.header_rows if options.assoc and not options.headers else 0
            if not segments or len(segments) < 4 or segments[0].rows != own_header:
                return None
            check_size(info, options.max_worksheet_size)
            source.seek(info.header_offset)
            head = source.read(30)
            start = info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
            at = [start]
            for s in segments:
                at.append(at[-1] + s.packed)

            ends = [inflated(source, at[i], segments[i]) for i in (0, len(segments) - 1)]
            if own_header and decoded(source, kind, options, Piece(ends[0] + ends[1], {})).header is None:
                return None
    except (EngineError, KeyError, OSError, zlib.error):
        return None  # read as a whole, which says what is wrong

    def documents(batch: pa.RecordBatch) -> Iterator[tuple[str, IO[bytes], Piece]]:
        with open_file(path) as source:
            for i in batch.column(0).to_pylist():
                text = inflated(source, at[i + 1], segments[i + 1])
                yield path, source, Piece(ends[0] + text + ends[1], known)

    known: dict[str, Any] = {}
    return len(segments) - 2, documents


def inflated(source: IO[bytes], at: int, segment: Segment) -> bytes:
    """The text of a segment at a place in a file."""
    source.seek(at)
    text = zlib.decompressobj(wbits=-15).decompress(source.read(segment.packed), segment.raw + 1)
    if len(text) != segment.raw or zlib.crc32(text) != segment.crc:
        raise InvalidDocument("A part of the sheet does not agree with its checksum")
    return text


#: The largest file that one row of a frame can hold.
WHOLE_FILE_BYTES = 2**31 - 1024
#: Larger files that are read by one task are read a piece at a time, where executors open them without Spark.
STREAM_BYTES = 64 << 20
#: Larger workbooks are read in pieces by many tasks, if they were written so.
SPLIT_BYTES = 1 << 20
#: Bytes of a file's head: the sample of the separator, at up to four bytes a sign.
HEAD_BYTES = 4 * csv.SAMPLE_BYTES
_MARK = "\x02"


def file_heads(spark: SparkSession, files: list[str]) -> list[tuple[int, bytes]]:
    """(size, first bytes) of files, read by the driver some at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def head(name: str) -> tuple[int, bytes]:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        fs = path.getFileSystem(conf)
        size = fs.getFileStatus(path).getLen()
        source = fs.open(path)
        try:
            return size, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(source, min(size, HEAD_BYTES)))
        finally:
            source.close()

    if len(files) < 4:
        return [head(f) for f in files]
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(head, files))


@dataclass(frozen=True)
class SplitLayout:
    """How the lines of plain CSV files become columns."""

    separator: str
    first: Row
    width: int
    header: HeaderPaths | None
    own_header: bool


def _outside_quotes(line: Column, separator: str, quote: str) -> Column:
    """A line without what stands in well-formed quoted cells; a quote or mark that is left shows that a cell is not well-formed."""
    s, q = re.escape(separator), re.escape(quote)
    cell = rf"(?<=^|{s})(?:{_MARK}*{q}[^{q}]*+{q}|{_MARK}+)(?=$|{s})"
    return F.when(F.contains(line, F.lit(quote)), F.regexp_replace(F.replace(line, F.lit(quote * 2), F.lit(_MARK)), cell, "")).otherwise(line)


def _cells(bare: Column, separator: str) -> Column:
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) + 1


def _line(value: Column) -> Column:
    return F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value)


def split_layout(spark: SparkSession, paths: list[str], heads: list[tuple[int, bytes]], options: Options) -> SplitLayout | None:
    """The layout of files that can be read in splits with the same result as whole; None if there are no such.

    A pass over all lines looks for what the two readers might see differently:
    quotes that no line closes or that stand within a cell, carriage returns
    within a line, lines of blanks, NUL and bytes that are no UTF-8.
    """
    plain = not (options.assoc or options.headers or options.columns or options.required_columns or options.aliases)
    if not (options.assoc or plain) or options.header_rows != 1 or options.header_offset or not options.skip_empty_lines or options.strict or options.limit is not None or options.offset:
        return None
    if (options.input_encoding or "auto").lower() not in ("auto", "utf-8", "utf8") or options.escape not in ("", options.enclosure) or not heads:
        return None
    marks = {detect_bom(head) for _, head in heads}
    if not marks <= {None, "utf-8"} or "utf-8" in marks and not options.skip_input_bom:
        return None
    texts = [head.decode("utf-8", "replace").removeprefix("\ufeff") for _, head in heads]
    separators = {csv.separator_of(t, options) for t in texts}
    tops = {next((line.rstrip("\r") for line in t.split("\n")[: None if size <= HEAD_BYTES else -1] if line.strip("\r")), None) for t, (size, _) in zip(texts, heads)}
    separator = separators.pop()
    if separators or None in tops or separator in "\r\n" or separator == options.enclosure:
        return None
    # a line keeps its bytes as they are, and signs are counted wrongly where they are no UTF-8, so that is asked before the line's end is cut
    lines = spark.read.text(paths, lineSep="\n").filter(~F.col("value").isin("", "\r")).select(_line(F.col("value")).alias("line"), (~F.is_valid_utf8("value")).alias("broken"))
    bare = _outside_quotes(F.col("line"), separator, options.enclosure)
    has = lambda sign: F.contains("line", F.lit(sign))
    blank = F.ltrim(F.col("line"), F.lit("".join(map(chr, range(33))))) == ""
    odd = has("\r") | has("\0") | has(_MARK) | F.col("broken") | blank
    seen = lines.withColumn("bare", bare).select((odd | F.contains("bare", F.lit(options.enclosure)) | F.contains("bare", F.lit(_MARK))).alias("odd"), _cells(F.col("bare"), separator).alias("cells"))
    found_odd, most = seen.agg(F.max(F.col("odd").cast("int")), F.max("cells")).first()
    if found_odd or most > MAX_SPLIT_COLUMNS:
        return None
    cells = lambda text: next(csv.records(text.encode(), options.but(separator=separator, input_encoding=None)), [])
    own_header = options.assoc and not options.headers
    firsts = [cells(t) for t in sorted(tops)]
    if own_header:
        paths_of = {HeaderPaths.flat(row, options.header_normalizer).paths for row in firsts}
        if len(paths_of) > 1:
            raise InvalidDocument("The files have different headers: " + " and ".join(", ".join(".".join(p) for p in one) for one in sorted(paths_of)[:2]))
    full = HeaderPaths.injected(options.headers, options.header_rows, options.header_normalizer) if options.headers else HeaderPaths.flat(firsts[0], options.header_normalizer) if options.assoc else None
    header = assemble(iter([firsts[0]]), options).header
    return SplitLayout(separator, firsts[0], len(full) if full is not None else most, header, own_header)


#: Columns that Spark's parser takes.
MAX_SPLIT_COLUMNS = 20_000


def split_rows(spark: SparkSession, paths: str | list[str], layout: SplitLayout, options: Options, row_id: bool = False, file_column: bool = False, multi_line: bool = False) -> DataFrame:
    """The data rows of plain CSV files, read in splits.

    The parser's column pruning stays off: with it, ragged rows could not be
    told from whole ones. Row ids are counts of the splits' rows, which are
    written once, since another run may cut other splits.
    """
    schema = T.StructType([*[T.StructField(f"_c{i}", T.StringType()) for i in range(layout.width)], T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("columnPruning", False).csv(
        paths, sep=layout.separator, quote=options.enclosure, escape=options.escape or options.enclosure, header=layout.own_header, enforceSchema=True, multiLine=multi_line,
        emptyValue="", columnNameOfCorruptRecord="_bad", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8", maxCharsPerColumn=-1,
    )
    ragged = F.col("_bad").isNotNull()
    if options.strict:
        cell = lambda i: F.when(ragged, F.raise_error(F.lit(f"Row has another number of columns than {layout.width}")).cast("string")).otherwise(F.coalesce(f"_c{i}", F.lit("")))
    else:  # an empty cell is empty, one beyond the end of a short row is null
        have = _cells(_outside_quotes(_line(F.col("_bad")), layout.separator, options.enclosure), layout.separator)
        cell = lambda i: F.when(ragged & (have <= i), F.lit(None)).otherwise(F.coalesce(f"_c{i}", F.lit("")))
    picked = layout.header.indices if layout.header is not None else range(layout.width)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    out = rows.select(*[cell(i).alias(f"_c{k}") for k, i in enumerate(picked)], *(place if row_id or file_column else ()))
    if row_id:
        out = written(out)
        blocks = out.groupBy("_file", "_block").agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        shifts = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
        out = out.join(shifts, ["_file", "_block"]).withColumn(ROW_ID, F.col("_at") + F.col("_shift"))
    return finish(out, layout.header, options.assoc, row_id, file_column)


def read_csv_splits(spark: SparkSession, paths: str | list[str], options: Options, multi_line: bool = False) -> DataFrame:
    """CSV files read by Spark's own parser without a look at all lines first: for files known to be plain, or with ``multi_line`` one task a file.

    For UTF-8 files with one header row at the top (or none, or given headers),
    in which blank lines do not count. Names, required columns, selection and
    aliases are the engine's own. With ``strict``, a row of another width
    raises. Where names come from the files, a header unlike the others raises.
    """
    if options.header_offset is not None or options.header_rows != 1 or not options.skip_empty_lines or options.input_encoding or options.limit is not None or options.offset:
        raise ValueError("read_csv_splits takes one header row at the top, UTF-8, and neither offset nor limit")
    lines = spark.read.text(paths, lineSep="\n").filter(F.col("value").rlike(r"[^\x00-\x20]"))
    head = lines.limit(1).collect()
    decode = lambda line: csv.decode(line.encode("utf-8", "surrogatepass"), options).removeprefix("\ufeff").rstrip("\r")
    text = decode(head[0][0]) if head else ""
    separator = csv.separator_of(text, options)
    cells = lambda text: next(csv.records(text.encode(), options.but(separator=separator)), [])
    first = cells(text)
    full = HeaderPaths.injected(options.headers, options.header_rows, options.header_normalizer) if options.headers else HeaderPaths.flat(first, options.header_normalizer) if options.assoc else None
    own_header = options.assoc and not options.headers
    if own_header:
        placed = lines.select("_metadata.file_path", "value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
        tops = placed.groupBy("file_path").agg(F.min_by("value", "place").alias("top")).select("top").distinct().collect()
        for own in (HeaderPaths.flat(cells(decode(r["top"])), options.header_normalizer) for r in tops):
            if own.paths != full.paths:
                raise InvalidDocument("The files have different headers: " + ", ".join(full.names) + " and " + ", ".join(own.names))
    width = len(full) if full is not None else len(first)
    layout = SplitLayout(separator, first, width, assemble(iter([first]), options).header, own_header)
    return split_rows(spark, paths, layout, options, multi_line=multi_line)
