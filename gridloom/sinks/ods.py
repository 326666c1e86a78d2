"""ODS sink."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import IO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..options import Options
from ..rowid import ROW_ID
from ..sources.files import MIME_TYPES
from .pieces import joined, leaves, pieces
from .staged import Staged, stage, write_entry
from .xlsx import escape, escape_attribute, interval_us, sheet_name

_NS = "urn:oasis:names:tc:opendocument:xmlns:"
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
_SPACES = f'xmlns:office="{_NS}office:1.0" xmlns:style="{_NS}style:1.0" xmlns:text="{_NS}text:1.0" xmlns:table="{_NS}table:1.0" xmlns:fo="{_NS}xsl-fo-compatible:1.0" xmlns:number="{_NS}datastyle:1.0" xmlns:meta="{_NS}meta:1.0" xmlns:dc="http://purl.org/dc/elements/1.1/"'
_STYLES = (
    '<number:time-style style:name="nt" number:truncate-on-overflow="true"><number:hours number:style="long"/><number:text>:</number:text><number:minutes number:style="long"/><number:text>:</number:text><number:seconds number:style="long"/></number:time-style>'
    '<number:time-style style:name="nd" number:truncate-on-overflow="false"><number:hours/><number:text>:</number:text><number:minutes number:style="long"/><number:text>:</number:text><number:seconds number:style="long"/></number:time-style>'
    '<style:style style:name="ct" style:family="table-cell" style:data-style-name="nt"/>'
    '<style:style style:name="cd" style:family="table-cell" style:data-style-name="nd"/>'
    '<style:style style:name="cb" style:family="table-cell"><style:text-properties fo:font-weight="bold"/></style:style>'
)


def _typed(kind: str, attribute: str, value: Column, shown: Column, style: str = "") -> Column:
    style = f' table:style-name="{style}"' if style else ""
    return F.concat(F.lit(f'<table:table-cell{style} office:value-type="{kind}" office:{attribute}="'), value, F.lit('"><text:p>'), shown, F.lit("</text:p></table:table-cell>"))


def cell_column(c: Column, kind: T.DataType, options: Options) -> Column:
    """The XML of a cell by its type."""
    empty = "<table:table-cell/>"
    if isinstance(kind, T.BooleanType):
        word = F.when(c, "true").otherwise("false")
        xml = _typed("boolean", "boolean-value", word, word)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        wide = c.cast("double")
        bad = F.isnan(wide) | (F.abs(wide) == float("inf"))
        text = C.double_text(wide)
        xml = F.when(bad, F.raise_error(F.lit('gridloom-error:{"kind": "WriteError", "message": "a number must be finite"}')).cast("string")).otherwise(_typed("float", "value", text, text))
    elif isinstance(kind, T.NumericType):
        xml = _typed("float", "value", c.cast("string"), c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = c.cast("timestamp_ntz")
        micro = F.date_format(at, "SSSSSS")
        lexical = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""))
        xml = _typed("date", "date-value", lexical, lexical)
    elif isinstance(kind, T.DayTimeIntervalType):
        us = interval_us(c)
        xml = _typed("time", "time-value", C.format_iso_duration(us), C.format_duration(us), "cd")
    elif type(kind).__name__ == "TimeType":
        us = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        xml = _typed("time", "time-value", C.format_iso_duration(us), c.cast("string"), "ct")
    elif isinstance(kind, T.StringType):
        text = C.escape_xml(c)
        xml = F.when(c == "", empty)
        xml = xml.when(C.is_numeric_cell(c), _typed("float", "value", C.trimmed(c), C.trimmed(c))) if options.infer_numeric_strings else xml
        xml = xml.otherwise(F.concat(F.lit('<table:table-cell office:value-type="string"><text:p>'), text, F.lit("</text:p></table:table-cell>")))
    else:
        xml = F.lit(empty)
    return F.coalesce(xml, F.lit(empty))


def _header(rows: list[list[str]], options: Options) -> str:
    style = ' table:style-name="cb"' if options.bold_headers else ""
    cell = lambda name: f'<table:table-cell{style} office:value-type="string"><text:p>{escape(name)}</text:p></table:table-cell>' if name else f"<table:table-cell{style}/>"
    return "".join("<table:table-row>" + "".join(map(cell, row)) + "</table:table-row>" for row in rows)


def shell(cells: DataFrame, header, options: Options) -> tuple[str, list[list[str]], str]:
    """What stands before the rows of the table, its header rows, and what stands after."""
    rows = header.header_rows() if options.headers or options.assoc else []
    opening = f'{HEAD}<office:document-content {_SPACES} office:version="1.2"><office:automatic-styles>{_STYLES}</office:automatic-styles><office:body><office:spreadsheet><table:table table:name="{escape_attribute(sheet_name(options))}">'
    return opening, rows, "</table:table></office:spreadsheet></office:body></office:document-content>"


def row_column(cells: DataFrame, options: Options) -> Column:
    """The XML of a row."""
    fields = [f for f in cells.schema.fields if f.name != ROW_ID]
    return F.concat(F.lit("<table:table-row>"), *[cell_column(F.col(f.name), f.dataType, options) for f in fields], F.lit("</table:table-row>"))


def _meta(options: Options) -> str:
    meta, now = options.properties, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    tags = [("dc:title", meta.title), ("dc:subject", meta.subject), ("dc:creator", meta.creator), ("dc:description", meta.description), ("dc:language", meta.language), ("meta:initial-creator", meta.creator)]
    tags += [("meta:keyword", k.strip()) for k in (meta.keywords or "").split(",")]
    said = "".join(f"<{t}>{escape(v)}</{t}>" for t, v in tags if v)
    if meta.category:
        said += f'<meta:user-defined meta:name="category">{escape(meta.category)}</meta:user-defined>'
    return f'{HEAD}<office:document-meta {_SPACES} office:version="1.2"><office:meta>{said}<meta:creation-date>{now}</meta:creation-date></office:meta></office:document-meta>'


def write(df: DataFrame, out: IO[bytes], options: Options) -> None:
    """Write a frame as a workbook with one table to a stream."""
    cells, header = leaves(df, options)
    opening, rows, closing = shell(cells, header, options)
    line = row_column(cells, options)
    staged = stage(cells, line, deflate=True)
    document(out, options, opening, rows, pieces(cells, line) if staged is None else staged, closing)


def document(out: IO[bytes], options: Options, opening: str, rows: list[list[str]], lines: Iterator[str] | Staged, closing: str) -> None:
    """Write encoded rows, or staged ones, as a workbook to a stream."""
    mime = MIME_TYPES["ods"]
    files = "".join(f'<manifest:file-entry manifest:full-path="{p}" manifest:media-type="{t}"/>' for p, t in (("/", mime), ("content.xml", "text/xml"), ("meta.xml", "text/xml"), ("styles.xml", "text/xml")))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as package:
        package.writestr(zipfile.ZipInfo("mimetype"), mime, zipfile.ZIP_STORED)
        package.writestr("META-INF/manifest.xml", f'{HEAD}<manifest:manifest xmlns:manifest="{_NS}manifest:1.0" manifest:version="1.2">{files}</manifest:manifest>')
        package.writestr("meta.xml", _meta(options))
        package.writestr("styles.xml", f'{HEAD}<office:document-styles {_SPACES} office:version="1.2"><office:styles/></office:document-styles>')
        before = (opening + _header(rows, options)).encode("utf-8", "replace")
        if isinstance(lines, Staged):
            write_entry(package, "content.xml", before, len(rows), lines, closing.encode())
            return
        with package.open("content.xml", "w", force_zip64=True) as content:
            content.write(before)
            for chunk in joined(lines):
                content.write(chunk.encode("utf-8", "replace"))
            content.write(closing.encode())
