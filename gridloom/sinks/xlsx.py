"""XLSX sink."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import IO
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WriteError
from ..functions import columns as C
from ..functions import values as V
from ..options import Options
from ..rowid import ROW_ID, with_row_id
from ..scratch import written
from .pieces import joined, leaves, pieces
from .staged import Staged, stage, write_entry

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOC_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Cell styles: general, date and time, bold, time of day, duration.
DATETIME, BOLD, TIME, DURATION = 1, 2, 3, 4
#: A longer text, in bytes, is written in place even if strings are shared.
SHARED_BYTES = 160
MAX_COLUMN, MAX_ROW = 16_384, 1_048_576
FIRST_SHEET, SHARED_ENTRY = "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def escape(text: str) -> str:
    """Text for XML: control characters dropped, markup escaped."""
    return _CONTROL.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def escape_attribute(text: str) -> str:
    """Text for an XML attribute."""
    return escape(text).replace("'", "&apos;")


def check_sheet_name(name: str) -> str:
    """The name, if a workbook may have it."""
    if not name or len(name) > 31 or re.search(r"[\\/*?:\[\]]", name) or name[0] == "'" or name[-1] == "'" or name.lower() == "history":
        raise ValueError(f"invalid sheet name: {name!r}")
    return name


def sheet_name(options: Options) -> str:
    """The name of the sheet to write."""
    return check_sheet_name(options.sheet) if isinstance(options.sheet, str) else "Sheet1"


def password_hash(password: str) -> str:
    """The legacy verifier of a sheet password: 15-bit rotations over the bytes from the last to the first, then the length."""
    data, key = password.encode(), 0
    for byte in [*reversed(data), len(data)]:
        key = ((key << 1 & 0x7FFF) | (key >> 14 & 1)) ^ byte
    return f"{key ^ 0xCE4B:X}"


def protection_xml(protection: bool | str) -> str:
    """The element that protects a sheet."""
    if protection is False:
        return ""
    return f'<sheetProtection password="{password_hash(protection)}" sheet="1"/>' if isinstance(protection, str) else '<sheetProtection sheet="1"/>'


def freeze_xml(cell: str | None) -> str:
    """The pane that keeps what is above and left of a cell in sight."""
    if not cell:
        return ""
    found = re.fullmatch(r"([A-Z]{1,3})([1-9]\d*)", cell.upper())
    if not found or V.column_index(found[1]) > MAX_COLUMN or int(found[2]) > MAX_ROW:
        raise ValueError(f"invalid freeze pane cell: {cell}")
    across, down = V.column_index(found[1]) - 1, int(found[2]) - 1
    if not across and not down:
        return ""
    pane = "bottomRight" if across and down else "topRight" if across else "bottomLeft"
    split = "".join(f' {name}="{n}"' for name, n in (("xSplit", across), ("ySplit", down)) if n)
    return f'<pane{split} topLeftCell="{cell.upper()}" activePane="{pane}" state="frozen"/>'


def widths_xml(lengths: list[int] | None) -> str:
    """Column widths by the longest text of each column."""
    if not lengths:
        return '<cols><col min="1" max="1024" width="11.5"/></cols>'
    cols = "".join(f'<col min="{i}" max="{i}" width="{max(8, round(n * 1.2 + 2, 2)):g}" customWidth="1"/>' for i, n in enumerate(lengths, 1))
    return f"<cols>{cols}</cols>"


def _number(text: Column, style: int | None = None) -> Column:
    return F.concat(F.lit("<c" + (f' s="{style}"' if style else "") + ' t="n"><v>'), text, F.lit("</v></c>"))


def _text(c: Column) -> Column:
    return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), C.escape_xml(c), F.lit("</t></is></c>"))


#: Distinct strings that the writer of a document keeps in memory, of up to SHARED_BYTES each.
STRINGS_LIMIT = 1_000_000
#: In front of a text that goes to the shared strings; no XML text holds it.
_SHARE = "\x01"


def cell_column(c: Column, kind: T.DataType, options: Options, place: Column | None = None) -> Column:
    """The XML of a cell by its type; a text with a place is the shared string there."""
    if isinstance(kind, T.BooleanType):
        xml = F.concat(F.lit('<c t="b"><v>'), F.when(c, "1").otherwise("0"), F.lit("</v></c>"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        wide = c.cast("double")
        bad = F.isnan(wide) | (F.abs(wide) == float("inf"))
        xml = F.when(bad, F.raise_error(F.lit('gridloom-error:{"kind": "WriteError", "message": "a number must be finite"}')).cast("string")).otherwise(_number(C.double_text(wide)))
    elif isinstance(kind, T.NumericType):
        xml = _number(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        xml = _number(C.double_text(C.timestamp_to_serial(c)), DATETIME)
    elif isinstance(kind, T.DayTimeIntervalType):
        xml = _number(C.double_text(C.duration_to_serial(interval_us(c))), DURATION)
    elif type(kind).__name__ == "TimeType":
        xml = _number(((F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")) / 86_400).cast("string"), TIME)
    elif isinstance(kind, T.StringType):
        text = _text(c)
        if place is not None:
            text = F.when(place.isNotNull(), F.concat(F.lit('<c t="s"><v>'), place.cast("string"), F.lit("</v></c>"))).otherwise(text)
        elif options.shared_strings:
            text = F.when(F.octet_length(c) <= SHARED_BYTES, F.concat(F.lit(_SHARE), F.regexp_replace(c, "[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), F.lit(_SHARE))).otherwise(text)
        xml = F.when(c == "", "<c/>")
        xml = xml.when(C.is_numeric_cell(c), _number(C.trimmed(c))) if options.infer_numeric_strings else xml
        xml = xml.otherwise(text)
    else:
        xml = F.lit("<c/>")
    return F.coalesce(xml, F.lit("<c/>"))


def interval_us(c: Column) -> Column:
    """The microseconds of a day-time interval."""
    return ((F.extract(F.lit("DAY"), c) * 24 + F.extract(F.lit("HOUR"), c)) * 60 + F.extract(F.lit("MINUTE"), c)).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def row_column(cells: DataFrame, options: Options) -> Column:
    """The XML of a row; rows and cells follow one another, so they carry no address."""
    fields = [f for f in cells.schema.fields if f.name.startswith("c")]
    place = lambda name: F.col(f"_s_{name}") if f"_s_{name}" in cells.columns else None
    return F.concat(F.lit("<row>"), *[cell_column(F.col(f.name), f.dataType, options, place(f.name)) for f in fields], F.lit("</row>"))


class Strings:
    """Shared strings in the order in which they are first met; once there are STRINGS_LIMIT, new ones stand in their cells."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}

    def cell(self, text: str) -> str:
        at = self.index.get(text)
        if at is None and len(self.index) >= STRINGS_LIMIT:
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
        return f'<c t="s"><v>{self.index.setdefault(text, len(self.index))}</v></c>'

    def resolve(self, row: str) -> str:
        if _SHARE not in row:
            return row
        parts = row.split(_SHARE)
        return "".join(self.cell(p) if i % 2 else p for i, p in enumerate(parts))

    def items(self) -> str:
        return "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in self.index)

    def opening(self, count: int) -> str:
        return f'{HEAD}<sst xmlns="{MAIN}" count="{count}" uniqueCount="{count}">'

    def write(self, package: zipfile.ZipFile) -> None:
        package.writestr(SHARED_ENTRY, f"{self.opening(len(self.index))}{self.items()}</sst>")


@dataclass
class SharedTable(Strings):
    """Shared strings of which executors found those of the rows; here are the header's, which come first."""

    texts: Staged | None = None

    def __post_init__(self) -> None:
        self.index = {}

    def write(self, package: zipfile.ZipFile) -> None:
        found = sum(s.rows for _, segments in self.texts.files for s in segments)
        write_entry(package, SHARED_ENTRY, (self.opening(len(self.index) + found) + self.items()).encode("utf-8", "replace"), 0, self.texts, b"</sst>")


def shared(cells: DataFrame, rows: list[list[str]], options: Options) -> tuple[DataFrame, SharedTable | None]:
    """The cells with the places of their shared strings (_s_c0, ...), and the table of those, in the order in which they are first met.

    The table is found and joined by executors. It ends at STRINGS_LIMIT;
    further strings have no place and stand in their cells. None where
    executors cannot write files.
    """
    table = SharedTable()
    header_xml(rows, options, table)
    if ROW_ID not in cells.columns:
        cells = written(cells.withColumn(ROW_ID, F.monotonically_increasing_id()))
    texts = [f.name for f in cells.schema.fields if isinstance(f.dataType, T.StringType)]

    def key(name: str) -> Column:
        c = F.col(name)
        fits = (c != "") & (F.octet_length(c) <= SHARED_BYTES)
        if options.infer_numeric_strings:
            fits = fits & ~C.is_numeric_cell(c)
        return F.when(fits, F.regexp_replace(c, "[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))

    spark, taken = cells.sparkSession, [(text, at) for text, at in table.index.items()]
    if texts:
        met = cells.select(ROW_ID, F.inline(F.array(*[F.struct(F.lit(i).alias("_column"), key(n).alias("text")) for i, n in enumerate(texts)]))).filter(F.col("text").isNotNull() & ~F.col("text").isin([t for t, _ in taken]))
        first = met.groupBy("text").agg(F.min(F.struct(ROW_ID, "_column")).alias("_first"))
        found = with_row_id(first.select("text", F.col("_first." + ROW_ID).alias("_row"), "_first._column"), ["_row", "_column"], "_at").select("text", "_at").filter(F.col("_at") < STRINGS_LIMIT - len(taken))
    else:
        found = spark.createDataFrame([], "text string, _at long")
    item = F.concat(F.lit('<si><t xml:space="preserve">'), C.escape_xml(F.col("text")), F.lit("</t></si>"))
    table.texts = stage(found.withColumnRenamed("_at", ROW_ID), item, deflate=True)
    if table.texts is None:
        return cells, None
    places = found.withColumn("_at", F.col("_at") + len(taken)).union(spark.createDataFrame(taken, "text string, _at long"))
    for n in texts:
        cells = cells.withColumn(f"_k_{n}", key(n)).join(places.toDF(f"_k_{n}", f"_s_{n}"), f"_k_{n}", "left").drop(f"_k_{n}")
    return cells, table


def header_xml(rows: list[list[str]], options: Options, strings: Strings | None) -> str:
    """The header rows as XML, bold if asked."""
    style = f' s="{BOLD}"' if options.bold_headers else ""
    out = []
    for row in rows:
        cells = []
        for name in row:
            if name == "":
                cells.append(f"<c{style}/>")
            elif strings is not None and len(name.encode()) <= SHARED_BYTES:
                cells.append(strings.cell(name).replace("<c ", f"<c{style} ", 1))
            else:
                cells.append(f'<c{style} t="inlineStr"><is><t xml:space="preserve">{escape(name)}</t></is></c>')
        out.append("<row>" + "".join(cells) + "</row>")
    return "".join(out)


def shell(cells: DataFrame, header, options: Options) -> tuple[str, list[list[str]], str]:
    """What stands before the rows of the sheet, its header rows, and what stands after."""
    rows = header.header_rows() if options.headers or options.assoc else []
    pane = freeze_xml(options.freeze_pane)
    view = f'<sheetViews><sheetView tabSelected="1" workbookViewId="0">{pane}</sheetView></sheetViews>' if pane else ""
    lengths = None
    if options.auto_width:
        fields = [f for f in cells.schema.fields if f.name != ROW_ID]
        found = cells.agg(*[F.max(F.length(C.stringify(F.col(f.name), f.dataType))).alias(f.name) for f in fields]).first()
        lengths = [max(found[i] or 0, *(len(r[i]) for r in rows if i < len(r)), 0) for i in range(len(fields))]
    filter_ = f'<autoFilter ref="{options.autofilter.upper()}"/>' if options.autofilter and re.fullmatch(r"[A-Za-z]+\d+:[A-Za-z]+\d+", options.autofilter) else ""
    opening = f'{HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{DOC_RELS}">{view}{widths_xml(lengths) if options.auto_width else ""}<sheetData>'
    return opening, rows, f"</sheetData>{protection_xml(options.sheet_protection)}{filter_}</worksheet>"


def _styles() -> str:
    formats = {164: "yyyy-mm-dd hh:mm:ss", 165: "hh:mm:ss", 166: "[h]:mm:ss"}
    cells = ((0, 0), (164, 0), (0, 1), (165, 0), (166, 0))
    return (
        f'{HEAD}<styleSheet xmlns="{MAIN}"><numFmts count="{len(formats)}">' + "".join(f'<numFmt numFmtId="{i}" formatCode="{code}"/>' for i, code in formats.items()) + "</numFmts>"
        '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
        '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
        "<borders count=\"1\"><border><left/><right/><top/><bottom/><diagonal/></border></borders>"
        '<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        f'<cellXfs count="{len(cells)}">' + "".join(f'<xf numFmtId="{n}" fontId="{font}" fillId="0" borderId="0" xfId="0"{" applyNumberFormat=" + chr(34) + "1" + chr(34) if n else ""}{" applyFont=" + chr(34) + "1" + chr(34) if font else ""}/>' for n, font in cells) + "</cellXfs>"
        '<cellStyles count="1"><cellStyle name="Normal" xfId="0" builtinId="0"/></cellStyles></styleSheet>'
    )


def _relationships(items: list[tuple[str, str]]) -> str:
    return f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(items, 1)) + "</Relationships>"


def _core(options: Options) -> str:
    meta, now = options.properties, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    tags = [("dc:title", meta.title), ("dc:subject", meta.subject), ("dc:creator", meta.creator), ("cp:keywords", meta.keywords), ("dc:description", meta.description), ("cp:category", meta.category), ("dc:language", meta.language)]
    said = "".join(f"<{tag}>{escape(v)}</{tag}>" for tag, v in tags if v)
    stamps = "".join(f'<dcterms:{t} xsi:type="dcterms:W3CDTF">{now}</dcterms:{t}>' for t in ("created", "modified"))
    return f'{HEAD}<cp:coreProperties xmlns:cp="{PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{said}{stamps}</cp:coreProperties>'


def write(df: DataFrame, out: IO[bytes], options: Options) -> None:
    """Write a frame as a workbook with one sheet to a stream."""
    sheet_name(options)
    cells, header = leaves(df, options)
    opening, rows, closing = shell(cells, header, options)
    strings = None
    if options.shared_strings:
        cells, strings = shared(cells, rows, options)
    line = row_column(cells, options)
    staged = stage(cells, line, deflate=True)
    document(out, options, opening, rows, pieces(cells, line) if staged is None else staged, closing, strings)


def document(out: IO[bytes], options: Options, opening: str, rows: list[list[str]], lines: Iterator[str] | Staged, closing: str, strings: Strings | SharedTable | None = None) -> None:
    """Write encoded rows, or staged ones, as a workbook to a stream."""
    name = sheet_name(options)
    if options.shared_strings and strings is None:
        strings = Strings()
    ml = "application/vnd.openxmlformats-officedocument"
    office = f"{DOC_RELS}"
    parts = [("/xl/workbook.xml", f"{ml}.spreadsheetml.sheet.main+xml"), ("/xl/worksheets/sheet1.xml", f"{ml}.spreadsheetml.worksheet+xml"), ("/xl/styles.xml", f"{ml}.spreadsheetml.styles+xml"), ("/docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml"), ("/docProps/app.xml", f"{ml}.extended-properties+xml")]
    inner = [(f"{office}/worksheet", "worksheets/sheet1.xml"), (f"{office}/styles", "styles.xml")]
    if strings is not None:
        parts.append(("/xl/sharedStrings.xml", f"{ml}.spreadsheetml.sharedStrings+xml"))
        inner.append((f"{office}/sharedStrings", "sharedStrings.xml"))
    types = "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in parts)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as package:
        package.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        package.writestr("_rels/.rels", _relationships([(f"{office}/officeDocument", "xl/workbook.xml"), (f"{PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml"), (f"{office}/extended-properties", "docProps/app.xml")]))
        package.writestr("docProps/app.xml", f'{HEAD}<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Application>gridloom</Application></Properties>')
        package.writestr("docProps/core.xml", _core(options))
        package.writestr("xl/styles.xml", _styles())
        package.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{DOC_RELS}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        package.writestr("xl/_rels/workbook.xml.rels", _relationships(inner))
        before = (opening + header_xml(rows, options, strings)).encode("utf-8", "replace")
        if isinstance(lines, Staged):
            write_entry(package, FIRST_SHEET, before, len(rows), lines, closing.encode())
        else:
            with package.open(FIRST_SHEET, "w", force_zip64=True) as sheet:
                sheet.write(before)
                for chunk in joined(map(strings.resolve, lines) if isinstance(strings, Strings) else lines):
                    sheet.write(chunk.encode("utf-8", "replace"))
                sheet.write(closing.encode())
        if strings is not None:
            strings.write(package)


__all__ = ["WriteError", "check_sheet_name", "escape", "escape_attribute", "freeze_xml", "password_hash", "protection_xml", "widths_xml", "write"]
