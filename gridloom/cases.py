"""Queries over small documents that the engine did not write, and over what it refuses.

Each gives rows (case, result); the SQL has the results as they are known from
the formats and from the behaviour to match.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import facade, scratch
from .errors import EngineError, InvalidRow, typed_errors
from .functions import values as V
from .operators import transforms as X
from .options import make_options
from .plans.headers import HeaderPaths, first_places
from .registry import query
from .rowid import with_row_id
from .sinks import xlsx as xlsx_sink
from .sources import metadata
from .sources.files import check_path

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_ODF = "urn:oasis:names:tc:opendocument:xmlns:"
_ODF_SPACES = " ".join(f'xmlns:{k}="{_ODF}{v}"' for k, v in (("office", "office:1.0"), ("table", "table:1.0"), ("text", "text:1.0"), ("style", "style:1.0"), ("number", "datastyle:1.0")))


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        for name, text in files.items():
            package.writestr(name, text)
    return out.getvalue()


def _xlsx(body: str, **more: str) -> bytes:
    names = {"styles": "xl/styles.xml", "strings": "xl/sharedStrings.xml", "book": "xl/workbook.xml"}
    return _zip({"xl/worksheets/sheet1.xml": f"<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>", **{names[k]: v for k, v in more.items()}})


def _ods(rows: str, styles: str = "") -> bytes:
    content = f'<office:document-content {_ODF_SPACES}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:spreadsheet><table:table table:name="A">{rows}</table:table></office:spreadsheet></office:body></office:document-content>'
    return _zip({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": content})


def _shown(rows: list[Any]) -> str:
    return "; ".join("|".join("~" if c is None else str(c) for c in row) for row in rows)


def _rows(spark: SparkSession, content: bytes, kind: str | None = None, **options: Any) -> Callable[[], str]:
    return lambda: _shown(facade.read_bytes(spark, content, kind, **options).collect())


def _outcome(run: Callable[[], Any]) -> str:
    """What a call gives, or the class of its error, with the row or columns that it names."""
    try:
        with typed_errors():
            return str(run())
    except InvalidRow as error:
        return f"InvalidRow {error.row}" + (f" {error.column}" if error.column else "") if error.row else "InvalidRow"
    except (EngineError, ValueError) as error:
        columns = getattr(error, "columns", None)
        return type(error).__name__ + (f" {','.join(columns)}" if columns else "")


def _cases(spark: SparkSession, cases: dict[str, Callable[[], Any]]) -> DataFrame:
    return spark.createDataFrame([(name, _outcome(run)) for name, run in cases.items()], "case string, result string")


def _values(results: dict[str, str]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in results.items()) + ") t(\"case\", result)"


@query(_values({
    "csv": "InvalidRow 2", "xlsx": "InvalidRow 2", "ods": "InvalidRow 2", "csv header": "InvalidRow 1", "csv even": "1|2; 3|4", "xlsx lax": "1|~; 1|2", "open quote": "InvalidRow", "write": "InvalidRow 1",
}))
def strict_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another width raise in strict mode, in each format."""
    x = _xlsx("<row><c><v>1</v></c></row><row><c><v>1</v></c><c><v>2</v></c></row>")
    cell = '<table:table-cell office:value-type="string"><text:p>x</text:p></table:table-cell>'
    o = _ods(f"<table:table-row>{cell}{cell}</table:table-row><table:table-row>{cell}</table:table-row>")
    pair = spark.createDataFrame([("a", "b")], "x string, y string")
    return _cases(spark, {
        "csv": _rows(spark, b"1,2\n1,2,3\n", strict=True), "xlsx": _rows(spark, x, strict=True), "ods": _rows(spark, o, strict=True),
        "csv header": _rows(spark, b"a,b\n1\n", strict=True, assoc=True), "csv even": _rows(spark, b"1,2\n3,4\n", strict=True), "xlsx lax": _rows(spark, x),
        "open quote": _rows(spark, b'a,b\n"1,2\n', strict=True), "write": lambda: facade.write_bytes(pair, "csv", headers=["x"], strict=True),
    })


@query(_values({
    "format": "UnsupportedFormat", "reader": "UnsupportedFormat", "writer": "UnsupportedFormat", "any case": "csv", "missing": "MissingColumn b,d.e", "selected": "MissingColumn z", "twice": "InvalidDocument", "prefix": "InvalidDocument",
    "no header": "InvalidDocument", "offset": "ValueError", "limit": "ValueError", "separator": "ValueError", "enclosure": "ValueError", "header rows": "ValueError", "auto": "ValueError", "sheet index": "SheetNotFound", "sheet name": "SheetNotFound",
    "no package": "InvalidDocument", "entities": "InvalidDocument", "too large": "InvalidDocument", "broken": "InvalidDocument", "scheme": "ValueError", "filter": "ValueError", "store": "s3a://b/x.csv",
    "mark": "ValueError", "infinite": "WriteError", "name": "ValueError", "long name": "ValueError", "pane": "ValueError", "chunk": "ValueError", "slice": "ValueError", "strict cast": "InvalidRow 2 n", "empty cast": "InvalidRow 1 n", "lax cast": "1; 0; 0", "duration": "ValueError",
}))
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and with which error."""
    csv, rows = b"a,c\n1,2\n", with_row_id(spark.createDataFrame([(0, "1"), (1, ""), (2, "x")], "k int, n string"), "k")
    book = _xlsx("<row><c><v>1</v></c></row>", book=f'<workbook {_MAIN} xmlns:r="r"><sheets><sheet name="S" r:id="i"/></sheets></workbook>')
    cast = lambda part: X.cast_strict({"n": "int"})(part).select("n").collect()
    return _cases(spark, {
        "format": lambda: facade.read(spark, "/x/y.pdf"), "reader": lambda: facade.reader("doc"), "writer": lambda: facade.writer("xls"), "any case": lambda: "csv" if facade.reader("CsV") else "",
        "missing": _rows(spark, csv, assoc=True, required_columns=["a", "b", {"d": ["e"]}]), "selected": _rows(spark, csv, assoc=True, columns=["a", "z"]), "twice": _rows(spark, b"a,a\n1,2\n", assoc=True),
        "prefix": lambda: HeaderPaths.from_definition([("a",), ("a", "b")]), "no header": _rows(spark, csv, assoc=True, header_offset="auto", required_columns=["q"]),
        "offset": lambda: make_options(offset=-1), "limit": lambda: make_options(limit=-1), "separator": lambda: make_options(separator=",,"), "enclosure": lambda: make_options(enclosure=""), "header rows": lambda: make_options(header_rows=0),
        "auto": _rows(spark, csv, header_offset="auto"), "sheet index": _rows(spark, book, sheet=3), "sheet name": _rows(spark, book, sheet="T"), "no package": _rows(spark, b"PK\x03\x04nothing", "xlsx"),
        "entities": _rows(spark, _zip({"xl/worksheets/sheet1.xml": '<!DOCTYPE x [<!ENTITY a "b">]><worksheet><sheetData><row><c><v>&a;</v></c></row></sheetData></worksheet>'})),
        "too large": _rows(spark, book, max_worksheet_size=10), "broken": _rows(spark, _xlsx("<row><c>")), "scheme": lambda: check_path("phar://x.csv"), "filter": lambda: check_path("php://filter/x"), "store": lambda: check_path("s3a://b/x.csv"),
        "mark": lambda: facade.write_bytes(rows, "csv", bom="utf-16-le", output_encoding="utf-8"), "infinite": lambda: facade.write_bytes(spark.createDataFrame([(float("inf"),)], "x double"), "ods"),
        "name": lambda: facade.write_bytes(rows, "xlsx", sheet="a/b"), "long name": lambda: facade.write_bytes(rows, "xlsx", sheet="x" * 32), "pane": lambda: facade.write_bytes(rows, "xlsx", freeze_pane="A0"),
        "chunk": lambda: X.chunk(0)(rows), "slice": lambda: X.slice_rows(-1)(rows), "strict cast": lambda: cast(rows.filter("k <> 1")),
        "empty cast": lambda: cast(rows.filter("k = 1")), "lax cast": lambda: _shown(X.cast({"n": "int"})(rows).orderBy("k").select("n").collect()), "duration": lambda: V.serial_to_duration(float("inf")),
    })


_STYLES = f'<styleSheet {_MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="[h]:mm:ss"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="21"/><xf numFmtId="165"/><xf numFmtId="22"/></cellXfs></styleSheet>'


@query(_values({
    "text": "46233|2026-07-30|2026-07-30 12:00:00|12:00:00|1|#REF!", "native": "46233|2026-07-30 00:00:00|2026-07-30 12:00:00|12:00:00|36:00:00|True|#REF!|2024-01-02 03:04:05",
    "base 1904": "1904-01-01", "leap day": "1900-02-28; 1900-03-01", "strings": "  lead  |Hello World|~|   ; VALUE 1 VALUE 2|~|~|~", "gaps": "~|1|~|~; ~|~|~|z", "sniffed": "1", "selected": "c|a",
}))
def foreign_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks as other programs write them."""
    body = '<row><c s="0"><v>46233</v></c><c s="1"><v>46233</v></c><c s="1"><v>46233.5</v></c><c s="2"><v>0.5</v></c>'
    native = '<c s="3"><v>1.5</v></c><c t="b"><v>1</v></c><c t="e"><v>#REF!</v></c><c t="d"><v>2024-01-02T03:04:05Z</v></c></row>'
    strings = f'<sst {_MAIN}><si><t xml:space="preserve">  lead  </t></si><si><r><t>Hello</t></r><r><t> World</t></r><rPh><t>x</t></rPh></si><si/><si><t xml:space="preserve">   </t></si></sst>'
    shared = '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>2</v></c><c t="s"><v>3</v></c></row><row><c t="inlineStr"><is><r><t>VALUE 1</t></r><r><t> VALUE 2</t></r></is></c></row>'
    named = '<row><c t="str"><v>a</v></c><c t="str"><v>b</v></c><c t="str"><v>c</v></c></row><row><c t="str"><v>a</v></c><c t="str"><v>b</v></c><c t="str"><v>c</v></c></row>'
    empty = lambda run: lambda: run().replace("||", "|~|")
    return _cases(spark, {
        "text": _rows(spark, _xlsx(body + '<c t="b"><v>1</v></c><c t="e"><v>#REF!</v></c></row>', styles=_STYLES)), "native": _rows(spark, _xlsx(body + native, styles=_STYLES), stringify_values=False),
        "base 1904": _rows(spark, _xlsx('<row><c s="1"><v>0</v></c></row>', styles=_STYLES, book=f'<workbook {_MAIN}><workbookPr date1904="1"/></workbook>')),
        "leap day": _rows(spark, _xlsx('<row><c s="1"><v>59</v></c></row><row><c s="1"><v>61</v></c></row>', styles=_STYLES)), "strings": empty(_rows(spark, _xlsx(shared, strings=strings))),
        "gaps": _rows(spark, _xlsx('<row><c r="B1"><v>1</v></c></row><row/><row r="3"><c r="D3" t="str"><v>z</v></c></row>')), "sniffed": _rows(spark, _xlsx("<row><c><v>1</v></c></row>"), None), "selected": _rows(spark, _xlsx(named), assoc=True, columns=["c", "a"]),
    })


@query(_values({
    "native": "1.5|True|1976-11-22 08:30:00|1976-02-30T08:30:00|12:00:00|12:00:00|-1:00:00|01:30:00|30:00:00|x", "text": "1.5|1|1976-11-22T08:30:00+02:00|1976-02-30T08:30:00|PT12H|PT12H|-PT1H|PT90M|PT30H|x",
    "repeats": "x|x; x|x; x|x", "too many": "InvalidDocument", "nameless sheet": "SheetNotFound", "paragraphs": "b & c|~", "sheets": "A",
}))
def foreign_ods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ODS as other programs write it; a style tells a time of day from an elapsed one."""

    def cell(kind: str, attribute: str = "", value: str = "", text: str = "", style: str = "") -> str:
        return f'<table:table-cell{style} office:value-type="{kind}"' + (f' office:{attribute}="{value}"' if attribute else "") + f"><text:p>{text}</text:p></table:table-cell>"

    time = lambda value, style="": cell("time", "time-value", value, style=f' table:style-name="{style}"' if style else "")
    row = cell("float", "value", "1.5") + cell("boolean", "boolean-value", "true") + cell("date", "date-value", "1976-11-22T08:30:00+02:00") + cell("date", "date-value", "1976-02-30T08:30:00")
    row += time("PT12H", "t") + time("PT12H", "d") + time("-PT1H") + time("PT90M") + time("PT30H", "d") + cell("string", text="x")
    styles = '<number:time-style style:name="nt"/><number:time-style style:name="nd" number:truncate-on-overflow="false"/><style:style style:name="t" style:family="table-cell" style:data-style-name="nt"/><style:style style:name="d" style:family="table-cell" style:data-style-name="nd"/>'
    x = '<table:table-cell table:number-columns-repeated="2" office:value-type="string"><text:p>x</text:p></table:table-cell>'
    typed = _ods(f"<table:table-row>{row}</table:table-row>", styles)
    repeats = _ods(f'<table:table-row table:number-rows-repeated="3">{x}<table:table-cell table:number-columns-repeated="500"/></table:table-row><table:table-row table:number-rows-repeated="1000000"><table:table-cell/></table:table-row>')
    said = _ods('<table:table-row><table:table-cell office:value-type="string"><text:p>a</text:p><text:p>b <text:span>&amp;</text:span> c</text:p></table:table-cell><table:table-cell/></table:table-row>')
    return _cases(spark, {
        "native": _rows(spark, typed, stringify_values=False), "text": _rows(spark, typed), "repeats": _rows(spark, repeats), "too many": _rows(spark, _ods(f'<table:table-row table:number-rows-repeated="20000">{x}</table:table-row>')),
        "nameless sheet": _rows(spark, typed, sheet="Z"), "paragraphs": _rows(spark, said), "sheets": lambda: ",".join(metadata.sheets_of(typed)),
    })


def _part(spark: SparkSession, name: str, pattern: str, **options: Any) -> Callable[[], str]:
    rows = with_row_id(spark.createDataFrame([(1, "x"), (2, "a long text of 24 letters")], "k int, n string"), "k")

    def run() -> str:
        with zipfile.ZipFile(io.BytesIO(facade.write_bytes(rows, "xlsx", assoc=True, **options))) as package:
            found = re.search(pattern, package.read(name).decode())
        return found[0] if found else "none"

    return run


_SHEET = "xl/worksheets/sheet1.xml"


@query(_values({
    "pane": '<pane xSplit="1" ySplit="1" topLeftCell="B2" activePane="bottomRight" state="frozen"/>', "pane below": '<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/>', "no pane": "none",
    "filter": '<autoFilter ref="A1:B3"/>', "no filter": "none", "protection": '<sheetProtection sheet="1"/>', "password": '<sheetProtection password="83AF" sheet="1"/>',
    "widths": '<cols><col min="1" max="1" width="8" customWidth="1"/><col min="2" max="2" width="32" customWidth="1"/></cols>', "strings": 'count="4" uniqueCount="4"', "sheet": 'name="Data"', "title": "<dc:title>A &amp; B</dc:title>",
}))
def sheet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panes, filters, protection, widths and shared strings in the parts of a written workbook."""
    pane, filter_, lock = "<pane[^>]*/>", "<autoFilter[^>]*/>", "<sheetProtection[^>]*/>"
    return _cases(spark, {
        "pane": _part(spark, _SHEET, pane, freeze_pane="b2"), "pane below": _part(spark, _SHEET, pane, freeze_pane="A2"), "no pane": _part(spark, _SHEET, pane, freeze_pane="A1"),
        "filter": _part(spark, _SHEET, filter_, autofilter="a1:b3"), "no filter": _part(spark, _SHEET, filter_, autofilter="nothing"), "protection": _part(spark, _SHEET, lock, sheet_protection=True), "password": _part(spark, _SHEET, lock, sheet_protection="password"),
        "widths": _part(spark, _SHEET, "<cols>.*</cols>", auto_width=True), "strings": _part(spark, "xl/sharedStrings.xml", 'count="[0-9]+" uniqueCount="[0-9]+"', shared_strings=True),
        "sheet": _part(spark, "xl/workbook.xml", 'name="[^"]*"', sheet="Data"), "title": _part(spark, "docProps/core.xml", "<dc:title>.*</dc:title>", meta={"title": "A & B"}),
    })


@query(_values({
    "time": "23:59:59.999999", "time of micros": "01:02:03", "hour": "ValueError", "micros": "ValueError", "micros back": "3723000004", "duration": "-30:01:00", "zero": "0:00:00", "minutes": "ValueError", "hours": "ValueError",
    "letters": "Y,Z,AA,AB", "first of equal": "0,2", "not there": "MissingColumn z", "by place": "c|a; 3|1", "limit 0": "0", "guard": "'=x; a", "media": "text/csv|attachment; filename=\"x.csv\"", "temp folder": "True",
}))
def small_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V13, V13b, V21, H18, H19, L2, U5, W3, W8, W27 and the temp folder of writers."""
    texts = spark.createDataFrame([("=x",), ("a",)], "t string")
    folder = scratch.scratch_folder(spark)

    def guarded() -> str:
        content = facade.write_bytes(texts, "csv", bom=False, eol="\n", escape_formulas=lambda c, i: F.when(c.startswith("="), F.concat(F.lit("'"), c)).otherwise(c))
        return "; ".join(content.decode().split())

    def media() -> str:
        kind, headers, _ = facade.download(texts, "x", "csv")
        return f"{kind}|{headers['Content-Disposition']}"

    def built_elsewhere() -> bool:
        import os
        import tempfile

        with tempfile.TemporaryDirectory() as place:
            path = facade.write(texts, os.path.join(place, "x.ods"), temp_path=place)
            return os.listdir(place) == ["x.ods"] and path.endswith("x.ods") and bool(folder)

    return _cases(spark, {
        "time": lambda: V.TimeValue(23, 59, 59, 999_999), "time of micros": lambda: V.TimeValue.of_micros(3_723_000_000), "hour": lambda: V.TimeValue(24), "micros": lambda: V.TimeValue.of_micros(86_400_000_000), "micros back": lambda: V.TimeValue(1, 2, 3, 4).micros,
        "duration": lambda: V.DurationValue(30, 1, negative=True), "zero": lambda: V.DurationValue(0, negative=True), "minutes": lambda: V.DurationValue(1, 60), "hours": lambda: V.DurationValue(-1),
        "letters": lambda: ",".join(V.column_range("Y", "AB")), "first of equal": lambda: ",".join(map(str, first_places(["a", "b"], ["a", "a", "b", "a"]))), "not there": lambda: first_places(["z"], ["a"]),
        "by place": _rows(spark, b"a,b,c\n1,2,3\n", headers=["a", "b", "c"], columns=["c", "a"]), "limit 0": lambda: facade.read_bytes(spark, b"a\n1\n", assoc=True, limit=0).count(), "guard": guarded, "media": media, "temp folder": built_elsewhere,
    })


__all__ = ["errors", "foreign_ods", "foreign_workbooks", "sheet_features", "small_parts", "strict_widths", "xlsx_sink"]
