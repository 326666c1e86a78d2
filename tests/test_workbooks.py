import io
import zipfile
from datetime import datetime, timedelta

import pytest

from gridloom import facade
from gridloom.errors import InvalidDocument, SheetNotFound, WriteError, typed_errors
from gridloom.options import make_options
from gridloom.rowid import with_row_id
from gridloom.sinks import xlsx as sink
from gridloom.sources import metadata
from gridloom.sources.frames import decoded

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
ODF = "urn:oasis:names:tc:opendocument:xmlns:"


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def sheet(body, **more):
    return zipped(**{"xl/worksheets/sheet1.xml": f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>", **more})


def ods(rows, styles=""):
    space = " ".join(f'xmlns:{k}="{ODF}{v}"' for k, v in (("office", "office:1.0"), ("table", "table:1.0"), ("text", "text:1.0"), ("style", "style:1.0"), ("number", "datastyle:1.0")))
    return zipped(**{"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": f'<office:document-content {space}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:spreadsheet><table:table table:name="A">{rows}</table:table><table:table table:name="B"><table:table-row><table:table-cell office:value-type="string"><text:p>b</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'})


def got(content, kind="xlsx", **options):
    return list(decoded(content, kind, make_options(**options)).rows)


def test_shared_and_inline_strings():
    strings = f'<sst {NS}><si><t xml:space="preserve">  lead  </t></si><si><r><t>Hello</t></r><r><t> World</t></r><rPh><t>x</t></rPh></si><si/><si><t xml:space="preserve">   </t></si></sst>'
    body = '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>2</v></c><c t="s"><v>3</v></c><c t="s"><v>9</v></c></row><row><c t="inlineStr"><is><r><t>VALUE 1</t></r><r><t> VALUE 2</t></r></is></c></row>'
    assert got(sheet(body, **{"xl/sharedStrings.xml": strings})) == [["  lead  ", "Hello World", "", "   ", ""], ["VALUE 1 VALUE 2"]]


def test_gaps_and_empty_rows():
    body = '<row><c r="B1"><v>1</v></c><c r="D1"/></row><row/><row><c r="A3"/></row>'
    assert got(sheet(body)) == [[None, "1", None, ""]]
    assert len(got(sheet(body), skip_empty_lines=False)) == 3
    with pytest.raises(InvalidDocument):
        got(sheet('<row><c r="XFE1"><v>1</v></c></row>'))


def test_number_formats():
    styles = f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="[h]:mm:ss"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="21"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    body = '<row><c s="0"><v>46233</v></c><c s="1"><v>46233</v></c><c s="1"><v>46233.5</v></c><c s="2"><v>0.5</v></c><c s="3"><v>1.5</v></c><c t="b"><v>1</v></c><c t="e"><v>#REF!</v></c><c t="d"><v>2024-01-02T03:04:05Z</v></c></row>'
    content = sheet(body, **{"xl/styles.xml": styles})
    assert got(content)[0][:4] == ["46233", "2026-07-30", "2026-07-30 12:00:00", "12:00:00"]
    assert got(content, stringify_values=False) == [[46233, datetime(2026, 7, 30), datetime(2026, 7, 30, 12), "12:00:00", "36:00:00", True, "#REF!", datetime(2024, 1, 2, 3, 4, 5)]]
    book = f'<workbook {NS}><workbookPr date1904="1"/></workbook>'
    assert got(sheet('<row><c s="1"><v>0</v></c></row>', **{"xl/styles.xml": styles, "xl/workbook.xml": book})) == [["1904-01-01"]]
    inherit = '<row><c s="1" t="n"><v>46233</v></c></row><row><c t="n"><v>46234</v></c></row><row><c><v>46235</v></c></row>'
    assert got(sheet(inherit, **{"xl/styles.xml": styles})) == [["2026-07-30"], ["2026-07-31"], ["46235"]]


def test_guards():
    with pytest.raises(InvalidDocument):
        got(b"PK\x03\x04 nonsense")
    with pytest.raises(InvalidDocument, match="declarations"):
        got(zipped(**{"xl/worksheets/sheet1.xml": '<!DOCTYPE x [<!ENTITY a "b">]><worksheet><sheetData><row><c><v>&a;</v></c></row></sheetData></worksheet>'}))
    with pytest.raises(InvalidDocument, match="limit"):
        got(sheet("<row><c><v>1</v></c></row>"), max_worksheet_size=10)
    with pytest.raises(InvalidDocument):
        got(sheet("<row><c>"))
    with pytest.raises(InvalidDocument):
        got(zipped(x="y"))


def test_ods_cells():
    cell = lambda kind, attribute="", value="", text="", style="": f'<table:table-cell{style} office:value-type="{kind}"' + (f' office:{attribute}="{value}"' if attribute else "") + f"><text:p>{text}</text:p></table:table-cell>"
    row = cell("float", "value", "1.5") + cell("boolean", "boolean-value", "true") + cell("date", "date-value", "1976-11-22T08:30:00+02:00") + cell("date", "date-value", "1976-02-30T08:30:00") + cell("time", "time-value", "PT12H", style=' table:style-name="t"') + cell("time", "time-value", "PT12H", style=' table:style-name="d"') + cell("time", "time-value", "-PT1H") + cell("time", "time-value", "PT90M") + cell("string", text="x")
    styles = '<number:time-style style:name="nt"/><number:time-style style:name="nd" number:truncate-on-overflow="false"/><style:style style:name="t" style:family="table-cell" style:data-style-name="nt"/><style:style style:name="d" style:family="table-cell" style:data-style-name="nd"/>'
    content = ods(f"<table:table-row>{row}</table:table-row>", styles)
    assert got(content, "ods", stringify_values=False) == [[1.5, True, datetime(1976, 11, 22, 8, 30), "1976-02-30T08:30:00", "12:00:00", "12:00:00", "-1:00:00", "01:30:00", "x"]]
    assert got(content, "ods") == [["1.5", "1", "1976-11-22T08:30:00+02:00", "1976-02-30T08:30:00", "PT12H", "PT12H", "-PT1H", "PT90M", "x"]]


def test_ods_repeats_and_sheets():
    x = '<table:table-cell table:number-columns-repeated="2" office:value-type="string"><text:p>x</text:p></table:table-cell>'
    content = ods(f'<table:table-row table:number-rows-repeated="3">{x}<table:table-cell table:number-columns-repeated="500"/></table:table-row><table:table-row table:number-rows-repeated="1000000"><table:table-cell/></table:table-row>')
    assert got(content, "ods") == [["x", "x"]] * 3
    assert got(content, "ods", sheet="B") == [["b"]] == got(content, "ods", sheet=1)
    for missing in ("C", 7):
        with pytest.raises(SheetNotFound):
            got(content, "ods", sheet=missing)
    with pytest.raises(InvalidDocument):
        got(ods(f'<table:table-row table:number-rows-repeated="20000">{x}</table:table-row>'), "ods")
    assert metadata.sheets_of(content) == ["A", "B"]


@pytest.fixture
def matrix(spark):
    day = datetime(2024, 1, 2)
    rows = [(0, 123, 12.5, "123", "00123", True, day, day.replace(hour=14, microsecond=5), timedelta(hours=36, minutes=30), None), (1, -1, 2.0, "x <&> 'y'", "", False, day, day, timedelta(hours=-1), "z")]
    return with_row_id(spark.createDataFrame(rows, "k int, i long, f double, n string, s string, b boolean, d timestamp_ntz, m timestamp_ntz, e interval day to second, u string"), "k")


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
def test_round_trip(spark, matrix, kind):
    content = facade.write_bytes(matrix, kind, assoc=True)
    back = facade.read_bytes(spark, content, assoc=True, stringify_values=False)
    assert dict(back.dtypes) == {"k": "bigint", "i": "bigint", "f": "double", "n": "string", "s": "string", "b": "boolean", "d": "timestamp_ntz", "m": "timestamp_ntz", "e": "string", "u": "string"}
    first, second = back.collect()
    assert first[1:6] == (123, 12.5, "123", "00123", True) and first["d"] == datetime(2024, 1, 2) and first["e"] == "36:30:00"
    assert abs(first["m"] - datetime(2024, 1, 2, 14, 0, 0, 5)) < timedelta(microseconds=2)
    assert second["n"] == "x <&> 'y'" and second["e"] == "-1:00:00" and second["u"] == "z" and not second["b"]
    text = facade.read_bytes(spark, content, assoc=True)
    assert set(dict(text.dtypes).values()) == {"string"} and text.first()["b"] == "1"


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
def test_nested_headers_and_selection(spark, kind):
    df = spark.createDataFrame([(("1", "a"), "x")], "P struct<id:string,n:string>, note string")
    content = facade.write_bytes(df, kind, headers={"P": ["id", "n"], "note": None}, bold_headers=True)
    back = facade.read_bytes(spark, content, assoc=True, header_rows=2, columns={"note": None, "P": ["n"]}, aliases={"note": "remark"})
    assert [r.asDict(True) for r in back.collect()] == [{"remark": "x", "P": {"n": "a"}}]


def test_xlsx_features(spark, matrix):
    content = facade.write_bytes(matrix.select("k", "n", "_row_id"), "xlsx", assoc=True, shared_strings=True, auto_width=True, freeze_pane="b2", autofilter="A1:B3", sheet_protection="x", sheet="Data", meta={"title": "T", "creator": "Ann"})
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert z.testzip() is None
        xml = z.read("xl/worksheets/sheet1.xml").decode()
        strings = z.read("xl/sharedStrings.xml").decode()
    for part in ('xSplit="1" ySplit="1" topLeftCell="B2" activePane="bottomRight"', '<autoFilter ref="A1:B3"/>', "<sheetProtection password=", "<cols>"):
        assert part in xml
    assert 'count="3" uniqueCount="3"' in strings and "x &lt;&amp;&gt; &apos;y&apos;".replace("&apos;", "'") in strings
    assert metadata.properties_of(content)["title"] == "T" and metadata.properties_of(content)["creator"] == "Ann" and metadata.sheets_of(content) == ["Data"]
    assert [r["n"] for r in facade.read_bytes(spark, content, assoc=True, sheet="Data").collect()] == ["123", "x <&> 'y'"]
    with pytest.raises(SheetNotFound):
        facade.read_bytes(spark, content, sheet="Nope")


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
def test_folder_of_documents(spark, tmp_path, kind):
    rows = with_row_id(spark.range(95).selectExpr("id AS n", "concat('t', id) AS t", "id % 2 = 0 AS even").repartition(3), "n")
    folder = facade.write_parts(rows, str(tmp_path / "parts"), kind, rows=10, assoc=True, shared_strings=True, bold_headers=True)
    files = sorted(p.name for p in (tmp_path / "parts").iterdir())
    assert len(files) >= 10 and all(f.endswith(kind) for f in files)
    back = facade.read(spark, folder, format=kind, assoc=True, stringify_values=False)
    assert sorted(map(tuple, back.collect())) == [(i, f"t{i}", i % 2 == 0) for i in range(95)]
    first = [facade.read(spark, f"{folder}/{f}", assoc=True, stringify_values=False).agg({"n": "min"}).first()[0] for f in files[:3]]
    assert first == sorted(first)
    assert facade.write_parts(rows.limit(0), str(tmp_path / "none"), kind) and not [p for p in (tmp_path / "none").glob("*") if p.suffix]


def test_sheet_parts():
    assert sink.freeze_xml("A2") == '<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/>' and sink.freeze_xml("A1") == "" and "topRight" in sink.freeze_xml("B1")
    for bad in ("A0", "XFE1", "1A", "A1048577"):
        with pytest.raises(ValueError):
            sink.freeze_xml(bad)
    assert sink.protection_xml(True) == '<sheetProtection sheet="1"/>' and sink.password_hash("password") == "83AF"
    for bad in ("", "x" * 32, "a/b", "'a", "History", "a:b"):
        with pytest.raises(ValueError):
            sink.check_sheet_name(bad)
    assert sink.widths_xml([3, 20]) == '<cols><col min="1" max="1" width="8" customWidth="1"/><col min="2" max="2" width="26" customWidth="1"/></cols>'
    assert sink.escape_attribute("a'\x00<") == "a&apos;&lt;"


def test_numbers_must_be_finite(spark):
    for kind in ("xlsx", "ods"):
        with pytest.raises(WriteError), typed_errors():
            facade.write_bytes(spark.createDataFrame([(float("inf"),)], "x double"), kind)


def test_kinds_of_columns(spark):
    body = '<row><c><v>1</v></c><c><v>1</v></c></row><row><c><v>2.5</v></c><c t="str"><v>x</v></c></row>'
    df = facade.read_bytes(spark, sheet(body), "xlsx", stringify_values=False)
    assert [tuple(r) for r in df.collect()] == [(1.0, "1"), (2.5, "x")]


def test_strict_width(spark):
    from gridloom.errors import InvalidRow

    with pytest.raises(InvalidRow):
        facade.read_bytes(spark, sheet("<row><c><v>1</v></c></row><row><c><v>1</v></c><c><v>2</v></c></row>"), "xlsx", strict=True)


def test_guarded_files(spark, tmp_path):
    path = facade.write(spark.createDataFrame([("a",)], "x string"), str(tmp_path / "x.ods"))
    assert metadata.sheet_names(spark, path) == ["Sheet1"] and metadata.properties(spark, path)["format"] == "ods"
    assert metadata.properties_frame(spark, path).first()["n_sheets"] == 1
    with pytest.raises(InvalidDocument):
        facade.read_bytes(spark, b"PK\x03\x04broken", "xlsx")


@pytest.mark.parametrize(
    "body",
    [
        '<row r="1"><c r="A1" s="0" t="str"><v>a &amp; b&#10;&#x41;</v></c><c r="C1"><f>1+1</f><v>2</v></c></row><row/><row r="3"/><row r="4"><c/></row>\n <row><c><v/></c></row>',
        '<row><c t="str" r="A1"><v>x</v></c></row><row><!-- </row> --><c><v>1</v></c></row><row><c t="inlineStr"><is><t><![CDATA[<row>]]></t></is></c></row>',
        '<row spans="1:2" ht="12.5">\n<c r="B1" t="inlineStr"><is><r><t>p</t></r><r><t>q\r\n</t></r></is></c>\n</row>' * 3,
    ],
)
def test_rows_by_text_and_by_parser_agree(body, monkeypatch):
    from gridloom.sources import xlsx

    content = sheet(body)
    fast = got(content, skip_empty_lines=False)
    monkeypatch.setattr(xlsx, "plain_rows", lambda group: None)
    middle = got(content, skip_empty_lines=False)

    def unplain(*_):
        raise xlsx.Unplain
        yield

    monkeypatch.setattr(xlsx, "element_groups", unplain)
    assert fast == middle == got(content, skip_empty_lines=False) and len(fast) >= 3


ODS_CELL = '<table:table-cell office:value-type="string"><text:p>{}</text:p></table:table-cell>'


@pytest.mark.parametrize(
    "rows",
    [
        f'<table:table-column table:number-columns-repeated="3"/><table:table-row>{ODS_CELL.format("a &amp; b &#65;")}<table:covered-table-cell/><table:table-cell/>{ODS_CELL.format("x")}</table:table-row><table:table-row/>\n<table:table-row table:number-rows-repeated="2">{ODS_CELL.format("")}<table:table-cell office:value-type="float" office:value="1.5"/></table:table-row>',
        '<table:table-header-rows><table:table-row><table:table-cell office:value-type="string"><text:p>a</text:p><text:p>b<text:span>c</text:span></text:p></table:table-cell></table:table-row></table:table-header-rows><table:table-row><table:table-cell office:value-type="boolean" office:boolean-value="true"/></table:table-row>',
        f'<table:table-row>{ODS_CELL.format("1")}</table:table-row><!-- <table:table-row> --><table:table-row>{ODS_CELL.format("<![CDATA[<2>]]>")}</table:table-row>',
        f"<table:table-row>{ODS_CELL.format('1')}</table:table-row><table:table-row><table:table-cell office:value-type='string'><text:p>q\r\n</text:p></table:table-cell></table:table-row>",
    ],
)
def test_ods_rows_by_text_and_by_parser_agree(rows, monkeypatch):
    from gridloom.sources import ods as source

    content = ods(rows)
    for options in ({"skip_empty_lines": False}, {"stringify_values": False}, {"sheet": "B"}):
        fast = got(content, "ods", **options)
        monkeypatch.setattr(source, "_plain_cells", lambda body, known: None)
        middle = got(content, "ods", **options)
        monkeypatch.undo()

        def unplain(*_):
            raise source.Unplain
            yield

        monkeypatch.setattr(source, "_fast_rows", unplain)
        assert fast == middle == got(content, "ods", **options) and fast
        monkeypatch.undo()


def test_strings_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(sink, "STRINGS_LIMIT", 2)
    content = facade.write_bytes(with_row_id(spark.createDataFrame([(i, f"s{i % 4}") for i in range(9)], "k int, s string"), "k"), "xlsx", shared_strings=True)
    assert [r[1] for r in facade.read_bytes(spark, content).collect()] == [f"s{i % 4}" for i in range(9)]


def test_given_types(spark, tmp_path):
    path = facade.write(with_row_id(spark.createDataFrame([(1, 1.5, "x", True), (2, None, "y", False)], "i long, d double, s string, b boolean"), "i"), str(tmp_path / "x.xlsx"), assoc=True)
    kinds = ["long", "double", "string", "boolean"]
    df = facade.read(spark, path, assoc=True, stringify_values=False, types=kinds)
    assert df.dtypes == [("i", "bigint"), ("d", "double"), ("s", "string"), ("b", "boolean")] and [tuple(r) for r in df.collect()] == [(1, 1.5, "x", True), (2, None, "y", False)]
    for bad in (["long"], ["long", "double", "string", "date"]):
        with pytest.raises(ValueError):
            facade.read(spark, path, assoc=True, stringify_values=False, types=bad)
    with pytest.raises(InvalidDocument, match="no long"), typed_errors():
        facade.read(spark, path, assoc=True, stringify_values=False, types=["long", "double", "long", "boolean"]).collect()
