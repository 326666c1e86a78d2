"""ODS: rows of a table, streamed."""

from __future__ import annotations

import codecs
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import IO, Any
from xml.etree import ElementTree

from ..errors import InvalidDocument, SheetNotFound
from ..functions import values as V
from ..options import Options
from .package import MAX_COLUMNS, MAX_ROW_REPEAT, Unplain, check_head, entry, has_controls, has_other_entities, local, namespaces, open_package, stream, tree, unescaped, walk
from .rows import Piece, Row, Wanted, is_blank

TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
STYLE = "{urn:oasis:names:tc:opendocument:xmlns:style:1.0}"
NUMBER = "{urn:oasis:names:tc:opendocument:xmlns:datastyle:1.0}"
#: A run of more empty cells than this ends a row.
EMPTY_RUN = 100


class TimeStyles:
    """Which cell styles show time, and whether as an elapsed duration."""

    def __init__(self) -> None:
        self.data_style: dict[str, str] = {}
        self.elapsed: dict[str, bool] = {}

    def see(self, e: ElementTree.Element) -> None:
        if e.tag == STYLE + "style" and e.get(STYLE + "family") == "table-cell":
            name, data = e.get(STYLE + "name"), e.get(STYLE + "data-style-name")
            if name is not None and data is not None:
                self.data_style[name] = data
        elif e.tag == NUMBER + "time-style" and e.get(STYLE + "name") is not None:
            self.elapsed[e.get(STYLE + "name")] = e.get(NUMBER + "truncate-on-overflow") == "false"

    def is_duration(self, style: str | None) -> bool:
        return self.elapsed.get(self.data_style.get(style or "", ""), False)


def sheet_names(package: zipfile.ZipFile, limit: int | None = None) -> list[str]:
    """The names of the tables."""
    with stream(package, "content.xml", limit) as source:
        out = []
        for event, e in walk(source, ("start", "end")):
            if event == "start" and e.tag == TABLE + "table":
                out.append(e.get(TABLE + "name", ""))
            elif event == "end" and e.tag == TABLE + "table-row":
                e.clear()
        return out


def decode_cell(value: str | None, kind: str, shown: str, is_duration: bool) -> Any:
    """The value of a cell in native mode."""
    if kind in ("float", "currency", "percentage"):
        return V.parse_number(value) if value is not None and V.is_numeric(value) else value
    if kind == "date":
        return (V.parse_iso_date(value) or value) if value else None
    if kind == "time":
        if not value:
            return None
        try:
            negative, days, hours, minutes, seconds, micro = V.parse_iso_duration(value)
        except ValueError as error:
            raise InvalidDocument(str(error)) from error
        if is_duration or negative or days or hours >= 24:
            return V.format_duration(negative, 24 * days + hours, minutes, seconds, micro)
        return V.format_time(hours, minutes, seconds, micro)
    if kind == "boolean":
        return value in ("true", "1")
    return (shown or None) if kind in ("string", "") else None


#: A cell as rows are decoded from it: what its attributes say (value type, value, style, repeats), and its text.
Said = tuple[str, str | None, str | None, int]
Cell = tuple[Said, str]
_VALUES = {"float": "value", "currency": "value", "percentage": "value", "date": "date-value", "time": "time-value", "boolean": "boolean-value"}


def _value(cell: Cell, options: Options, styles: TimeStyles) -> Any:
    (kind, value, style, _), shown = cell
    if not options.stringify_values:
        return decode_cell(value, kind, shown, styles.is_duration(style))
    if kind == "boolean":
        return "1" if value in ("true", "1") else "0"
    if value is not None:
        return value
    return (shown or None) if kind in ("string", "") else None


def _cells(row: ElementTree.Element) -> Iterator[Cell]:
    """The cells of a row element."""
    for cell in row:
        if cell.tag == TABLE + "table-cell":
            kind, shown = cell.get(OFFICE + "value-type", ""), ""
            for p in cell.iter(TEXT + "p"):
                shown = "".join(p.itertext())
            yield (kind, cell.get(OFFICE + _VALUES[kind]) if kind in _VALUES else None, cell.get(TABLE + "style-name"), int(cell.get(TABLE + "number-columns-repeated", "1"))), shown


def _row(cells: Iterable[Cell], options: Options, wanted: Wanted, styles: TimeStyles) -> Row:
    out: Row = []
    asked, plain = wanted.columns, options.stringify_values
    for cell in cells:
        (kind, _, _, repeat), shown = cell
        first = len(out)
        if repeat == 1 and first < MAX_COLUMNS:
            if asked is not None and first not in asked:
                out.append(None)
            elif plain and kind == "string":
                out.append(shown or None)
            else:
                out.append(_value(cell, options, styles))
            continue
        value = None
        if asked is None or any(first <= c < first + repeat for c in asked):
            value = _value(cell, options, styles)
            if value is None and repeat > EMPTY_RUN:
                break
        if first + repeat > MAX_COLUMNS:
            raise InvalidDocument(f"A row exceeds the maximum of {MAX_COLUMNS} columns")
        out.extend([value] * repeat)
    return out


_ATTRIBUTES = r'(?: [\w:.-]+="[^"<\t\n]*")*'
_ATTRIBUTE = re.compile(r' ([\w:.-]+)="([^"]*)"')
#: A cell as most writers put it: attributes, and nothing or one paragraph of text.
_CELL = re.compile(r"(<table:(covered-)?table-cell([^<>]*)(?:(?<=/)>|(?<!/)>(?:<text:p>([^<]*)</text:p>|<text:p/>)?</table:(?:covered-)?table-cell>))")
#: What stands around cells: rows, tables, and what groups or describes rows and columns.
_AROUND = re.compile(
    rf"\s*<(?:(?P<row>table:table-row)(?P<row_has>{_ATTRIBUTES}) ?(?P<alone>/?)|(?P<table>table:table)(?P<table_has>{_ATTRIBUTES}) ?|(?P<end>/table:table)|table:table-column{_ATTRIBUTES} ?/"
    rf"|/?table:table-(?:columns|header-columns|column-group|rows|header-rows|row-group){_ATTRIBUTES} ?|table:table-column{_ATTRIBUTES} ?></table:table-column)>"
)
_ROW_END = "</table:table-row>"


def _has(attributes: str) -> dict[str, str]:
    return {k: unescaped(v) for k, v in _ATTRIBUTE.findall(attributes)}


def _said(attributes: str) -> Said | None:
    """What a cell's attributes say; None unless they are written as most writers do."""
    plain = attributes.removesuffix("/").removesuffix(" ")
    if not re.fullmatch(_ATTRIBUTES, plain):
        return None
    has = _has(plain)
    kind = has.get("office:value-type", "")
    return kind, has.get("office:" + _VALUES[kind]) if kind in _VALUES else None, has.get("table:style-name"), int(has.get("table:number-columns-repeated", "1"))


def _plain_cells(body: str, known: dict[str, Said]) -> list[Cell] | None:
    """The cells of a row by its text alone; None unless every sign of it is accounted for."""
    out: list[Cell] = []
    found = _CELL.findall(body)
    if sum([len(c[0]) for c in found]) != len(body) and _CELL.sub("", body).strip():
        return None
    for _, covered, attributes, shown in found:
        said = known.get(attributes) or _said(attributes)
        if said is None:
            return None
        if len(known) < 10_000:
            known[attributes] = said
        if not covered:
            out.append((said, unescaped(shown) if "&" in shown else shown))
    return out


def _fast_rows(source: IO[bytes], chosen: Callable[[int, str], bool], styles: TimeStyles) -> Iterator[tuple[int, Iterable[Cell]]]:
    """(repeats, cells) of the rows of the chosen table, by the text of the document.

    Rows that are written otherwise are parsed. Raises Unplain, before or
    between rows, where the text around them is not what most writers put.
    """
    decoder, known, at, rest, head = codecs.getincrementaldecoder("utf-8")(), {}, 0, "", b""
    table, inside = -1, False

    def more() -> bool:
        """Read on; what has been used goes."""
        nonlocal rest, at
        data = source.read(1 << 18)
        if has_controls(data):
            raise Unplain
        try:
            rest, at = rest[at:] + decoder.decode(data, not data), 0
        except UnicodeDecodeError as error:
            raise Unplain from error
        return bool(data)

    while (begin := re.search(r"<table:table[\s>]", rest)) is None:
        if not more() or len(rest) > 1 << 22:
            raise Unplain
    head, at = rest[: begin.start()].encode(), begin.start()
    check_head(head)
    for prefix, uri in (("table", TABLE), ("office", OFFICE), ("text", TEXT)):
        if not re.search(rf"xmlns:{prefix}=[\"']{re.escape(uri[1:-1])}[\"']".encode(), head):
            raise Unplain
    parser = ElementTree.XMLPullParser(("end",))
    try:
        parser.feed(head)
        for _, e in parser.read_events():
            styles.see(e)
    except ElementTree.ParseError as error:
        raise Unplain from error
    opening = "<group " + namespaces(head).decode() + ">"
    while True:
        m = _AROUND.match(rest, at)
        if m is None:
            if len(rest) - at < 1 << 16 and more():
                continue
            if rest[at:].lstrip().startswith("</office:spreadsheet>"):
                return
            raise Unplain
        if m["row"]:
            body, stop = "", m.end()
            if not m["alone"]:
                stop = rest.find(_ROW_END, m.end())
                if stop < 0:
                    if more():
                        continue
                    raise Unplain
                body, stop = rest[m.end() : stop], stop + len(_ROW_END)
                if "<table:table-row" in body or has_other_entities(body):
                    raise Unplain
            if inside:
                cells: Iterable[Cell] | None = _plain_cells(body, known)
                if cells is None:
                    try:
                        cells = list(_cells(ElementTree.fromstring(f"{opening}<table:table-row>{body}</table:table-row></group>")[0]))
                    except ElementTree.ParseError as error:
                        raise Unplain from error
                yield int(_has(m["row_has"]).get("table:number-rows-repeated", "1")), cells
            at = stop
            continue
        if m["table"]:
            table += 1
            inside = chosen(table, _has(m["table_has"]).get("table:name", ""))
        elif m["end"] and inside:
            return
        at = m.end()


def _parsed_rows(source: IO[bytes], chosen: Callable[[int, str], bool], styles: TimeStyles) -> Iterator[tuple[int, Iterable[Cell]]]:
    """(repeats, cells) of the rows of the chosen table, by parsing the document."""
    table, inside = -1, False
    for event, e in walk(source, ("start", "end")):
        if event == "start":
            if e.tag == TABLE + "table":
                table += 1
                inside = chosen(table, e.get(TABLE + "name", ""))
            continue
        styles.see(e)
        if e.tag == TABLE + "table" and inside:
            return
        if e.tag == TABLE + "table-row":
            if inside:
                yield int(e.get(TABLE + "number-rows-repeated", "1")), _cells(e)
            e.clear()


def rows(content: bytes | IO[bytes], options: Options, wanted: Wanted, piece: Piece | None = None) -> Iterator[Row]:
    """The rows of the chosen table, or of a piece of it, repeated rows repeated."""
    with open_package(content) as package:
        styles, found, done = TimeStyles(), False, 0
        opened = piece.open if piece is not None else lambda: stream(package, "content.xml", options.max_worksheet_size)
        if data := entry(package, "styles.xml"):
            for e in tree(data).iter():
                styles.see(e)

        def chosen(index: int, name: str) -> bool:
            nonlocal found
            yes = name == options.sheet if isinstance(options.sheet, str) else index == (options.sheet or 0)
            found = found or yes
            return yes

        def decoded(repeat: int, cells: Iterable[Cell]) -> Iterator[Row]:
            row = _row(cells, options, wanted, styles)
            if not (options.skip_empty_lines and is_blank(row)):
                if repeat > MAX_ROW_REPEAT:
                    raise InvalidDocument(f"number-rows-repeated ({repeat}) exceeds the maximum of {MAX_ROW_REPEAT}")
                for _ in range(repeat):
                    yield list(row)

        try:
            with opened() as source:
                for repeat, cells in _fast_rows(source, chosen, styles):
                    done += 1
                    yield from decoded(repeat, cells)
        except Unplain:
            with opened() as source:
                for n, (repeat, cells) in enumerate(_parsed_rows(source, chosen, styles)):
                    if n >= done:
                        yield from decoded(repeat, cells)
        if not found:
            raise SheetNotFound(f"Sheet {options.sheet!r} not found")


def document_meta(package: zipfile.ZipFile) -> dict[str, str]:
    """Local names and texts of the document's metadata."""
    data = entry(package, "meta.xml")
    found: dict[str, str] = {}
    for e in tree(data).iter() if data else ():
        name = local(e.tag)
        found[name] = f"{found[name]},{e.text or ''}" if name in found and name == "keyword" else (e.text or "")
    return found
