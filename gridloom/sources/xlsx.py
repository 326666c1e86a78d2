"""XLSX: rows of a worksheet, streamed."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import IO, Any
from xml.etree import ElementTree

from ..errors import InvalidDocument, SheetNotFound
from ..functions import values as V
from ..options import Options
from .blocks import Block, block
from .package import MAX_COLUMNS, MAX_STRINGS, Unplain, element_groups, entry, has_controls, has_other_entities, local, open_package, stream, tree, unescaped, walk
from .rows import Piece, Row, Wanted, is_blank

FIRST_SHEET = "xl/worksheets/sheet1.xml"


def sheet_names(package: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path) of the sheets in the order of the workbook."""
    book = tree(entry(package, "xl/workbook.xml", needed=True))
    rels = entry(package, "xl/_rels/workbook.xml.rels")
    targets = {r.get("Id"): r.get("Target", "") for r in tree(rels)} if rels else {}
    out = []
    for e in book.iter():
        if local(e.tag) == "sheet":
            rel = next((v for k, v in e.attrib.items() if local(k) == "id"), None)
            target = targets.get(rel, "")
            out.append((e.get("name", ""), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return out


def sheet_path(package: zipfile.ZipFile, sheet: int | str | None) -> str:
    """The entry of a sheet by index from 0 or exact name; without either, the first file of sheets."""
    if sheet is None:
        return FIRST_SHEET
    sheets = sheet_names(package)
    if isinstance(sheet, int):
        if not 0 <= sheet < len(sheets):
            raise SheetNotFound(f"Sheet {sheet} not found; the workbook has {len(sheets)}")
        return sheets[sheet][1]
    for name, path in sheets:
        if name == sheet:
            return path
    raise SheetNotFound(f"Sheet '{sheet}' not found")


def shared_strings(package: zipfile.ZipFile) -> list[str]:
    """The shared strings: plain and rich runs, phonetic hints left out."""
    data = entry(package, "xl/sharedStrings.xml", MAX_STRINGS)
    out: list[str] = []
    if data:
        for _, e in walk(data):
            if local(e.tag) == "si":
                out.append("".join("".join(t.itertext()) for run in e for t in ([run] if local(run.tag) == "t" else [x for x in run if local(x.tag) == "t"] if local(run.tag) == "r" else [])))
                e.clear()
    return out


def cell_classes(package: zipfile.ZipFile) -> list[str | None]:
    """What the number format of each cell style shows; None if it has no known code."""
    data = entry(package, "xl/styles.xml")
    if not data:
        return []
    root = tree(data)
    custom = {int(e.get("numFmtId", "-1")): e.get("formatCode", "") for e in root.iter() if local(e.tag) == "numFmt"}
    out: list[str | None] = []
    for block in root:
        if local(block.tag) == "cellXfs":
            for xf in block:
                number = int(xf.get("numFmtId") or 0)
                code = custom.get(number) or V.built_in_format(number)
                out.append(V.classify_format(code) if code else None)
    return out


def is_1904(package: zipfile.ZipFile) -> bool:
    """Whether the workbook counts days from 1904."""
    data = entry(package, "xl/workbook.xml")
    if not data:
        return False
    return any(local(e.tag) == "workbookPr" and e.get("date1904", "").lower() in ("1", "true") for e in tree(data).iter())


def decode_cell(kind: str, text: str, shows: str | None, base_1904: bool) -> Any:
    """The value of a cell in native mode."""
    if kind == "b":
        return text == "1" or text.lower() == "true"
    if kind in ("s", "str", "inlineStr", "e"):
        return text
    if kind == "d":
        return V.parse_iso_date(text) or text
    if not V.is_numeric(text):
        return text
    number = float(text)
    if shows in ("date", "datetime"):
        return V.serial_to_datetime(number, base_1904)
    if shows == "time":
        return V.fraction_to_time(number)
    if shows == "duration":
        return V.serial_to_duration(number)
    return V.parse_number(text)


def rows(content: bytes | IO[bytes], options: Options, wanted: Wanted, piece: Piece | None = None) -> Iterator[Row | Block]:
    """The rows of the chosen sheet, or of a piece of it; cells that were never asked for stay None. Blocks of rows come only where they are wanted."""
    with open_package(content) as package:
        known = piece.known if piece is not None else {}
        if "book" not in known:
            known["book"] = shared_strings(package), cell_classes(package), is_1904(package)
        strings, classes, base_1904 = known["book"]
        inherited: dict[int, str] = {}
        letters: dict[str, int] = {}
        def decoded(cells: Iterable[tuple[str, str, str, str]]) -> Row:
            return _decode(cells, options, wanted, strings, classes, base_1904, inherited, letters)

        path, done = sheet_path(package, options.sheet), 0
        opened = piece.open if piece is not None else lambda: stream(package, path, options.max_worksheet_size)
        try:
            with opened() as source:
                for group, parse in element_groups(source, "row"):
                    if wanted.blocks and (rows_ := block(group, not options.stringify_values, options.skip_empty_lines, wanted.columns, strings, classes, base_1904, inherited)):
                        done += rows_.rows
                        yield rows_
                        continue
                    found = plain_rows(group)
                    for cells in found if found is not None else (_cells(e) for e in parse() if local(e.tag) == "row"):
                        done += 1
                        row = decoded(cells)
                        if not (options.skip_empty_lines and is_blank(row)):
                            yield row
            return
        except Unplain:
            pass
        with opened() as source:
            for _, element in walk(source):
                name = local(element.tag)
                if name == "row":
                    done -= 1
                    if done < 0:
                        row = decoded(_cells(element))
                        if not (options.skip_empty_lines and is_blank(row)):
                            yield row
                    element.clear()
                elif name == "sheetData":
                    element.clear()


#: A cell as most writers put it: address, style, type, and a text in place, a value or nothing.
_CELL = re.compile(r'(<c(?: r="([A-Za-z]+)[0-9]*")?(?: s="([0-9]+)")?(?: t="([A-Za-z]+)")? ?(?:/>|>(?:<is><t(?: xml:space="preserve")?>([^<]*)</t></is>|(?:<f(?: [^<>]*)?(?:/>|>[^<]*</f>))?<v>([^<]*)</v>|<v/>)?</c>))')
_HEAD = re.compile(r"\s*(?:<row(?: [^<>]*)?/>\s*)*<row(?: [^<>]*[^<>/])? ?>\s*")
_ALONE = re.compile(r"<row(?: [^<>]*)?/>")


def plain_rows(group: bytes) -> list[list[tuple[str, str, str, str]]] | None:
    """The cells of whole rows by their text alone; None unless every sign of it is accounted for."""
    if has_controls(group):
        return None
    try:
        text = group.decode()
    except UnicodeDecodeError:
        return None
    escaped = "&" in text
    if has_other_entities(text):
        return None
    out: list[list[tuple[str, str, str, str]]] = []
    for segment in text.split("</row>")[:-1]:
        head = _HEAD.match(segment)
        if head is None:
            return None
        if segment.count("<row", 0, head.end()) > 1:
            out += [[] for _ in _ALONE.findall(head[0])]
        body = segment[head.end() :]
        cells = _CELL.findall(body)
        if sum([len(c[0]) for c in cells]) != len(body) and _CELL.sub("", body).strip():
            return None
        if escaped and "&" in body:
            out.append([(r, s, t, unescaped(i or v)) for _, r, s, t, i, v in cells])
        else:
            out.append([(r, s, t, i or v) for _, r, s, t, i, v in cells])
    return out


def _cells(element: ElementTree.Element) -> Iterator[tuple[str, str, str, str]]:
    """(column letters, style, type, text) of the cells of a row element."""
    space = element.tag[:-3]
    tag_c, tag_v, tag_is, tag_t = space + "c", space + "v", space + "is", space + "t"
    for cell in element:
        if cell.tag == tag_c:
            text = ""
            for part in cell:
                if part.tag == tag_v:
                    text = part.text or ""
                elif part.tag == tag_is:
                    text = "".join([t.text or "" for t in part.iter(tag_t)])
            yield cell.get("r", "").rstrip("0123456789"), cell.get("s", ""), cell.get("t", ""), text


def _decode(cells: Iterable[tuple[str, str, str, str]], options: Options, wanted: Wanted, strings: list[str], classes: list[str | None], base_1904: bool, inherited: dict[int, str], letters: dict[str, int]) -> Row:
    out: Row = []
    native, asked = not options.stringify_values, wanted.columns
    for column, style, kind, text in cells:
        at = len(out)
        if column:
            if column not in letters:
                if not re.fullmatch("[A-Za-z]{1,3}", column) or V.column_index(column) > MAX_COLUMNS:
                    raise InvalidDocument(f"Cell reference '{column}' exceeds the maximum of {MAX_COLUMNS} columns")
                letters[column] = V.column_index(column) - 1
            at = letters[column]
            if at > len(out):
                out.extend([None] * (at - len(out)))
        if asked is not None and at not in asked:
            out.append(None)
            continue
        if not (native or style) and kind in ("inlineStr", "str", "b", ""):
            out.append(text)  # nothing to look up
            continue
        if kind == "s":
            text = strings[int(text)] if text.isdigit() and int(text) < len(strings) else ""
        shows = classes[int(style)] if style and style.isdigit() and int(style) < len(classes) else None
        if shows is None and kind == "n" and inherited and not native and V.is_numeric(text):
            shows = inherited.get(len(out))
        if shows is not None:
            inherited.setdefault(len(out), shows)
        if native:
            out.append(decode_cell(kind, text, shows, base_1904))
        else:
            out.append(text if shows is None or shows == "number" else V.serial_to_text(text, base_1904))
    return out
