"""Rows of a worksheet by columns, where all rows of a text are written alike."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any

import pyarrow as pa

from ..functions import values as V
from .package import has_controls, has_other_entities, unescaped

_INLINE, _VALUE = '<is><t xml:space="preserve">', "<v>"
_CELL = rf'(?:<c/>|(<c(?: s="[0-9]+")?(?: t="[A-Za-z]+")?>)(?:<v>([^<]*)</v>|{_INLINE}([^<]*)</t></is>)</c>)'
_PREFIX = r'<c(?: s="([0-9]+)")?(?: t="([A-Za-z]+)")?>'
_LONGS = r"(?:(?:-?(?:0|[1-9][0-9]{0,17}))?\n)*"
_DOUBLES = r"(?:(?:-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)?\n)*"
#: Cells of a row beyond which rows are decoded one by one.
MAX_CELLS = 200


@lru_cache(64)
def _row(cells: int) -> re.Pattern[str]:
    return re.compile("<row>" + _CELL * cells + "</row>")


class BlockColumn:
    """The cells of a column: what they are (text, bool, date, number), and their texts."""

    def __init__(self, what: str, texts: list[str], base_1904: bool):
        self.what, self.texts, self.base_1904 = what, texts, base_1904
        self.kind = {"text": "string", "bool": "boolean", "date": "timestamp_ntz"}.get(what)
        if what == "number":
            joined = "\n".join(texts) + "\n"
            if re.fullmatch(_LONGS, joined):
                self.kind = "long"
            elif re.fullmatch(_DOUBLES, joined) and not re.search(r"(?m)^-?[0-9]{18,}$", joined):
                self.kind = "double"

    def _date(self, text: str) -> Any:
        return V.serial_to_datetime(float(text), self.base_1904) if V.is_numeric(text) else text

    def values(self) -> list[Any]:
        """The values of the cells as they are decoded one by one."""
        if self.what == "text":
            return self.texts
        if self.what == "bool":
            return [t == "1" or t.lower() == "true" for t in self.texts]
        one = self._date if self.what == "date" else lambda t: V.parse_number(t) if V.is_numeric(t) else t
        known = {t: one(t) for t in set(self.texts)}
        return [known[t] for t in self.texts]

    def kinds(self) -> set[str]:
        """Kinds of the cells that are not empty; integers among decimals are decimals."""
        if not any(self.texts):
            return set()
        if self.what == "date" and not all(V.is_numeric(t) for t in set(self.texts) if t):
            return {"timestamp_ntz", "string"}
        return {self.kind}

    def array(self, kind: str) -> pa.Array | None:
        """The cells as an array of a kind; None where values() have to be converted."""
        if self.what == "text" and kind == "string":
            return pa.array(self.texts, pa.string())
        if self.what == "number" and kind in ("long", "double") and (kind == "double" or self.kind == "long"):
            found = pa.array([t or None for t in self.texts] if "" in self.texts else self.texts, pa.string())
            return found.cast(pa.int64() if kind == "long" else pa.float64())
        return None


class Block:
    """Rows of equal width by their columns."""

    def __init__(self, rows: int, columns: list[BlockColumn | None]):
        self.rows, self.columns = rows, columns


def block(group: bytes, native: bool, skip_empty: bool, asked: frozenset[int] | None, strings: list[str], classes: list[str | None], base_1904: bool, inherited: dict[int, str]) -> Block | None:
    """Whole rows by columns; None unless each column has cells of one type and style, or empty ones, and every sign is accounted for."""
    if not group.startswith(b"<row>") or has_controls(group):
        return None
    cells = group.count(b"<c", 0, group.find(b"</row>"))
    if not 0 < cells <= MAX_CELLS:
        return None
    try:
        text = group.decode()
    except UnicodeDecodeError:
        return None
    if has_other_entities(text):
        return None
    found = _row(cells).findall(text)
    if not found or len(found) != text.count("</row>"):
        return None
    rows, length, columns, full, seen = len(found), 11 * len(found), [], False, {}
    by = list(zip(*found))
    for at in range(cells):
        prefixes, texts, inline = by[3 * at], by[3 * at + 1], by[3 * at + 2]
        distinct = set(prefixes) - {""}
        if len(distinct) > 1:
            return None
        style, kind = re.fullmatch(_PREFIX, next(iter(distinct))).groups("") if distinct else ("", "")
        empty = prefixes.count("")
        if kind == "inlineStr":
            texts, other = inline, texts
        else:
            other = inline
        if any(other):
            return None
        around = len(_INLINE) + 13 if kind == "inlineStr" else 11
        length += 4 * empty + sum(map(len, prefixes)) + sum(map(len, texts)) + around * (rows - empty)
        if asked is not None and at not in asked:
            columns.append(None)
            continue
        texts = list(texts)
        if "&" in text:
            texts = [unescaped(t) if "&" in t else t for t in texts]
        if kind == "s":
            known = {t: strings[int(t)] if t.isdigit() and int(t) < len(strings) else "" for t in set(texts)}
            texts = [known[t] for t in texts]
        shows = classes[int(style)] if style and int(style) < len(classes) else None
        if kind == "n" and shows is None and not native and inherited.get(at, "number") != "number":
            return None
        if shows is not None:
            seen[at] = shows
        if not native:
            if shows not in (None, "number"):
                known = {t: V.serial_to_text(t, base_1904) for t in set(texts)}
                texts = [known[t] for t in texts]
            column = BlockColumn("text", texts, base_1904)
        elif kind in ("s", "str", "inlineStr", "e"):
            column = BlockColumn("text", texts, base_1904)
        elif kind == "b":
            if empty:
                return None
            column = BlockColumn("bool", texts, base_1904)
        elif kind == "d" or shows in ("time", "duration"):
            return None
        else:
            column = BlockColumn("date" if shows in ("date", "datetime") else "number", texts, base_1904)
        if column.kind is None:
            return None
        full = full or "" not in texts
        columns.append(column)
    if length != len(text) or skip_empty and not full:
        return None
    for at, shows in seen.items():
        inherited.setdefault(at, shows)
    return Block(rows, columns)
