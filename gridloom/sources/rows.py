"""From decoded rows to data rows: header search, width checks, selection, offset and limit."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import IO, Any

from ..errors import InvalidDocument, InvalidRow
from ..options import Options
from ..plans.headers import HeaderPaths, find_header

Row = list[Any]


@dataclass
class Wanted:
    """Physical columns that a decoder has to decode; None for all."""

    columns: frozenset[int] | None = None
    #: Whether whole blocks of rows may come from now on, if whoever reads takes them.
    blocks: bool = False
    takes_blocks: bool = False


@dataclass
class Piece:
    """Rows of a sheet with what stands before and after all rows of it, as a document of its own."""

    text: bytes
    #: What is the same for all pieces of a document.
    known: dict[str, Any]

    def open(self) -> IO[bytes]:
        return io.BytesIO(self.text)


@dataclass
class Assembled:
    """Data rows and the header they go by, None in plain mode without one."""

    header: HeaderPaths | None
    rows: Iterator[Row]
    wanted: Wanted = field(default_factory=Wanted)


def is_blank(row: Row) -> bool:
    """Whether a row has nothing but nulls and empty texts."""
    return all(c is None or c == "" for c in row)


def _settled(full: HeaderPaths, options: Options) -> HeaderPaths:
    """Required columns checked, then columns selected, then aliases given."""
    if options.required_columns:
        full.require(options.required_columns)
    chosen = full.select(options.columns) if options.columns else full
    return chosen.rename(options.aliases) if options.aliases else chosen


def assemble(rows: Iterator[Row], options: Options, wanted: Wanted | None = None) -> Assembled:
    """Find the header in ``rows`` and return what follows as data rows.

    Rows come in already without blank ones, if those are to be skipped.
    """
    wanted = wanted or Wanted()
    full: HeaderPaths | None = None
    if options.headers:
        full = HeaderPaths.injected(options.headers, options.header_rows, options.header_normalizer)
    auto = options.header_offset == "auto"
    if auto and not options.required_columns:
        raise ValueError("header_offset='auto' needs required_columns")
    header = _settled(full, options) if full is not None else None
    if isinstance(options.header_offset, int):
        for _ in range(options.header_offset):
            next(rows, None)
    if auto and full is None:
        window: list[Row] = []
        for row in rows:
            window = [*window, row][-options.header_rows :]
            if full := find_header(options.required_columns, options.header_rows, window, options.header_normalizer):
                break
        if full is None:
            raise InvalidDocument("Could not auto-detect header position. Ensure required columns exist.")
        header = _settled(full, options)
    elif options.assoc and full is None:
        block = [row for _, row in zip(range(options.header_rows), rows)]
        if block and len(block) < options.header_rows:
            raise InvalidDocument(f"The header has {len(block)} rows, expected {options.header_rows}")
        if block:
            full = HeaderPaths.from_rows(block, options.header_normalizer)
            header = _settled(full, options)
        elif options.required_columns or options.columns:
            HeaderPaths.flat([]).require(options.required_columns or options.columns)
    if header is not None and (options.columns or options.assoc) and not options.strict:
        wanted.columns = frozenset(header.indices)

    def data() -> Iterator[Row]:
        if wanted.takes_blocks and not options.strict and not options.offset and options.limit is None:
            wanted.blocks = True
            yield from rows
            return
        width = len(full) if full is not None else None
        seen = 0
        if options.limit == 0:
            return
        for n, row in enumerate(rows):
            if options.strict:
                if width is None:
                    width = len(row)
                if len(row) != width:
                    raise InvalidRow(f"Row {n + 1} has {len(row)} columns, expected {width}", n + 1)
            if n < options.offset:
                continue
            yield row
            seen += 1
            if options.limit is not None and seen >= options.limit:
                return

    return Assembled(header, data(), wanted)
