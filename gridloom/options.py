"""Options of readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

#: Byte order marks by the name of their encoding, longest first.
BOMS = {"utf-32-le": b"\xff\xfe\x00\x00", "utf-32-be": b"\x00\x00\xfe\xff", "utf-8": b"\xef\xbb\xbf", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}


#: The default limit of what a sheet unpacks to. It is for sheets that are packed beyond ``MAX_RATIO``; another limit is for all.
WORKSHEET_SIZE = 500_000_000


@dataclass(frozen=True)
class Meta:
    """Document properties that writers put into a workbook."""

    title: str | None = None
    subject: str | None = None
    creator: str | None = "gridloom"
    keywords: str | None = None
    description: str | None = None
    category: str | None = None
    language: str | None = "en-US"

    @classmethod
    def of(cls, values: Mapping[str, Any]) -> Meta:
        """From a mapping; unknown names and values that are no scalars are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: str(v) for k, v in values.items() if k in known and isinstance(v, (str, int, float, bool))})


@dataclass(frozen=True)
class Options:
    """How to read or write a tabular file. A field that a format has no use for is ignored."""

    # rows
    assoc: bool = False
    strict: bool = False
    skip_empty_lines: bool = True
    offset: int = 0
    limit: int | None = None
    # headers
    headers: Sequence[Any] | Mapping[str, Any] = ()
    header_rows: int = 1
    header_offset: int | str | None = None
    header_normalizer: Callable[[str], str] | None = None
    required_columns: Sequence[Any] | Mapping[str, Any] = ()
    columns: Sequence[Any] | Mapping[str, Any] = ()
    aliases: Mapping[str, Any] = field(default_factory=dict)
    # values
    stringify_values: bool = True
    infer_numeric_strings: bool = True
    # CSV
    separator: str = "auto"
    enclosure: str = '"'
    escape: str = ""
    eol: str = "\r\n"
    input_encoding: str | None = None
    output_encoding: str | None = None
    skip_input_bom: bool = True
    transcode_bom_input: bool = True
    bom: bool | str | bytes = True
    escape_formulas: bool | Callable = False
    # workbooks
    meta: Meta | Mapping[str, Any] | None = None
    autofilter: str | None = None
    freeze_pane: str | None = None
    sheet_protection: bool | str = False
    sheet: int | str | None = None
    bold_headers: bool = False
    shared_strings: bool = False
    auto_width: bool = False
    max_worksheet_size: int | None = WORKSHEET_SIZE
    # output
    stream: bool = True
    temp_path: str | None = None

    def __post_init__(self) -> None:
        def need(right: bool, what: str) -> None:
            if not right:
                raise ValueError(what)

        need(self.offset >= 0, "offset must not be negative")
        need(self.limit is None or self.limit >= 0, "limit must be None or not negative")
        need(self.header_rows >= 1, "header_rows must be positive")
        need(self.max_worksheet_size is None or self.max_worksheet_size > 0, "max_worksheet_size must be None or positive")
        need(self.separator == "auto" or len(self.separator.encode()) == 1, "separator must be one byte or 'auto'")
        need(len(self.enclosure.encode()) == 1, "enclosure must be one byte")
        need(len(self.escape.encode()) <= 1, "escape must be one byte or empty")
        need(self.header_offset is None or self.header_offset == "auto" or isinstance(self.header_offset, int) and self.header_offset >= 0, "header_offset must be None, 'auto' or not negative")

    def but(self, **changes: Any) -> Options:
        """A copy with changes."""
        return replace(self, **changes)

    @property
    def properties(self) -> Meta:
        """The document properties to write."""
        return self.meta if isinstance(self.meta, Meta) else Meta.of(self.meta or {})

    def bom_bytes(self) -> bytes:
        """The byte order mark to write."""
        if self.bom is True:
            return BOMS["utf-8"]
        if self.bom is False:
            return b""
        if isinstance(self.bom, bytes):
            return self.bom
        name = self.bom.lower().replace("_", "-").replace("utf16", "utf-16").replace("utf32", "utf-32").replace("utf8", "utf-8")
        name = {"utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "utf-32le": "utf-32-le", "utf-32be": "utf-32-be"}.get(name, name)
        if name not in BOMS:
            raise ValueError(f"unknown byte order mark: {self.bom}")
        return BOMS[name]


def make_options(options: Options | None = None, **changes: Any) -> Options:
    """The given options, or the defaults, with changes."""
    return replace(options or Options(), **changes)


def detect_bom(head: bytes) -> str | None:
    """The encoding that a byte order mark at the start of ``head`` names."""
    return next((name for name, mark in BOMS.items() if head.startswith(mark)), None)
