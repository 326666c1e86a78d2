"""ZIP packages of workbooks: guarded entries and XML without entities."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from typing import IO
from xml.etree import ElementTree

from ..errors import InvalidDocument
from ..options import WORKSHEET_SIZE

#: Limits on what is unpacked and on the shape of a sheet.
MAX_ENTRY, MAX_STRINGS = 50_000_000, 1_000_000_000
MAX_COLUMNS, MAX_ROW_REPEAT = 16_384, 16_384
#: Bytes of a sheet for each byte of it in the package, up to which the default limit of its size does not count.
MAX_RATIO = 100


def open_package(content: bytes | IO[bytes]) -> zipfile.ZipFile:
    """The package in a document's bytes or file."""
    try:
        return zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
    except zipfile.BadZipFile as error:
        raise InvalidDocument("The document is no readable ZIP package") from error


def entry(package: zipfile.ZipFile, name: str, limit: int | None = MAX_ENTRY, needed: bool = False) -> bytes | None:
    """The bytes of an entry, None if it is missing and not needed."""
    try:
        info = package.getinfo(name)
    except KeyError:
        if needed:
            raise InvalidDocument(f"The document has no {name}") from None
        return None
    check_size(info, limit)
    return package.read(info)


def check_size(info: zipfile.ZipInfo, limit: int | None) -> None:
    """Raise if an entry unpacks to more than a limit; the default one is for what a small document unpacks to."""
    if limit == WORKSHEET_SIZE and info.file_size <= MAX_RATIO * info.compress_size:
        return  # sheets are read a piece at a time, and the work is in proportion to the document
    if limit is not None and info.file_size > limit:
        raise InvalidDocument(f"{info.filename} has {info.file_size} bytes, more than the limit of {limit}")


def stream(package: zipfile.ZipFile, name: str, limit: int | None) -> IO[bytes]:
    """An entry as a stream."""
    try:
        info = package.getinfo(name)
    except KeyError:
        raise InvalidDocument(f"The document has no {name}") from None
    check_size(info, limit)
    return package.open(info)


class _Guarded:
    """A stream that refuses document type declarations, which could define entities."""

    def __init__(self, source: IO[bytes]):
        self.source, self.tail, self.rooted = source, b"", False

    def read(self, n: int = -1) -> bytes:
        data = self.source.read(n)
        if not self.rooted:
            head = self.tail + data
            if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
                raise InvalidDocument("Document type declarations are not allowed")
            self.tail = head[-16:]
            self.rooted = len(head) > 65_536
        return data


def walk(source: IO[bytes] | bytes, events: tuple[str, ...] = ("end",)) -> Iterator[tuple[str, ElementTree.Element]]:
    """Parse events of an XML document."""
    stream_ = io.BytesIO(source) if isinstance(source, bytes) else source
    try:
        yield from ElementTree.iterparse(_Guarded(stream_), events)
    except ElementTree.ParseError as error:
        raise InvalidDocument(f"The document has invalid XML: {error}") from error


class Unplain(Exception):
    """Raised by element_groups() where text alone does not tell where elements end."""


def element_groups(source: IO[bytes], name: str, size: int = 1 << 18) -> Iterator[tuple[bytes, Callable[[], list[ElementTree.Element]]]]:
    """Groups of the elements of a name that follow one another below one parent: their text, and a parser of it.

    A group of whole elements is cut out of the document's text. What is around
    the groups is parsed at the end. Raises Unplain, before or between groups
    or from a parser, if names have prefixes, the encoding is not UTF-8 or a
    cut does not parse, as within a comment.
    """

    def parse(group: bytes) -> list[ElementTree.Element]:
        try:
            return list(ElementTree.fromstring(opening + group + b"</group>"))
        except ElementTree.ParseError as error:
            raise Unplain from error

    end = f"</{name}>".encode()
    head, rest = b"", b""
    while True:
        data = source.read(size)
        rest += data
        if not head:
            at = re.search(rb"<" + name.encode() + rb"[\s/>]", rest)
            if at is None:
                if data and len(rest) < 8 * size:
                    continue
                raise Unplain
            head, rest = rest[: at.start()], rest[at.start() :]
            check_head(head)
            opening = b"<group " + namespaces(head) + b">"
        cut = rest.rfind(end) + len(end)
        if cut >= len(end):
            group, rest = rest[:cut], rest[cut:]
            yield group, partial(parse, group)
        if not data:
            break
    try:
        ElementTree.fromstring(head + rest)
    except ElementTree.ParseError as error:
        raise InvalidDocument(f"The document has invalid XML: {error}") from error


_ENTITY = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#([0-9]+)|#x([0-9A-Fa-f]+));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_FORBIDDEN = bytes([*range(9), 11, 12, 13, *range(14, 32)])


def unescaped(text: str) -> str:
    """Text with its entities and character numbers replaced."""
    return _ENTITY.sub(lambda m: _NAMED[m[1]] if m[1] else chr(int(m[2])) if m[2] else chr(int(m[3], 16)), text)


def has_other_entities(text: str) -> bool:
    """Whether an ampersand is no sign of an entity that every document has."""
    return "&" in text and "&" in _ENTITY.sub("", text)


def has_controls(data: bytes) -> bool:
    """Whether there are signs that a parser refuses, or changes, as carriage returns."""
    return len(data.translate(None, _FORBIDDEN)) != len(data)


def namespaces(head: bytes) -> bytes:
    """The namespace declarations in a document's head."""
    return b" ".join(m[0] for m in re.finditer(rb"xmlns(?::[\w.-]+)?\s*=\s*(?:\"[^\"]*\"|'[^']*')", head))


def check_head(head: bytes) -> None:
    """Raise Unplain for a head whose document has to be parsed as a whole."""
    if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
        raise InvalidDocument("Document type declarations are not allowed")
    declared = re.search(rb"encoding\s*=\s*[\"']([^\"']+)", head[:200])
    if declared and declared[1].lower() not in (b"utf-8", b"us-ascii") or head.startswith((b"\xff\xfe", b"\xfe\xff")) or b"<!" in head:
        raise Unplain


def tree(data: bytes) -> ElementTree.Element:
    """The root of a small XML document."""
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise InvalidDocument("Document type declarations are not allowed")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as error:
        raise InvalidDocument(f"The document has invalid XML: {error}") from error


def local(name: str) -> str:
    """A tag or attribute name without its namespace."""
    return name.rpartition("}")[2]


def texts(element: ElementTree.Element, name: str) -> list[str]:
    """Whole texts of all elements of a local name, in order."""
    return ["".join(e.itertext()) for e in element.iter() if local(e.tag) == name]
