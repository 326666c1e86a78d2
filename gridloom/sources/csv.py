"""CSV: dialect and encoding detection, and records with their exact width."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from typing import IO

from ..errors import InvalidDocument, InvalidRow
from ..options import BOMS, Options, detect_bom
from .rows import Row

SAMPLE_BYTES = 4096
SEPARATORS = (",", ";", "|", "\t")

csv.field_size_limit(2**31 - 1)


def detect_separator(sample: str) -> str:
    """The most frequent separator outside quotes in the first ten fragments; a tie goes to the first, none to the comma."""
    counts = dict.fromkeys(SEPARATORS, 0)
    for fragment in re.split("\r\n|\r|\n", sample, maxsplit=9):
        bare = re.sub(r'"(?:[^"]|"")*"', "", fragment)
        for s in SEPARATORS:
            counts[s] += bare.count(s)
    return max(SEPARATORS, key=lambda s: counts[s]) if any(counts.values()) else ","


def detect_encoding(sample: bytes) -> str:
    """UTF-8 if the sample is valid up to its cut end, else Windows-1252, or Latin-1 where that has no sign."""
    try:
        sample.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as error:
        if error.reason == "unexpected end of data" and len(sample) == SAMPLE_BYTES:
            return "utf-8"
    has_controls = any(0x80 <= b < 0xA0 for b in sample)
    return "cp1252" if has_controls and not any(b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) for b in sample) else "iso-8859-1"


def decode(content: bytes, options: Options) -> str:
    """The text of a document: a byte order mark beats the given encoding.

    A frame holds Unicode, so a given input encoding is always obeyed; without
    one the text is UTF-8, and bytes that are not become replacement signs.
    """
    mark = detect_bom(content)
    if mark:
        if not mark.startswith("utf-8") and not options.transcode_bom_input:
            raise InvalidDocument(f"Cannot parse {mark.upper().replace('-LE', 'LE').replace('-BE', 'BE')} CSV without transcoding")
        return content[len(BOMS[mark]) if options.skip_input_bom or not mark.startswith("utf-8") else 0 :].decode(mark, "replace")
    encoding = options.input_encoding
    if encoding == "auto":
        encoding = detect_encoding(content[:SAMPLE_BYTES])
        if encoding == "utf-8":
            return content.decode("utf-8", "replace")
    try:
        return content.decode(encoding or "utf-8", "replace")
    except LookupError as error:
        raise ValueError(f"unknown encoding: {encoding}") from error


def separator_of(text: str, options: Options) -> str:
    """The separator to read with."""
    return detect_separator(text[:SAMPLE_BYTES]) if options.separator == "auto" else options.separator


def _streamed(source: IO[bytes], options: Options) -> tuple[str, IO[str]]:
    """(first signs, text) of a document that is read a piece at a time, as decode() has it."""
    head = source.read(4 * SAMPLE_BYTES)
    text = decode(head, options)  # raises for what may not be read
    mark, encoding = detect_bom(head), options.input_encoding
    if mark is None and encoding == "auto":
        encoding = detect_encoding(head[:SAMPLE_BYTES])
    source.seek(len(BOMS[mark]) if mark and (options.skip_input_bom or not mark.startswith("utf-8")) else 0)
    return text, io.TextIOWrapper(source, mark or encoding or "utf-8", "replace", newline="")


def records(content: bytes | IO[bytes], options: Options) -> Iterator[Row]:
    """The records of a document as lists of text. A blank line is skipped, or is ``[None]`` if blank lines are kept."""
    if isinstance(content, bytes):
        text = decode(content, options)
        read = io.StringIO(text, newline="")
    else:
        text, read = _streamed(content, options)
    dialect = {"delimiter": separator_of(text, options), "quotechar": options.enclosure, "doublequote": True}
    if options.escape and options.escape != options.enclosure:
        dialect["escapechar"] = options.escape
    taken: list[str] = []

    def lines() -> Iterator[str]:
        for line in read:
            taken.append(line)
            yield line

    for record in csv.reader(lines(), **dialect):
        raw = "".join(taken)
        taken.clear()
        if options.strict and options.enclosure in raw and not options.escape and raw.count(options.enclosure) % 2:
            raise InvalidRow("Potential malformed data or unclosed quote")
        if record:
            yield record
        elif not options.skip_empty_lines:
            yield [None]
