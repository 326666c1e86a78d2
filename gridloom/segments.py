"""Segments of a deflated entry that can be read alone, and the list of them among the entry's extra fields."""

from __future__ import annotations

import struct
import zipfile
from dataclasses import dataclass

#: The tag of the list of segments among an entry's extra fields.
SEGMENTS_TAG = 0x4C47
#: Segments that an extra field has room for.
MAX_SEGMENTS = 4000
_SEGMENT = "<IIII"


@dataclass(frozen=True)
class Segment:
    """Whole rows that stand together in a document: bytes as stored, bytes of the text, its checksum, rows."""

    packed: int
    raw: int
    crc: int
    rows: int


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return total


def crc_joined(first: int, second: int, length: int) -> int:
    """The checksum of a text followed by one of a length, from the checksums of both."""
    operator = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    square = lambda m: [_times(m, v) for v in m]
    operator = square(square(square(operator)))  # one zero byte
    while length:
        if length & 1:
            first = _times(operator, first)
        operator, length = square(operator), length >> 1
    return first ^ second


def _merged(a: Segment, b: Segment) -> Segment:
    return Segment(a.packed + b.packed, a.raw + b.raw, crc_joined(a.crc, b.crc, b.raw), a.rows + b.rows)


def extra_field(segments: list[Segment]) -> bytes:
    """The list of segments as an extra field; without one a document is read as a whole."""
    head, *rows, tail = segments
    while len(rows) > MAX_SEGMENTS - 2:
        rows = [_merged(*rows[i : i + 2]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
    listed = [head, *rows, tail]
    if any(max(s.packed, s.raw, s.rows) >= 1 << 32 for s in listed):
        return b""
    body = b"".join(struct.pack(_SEGMENT, s.packed, s.raw, s.crc, s.rows) for s in listed)
    return struct.pack("<HH", SEGMENTS_TAG, len(body)) + body


def segments_of(info: zipfile.ZipInfo) -> list[Segment] | None:
    """The segments of an entry, if it has a list of them that agrees with its sizes and checksum."""
    extra, found = info.extra, None
    while len(extra) >= 4:
        tag, length = struct.unpack("<HH", extra[:4])
        if tag == SEGMENTS_TAG and length % struct.calcsize(_SEGMENT) == 0 and len(extra) >= 4 + length:
            found = [Segment(*fields) for fields in struct.iter_unpack(_SEGMENT, extra[4 : 4 + length])]
        extra = extra[4 + length :]
    if not found or len(found) < 2 or info.compress_type != zipfile.ZIP_DEFLATED or sum(s.raw for s in found) != info.file_size or sum(s.packed for s in found) != info.compress_size:
        return None
    crc = 0
    for s in found:
        crc = crc_joined(crc, s.crc, s.raw)
    return found if crc == info.CRC else None
