"""CSV sink."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from typing import IO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..options import BOMS, Options
from .pieces import leaves, pieces
from .staged import stage


def _separator(options: Options) -> str:
    return "," if options.separator == "auto" else options.separator


def check_encoding(options: Options) -> None:
    """A byte order mark must name the encoding that is written."""
    mark = options.bom_bytes()
    encoding = codecs.lookup(options.output_encoding or "utf-8").name
    of_mark = next((codecs.lookup(name).name for name, b in BOMS.items() if b == mark), None)
    if mark and of_mark and of_mark != encoding and options.output_encoding is not None:
        if options.bom is True:
            raise ValueError(f"a UTF-8 byte order mark cannot stand before {options.output_encoding} text; set bom=False")
        raise ValueError(f"the byte order mark is for {of_mark}, the text for {options.output_encoding}")
    if mark and of_mark and of_mark != "utf-8" and options.output_encoding is None:
        raise ValueError(f"a byte order mark for {of_mark} needs output_encoding={of_mark!r}")


def _quote(text: Column, options: Options) -> Column:
    q, sep = options.enclosure, _separator(options)
    special = F.contains(text, F.lit(q)) | F.contains(text, F.lit(sep)) | text.rlike(r"[\r\n]")
    if options.escape and options.escape != q:
        special = special | F.contains(text, F.lit(options.escape))
        text_in = F.replace(F.replace(text, F.lit(options.escape), F.lit(options.escape * 2)), F.lit(q), F.lit(options.escape + q))
    else:
        text_in = F.replace(text, F.lit(q), F.lit(q + q))
    return F.when(special, F.concat(F.lit(q), text_in, F.lit(q))).otherwise(text)


def _guarded(c: Column, kind: T.DataType, index: int, options: Options) -> Column:
    text = C.stringify(c, kind)
    if not isinstance(kind, T.StringType) or not options.escape_formulas:
        return text
    if callable(options.escape_formulas):
        return F.coalesce(options.escape_formulas(text, index), F.lit(""))
    return C.escape_formula(text)


def line_column(cells: DataFrame, options: Options) -> Column:
    """The text of a row, without its end."""
    fields = [f for f in cells.schema.fields if f.name != "_row_id"]
    return F.concat_ws(_separator(options), *[_quote(_guarded(F.col(f.name), f.dataType, i, options), options) for i, f in enumerate(fields)])


def header_lines(cells: DataFrame, header, options: Options) -> list[str]:
    """The header rows as text; CSV has none unless headers are given."""
    if not options.headers:
        return []
    q, sep = options.enclosure, _separator(options)
    out = []
    for row in header.header_rows():
        names = []
        for name in row:
            if options.escape_formulas is True and name[:1] in ("=", "+", "-", "@", "\t", "\r"):
                name = "'" + name
            names.append(q + name.replace(q, q + q) + q if any(s in name for s in (q, sep, "\r", "\n")) else name)
        out.append(sep.join(names))
    return out


def write(df: DataFrame, out: IO[bytes], options: Options) -> None:
    """Write a frame as a CSV document to a stream; executors encode and store the rows."""
    check_encoding(options)
    cells, header = leaves(df, options)
    encoding = options.output_encoding or "utf-8"
    plain = codecs.lookup(encoding).name == "utf-8"
    line = F.concat(line_column(cells, options), F.lit(options.eol))
    staged = stage(cells, line, encoding=None if plain else encoding)
    if staged is None:
        for chunk in chunks(df, options):
            out.write(chunk)
        return
    out.write(options.bom_bytes() + "".join(x + options.eol for x in header_lines(cells, header, options)).encode(encoding))
    staged.append(out)


def chunks(df: DataFrame, options: Options) -> Iterator[bytes]:
    """The bytes of a CSV document, piece by piece."""
    check_encoding(options)
    cells, header = leaves(df, options)
    encoding = options.output_encoding or "utf-8"
    if mark := options.bom_bytes():
        yield mark
    for line in header_lines(cells, header, options):
        yield (line + options.eol).encode(encoding)
    part: list[str] = []
    for line in pieces(cells, line_column(cells, options)):
        part.append(line)
        if len(part) == 1000:
            yield "".join(x + options.eol for x in part).encode(encoding)
            part = []
    yield "".join(x + options.eol for x in part).encode(encoding)


def write_parts(df: DataFrame, folder: str, options: Options, rows: int | None = None) -> None:
    """Write a folder of CSV parts without a header, of up to ``rows`` rows each, all of it on executors; cells keep their line breaks as they are."""
    if options.output_encoding or options.bom not in (False, True):
        raise ValueError("parts are UTF-8 without a byte order mark")
    cells, _ = leaves(df, options)
    cells.select(line_column(cells, options).alias("value")).write.option("lineSep", options.eol).option("maxRecordsPerFile", rows or 0).text(folder)
