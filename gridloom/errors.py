"""Errors of the engine.

Wrong use of the API raises ``ValueError``. What is wrong with a document or a
row raises one of the classes below, at plan time where the driver can see it.
An error that only an executor can see reaches the driver inside Spark's own
exception; ``typed_errors`` turns it back into its class.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager


class EngineError(Exception):
    """Root of the engine's own errors."""


class InvalidDocument(EngineError):
    """A document that cannot be read as asked."""


class SheetNotFound(InvalidDocument):
    """A sheet index or name that a workbook does not have."""


class InvalidRow(EngineError):
    """A row that breaks a rule; ``row`` and ``column`` say where, if known."""

    def __init__(self, message: str, row: int | None = None, column: str | None = None):
        super().__init__(message)
        self.row, self.column = row, column


class MissingColumn(EngineError):
    """Required columns that a header lacks, as dotted paths."""

    def __init__(self, columns: list[str]):
        super().__init__("Missing required columns: " + ", ".join(columns))
        self.columns = list(columns)


class UnsupportedFormat(EngineError):
    """A file format that the engine does not know."""


class WriteError(EngineError):
    """A value or target that cannot be written."""


_KINDS = {c.__name__: c for c in (EngineError, InvalidDocument, SheetNotFound, InvalidRow, MissingColumn, UnsupportedFormat, WriteError)}
_MARK = re.compile(r"gridloom-error:(\{.*?\})(?:$|[\s'\"])", re.M)


def encode_error(error: EngineError) -> str:
    """The error as one line of JSON that decode_error() reads."""
    detail = {"kind": type(error).__name__, "message": str(error), "row": getattr(error, "row", None), "column": getattr(error, "column", None), "columns": getattr(error, "columns", None)}
    return "gridloom-error:" + json.dumps(detail)


def decode_error(text: str) -> EngineError | None:
    """The error that a text carries, if any."""
    at = text.find("gridloom-error:{")
    if at < 0:
        return None
    detail, _ = json.JSONDecoder().raw_decode(text[at + len("gridloom-error:") :])
    if detail["kind"] == "MissingColumn":
        return MissingColumn(detail["columns"])
    if detail["kind"] == "InvalidRow":
        return InvalidRow(detail["message"], detail["row"], detail["column"])
    return _KINDS[detail["kind"]](detail["message"])


@contextmanager
def typed_errors() -> Iterator[None]:
    """Raise the engine's own error where an action fails because of one."""
    try:
        yield
    except EngineError:
        raise
    except Exception as error:
        if found := decode_error(str(error)) or _raised_row(str(error)):
            raise found from error
        raise


def _raised_row(text: str) -> InvalidRow | None:
    found = re.search(r"Row (\d+): Column '([^']*)' [^\n]*", text)
    return InvalidRow(found[0].strip(), int(found[1]), found[2]) if found else None
