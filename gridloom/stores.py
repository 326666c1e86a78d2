"""Files as executors open them without a JVM: by ranges, and as streams of any length."""

from __future__ import annotations

import io
from typing import IO, Any


def store_of(path: str) -> tuple[Any, str]:
    """(pyarrow file system, path in it) of a path; raises where pyarrow knows no such store."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if path.startswith(("s3a://", "s3n://")):
        path = "s3://" + path[6:]
    return fs.FileSystem.from_uri(path.rstrip("/"))


def open_file(path: str) -> IO[bytes]:
    """A file for reading at any place in it."""
    store, at = store_of(path)
    return io.BufferedReader(_Raw(store.open_input_file(at)), 1 << 20)


def can_open(path: str, size: int) -> bool:
    """Whether pyarrow sees the file that Spark sees."""
    try:
        store, at = store_of(path)
        return store.get_file_info(at).size == size
    except Exception:  # noqa: BLE001 (a store may fail in its own ways; Spark's readers remain)
        return False


class _Raw(io.RawIOBase):
    """A pyarrow file as a raw stream."""

    def __init__(self, source: Any):
        self.source = source

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        self.source.seek(at, whence)
        return self.source.tell()

    def tell(self) -> int:
        return self.source.tell()

    def readinto(self, buffer: Any) -> int:
        return self.source.readinto(buffer)

    def close(self) -> None:
        if not self.closed:
            self.source.close()
        super().close()
