"""Paths and formats: guards, extensions and content sniffing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedFormat

FORMATS = ("csv", "xlsx", "ods")
SNIFF_BYTES = 8192
#: Schemes of stores that Spark reads; a path without scheme is one too.
SCHEMES = frozenset("file hdfs viewfs s3 s3a s3n gs abfs abfss wasb wasbs adl dbfs oss cosn o3fs ofs webhdfs swebhdfs".split())
MIME_TYPES = {
    "csv": "text/csv",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
}


def check_path(path: str) -> str:
    """The path, if its scheme is one of a store."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if "\0" in path or (found and len(found[1]) > 1 and found[1].lower() not in SCHEMES):
        raise ValueError(f"path not allowed: {path!r}")
    return path


def extension(path: str) -> str:
    """The lower-cased extension of a path."""
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def known_format(name: str) -> str:
    """The format of an extension, in any case."""
    if name.lower() not in FORMATS:
        raise UnsupportedFormat(f"Unsupported format: {name}")
    return name.lower()


def sniff(head: bytes) -> str:
    """The format of a document by its first bytes."""
    if head.startswith(b"PK\x03\x04") and MIME_TYPES["ods"].encode() in head:
        return "ods"
    return "xlsx" if head.startswith(b"PK") else "csv"


def ensure_extension(name: str, kind: str) -> str:
    """The name with the format's extension."""
    return name if name.lower().endswith(f".{kind}") else f"{name}.{kind}"


def binary_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, content) of whole files; read by Spark, so any store that it knows will do."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load([check_path(p) for p in paths]).select(F.col("_metadata.file_path").alias("path"), "length", "content")


def file_size(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(full name, bytes) of a path that is one file; None for folders and patterns."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isFile():
        return None
    return fs.makeQualified(where).toUri().toString(), fs.getFileStatus(where).getLen()


def format_of(spark: SparkSession, paths: str | list[str]) -> str:
    """The format of a path by extension, else by the content of its first file."""
    first = paths if isinstance(paths, str) else paths[0]
    name = extension(first)
    if name:
        if name in FORMATS or name in ("txt", "tsv"):
            return name if name in FORMATS else "csv"
        if name in ("xls", "xlsm", "xlsb", "doc", "pdf", "json", "parquet"):
            raise UnsupportedFormat(f"Unsupported format: {name}")
    head = binary_files(spark, paths).select(F.substring("content", 1, SNIFF_BYTES).alias("head")).first()
    return sniff(bytes(head["head"])) if head else "csv"
