"""What a document says about itself: sheets and properties."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, UnsupportedFormat, decode_error, encode_error
from . import ods, xlsx
from .files import binary_files, sniff
from .package import entry, local, open_package, tree

_PROPERTIES = ("title", "subject", "creator", "keywords", "description", "category", "language")
_NAMES = {"initial-creator": "creator", "keyword": "keywords"}


def sheets_of(content: bytes) -> list[str]:
    """The sheet names of a workbook's bytes."""
    with open_package(content) as package:
        return ods.sheet_names(package) if sniff(content[:8192]) == "ods" else [name for name, _ in xlsx.sheet_names(package)]


def properties_of(content: bytes) -> dict[str, Any]:
    """Format, properties and sheets of a document's bytes; a CSV file has no properties."""
    kind = sniff(content[:8192])
    found: dict[str, Any] = {"format": kind, **dict.fromkeys(_PROPERTIES), "sheets": []}
    if kind == "csv":
        return found
    with open_package(content) as package:
        if kind == "ods":
            said = ods.document_meta(package)
        else:
            data = entry(package, "docProps/core.xml")
            said = {local(e.tag): e.text or "" for e in tree(data)} if data else {}
        for name, value in said.items():
            name = _NAMES.get(name, name)
            if name in _PROPERTIES and (found[name] is None or name != "creator" or value):
                found[name] = value or found[name]
    return found | {"sheets": sheets_of(content)}


def _each(files: DataFrame, fn) -> list[Any]:
    """fn(content) of every file, computed on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    said = json.dumps(fn(content.as_py()))
                except EngineError as error:
                    said = encode_error(error)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([said])], names=["path", "said"])

    out = []
    for row in files.select("path", "content").mapInArrow(run, "path string, said string").orderBy("path").collect():
        if error := decode_error(row["said"]):
            raise error
        out.append(json.loads(row["said"]))
    return out


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """The sheet names of the workbook at a path."""

    def names(content: bytes) -> list[str]:
        if sniff(content[:8192]) == "csv":
            raise UnsupportedFormat("A CSV file has no sheets")
        return sheets_of(content)

    return _each(binary_files(spark, path), names)[0]


def sheet_frame(spark: SparkSession, path: str) -> DataFrame:
    """(position, sheet) of the workbook at a path."""
    return spark.createDataFrame(list(enumerate(sheet_names(spark, path))), "position int, sheet string")


def properties(spark: SparkSession, path: str) -> dict[str, Any]:
    """Format, properties and sheets of the document at a path."""
    return _each(binary_files(spark, path), properties_of)[0]


def properties_frame(spark: SparkSession, path: str) -> DataFrame:
    """One row with format, properties and the number of sheets of the document at a path."""
    found = properties(spark, path)
    names = ["format", *_PROPERTIES]
    row = spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"`{n}` string" for n in names))
    return row.withColumn("n_sheets", F.lit(len(found["sheets"])))
