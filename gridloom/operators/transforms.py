"""Row transforms: each returns a function from frame to frame.

They are expressions of the same plan, so a chain of them is one projection.
Those that speak of positions need the column ``_row_id`` (see ``rowid``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..rowid import ROW_ID, require_row_id

Transform = Callable[[DataFrame], DataFrame]


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _each(df: DataFrame, change: Callable[[Column, T.StructField], Column]) -> DataFrame:
    """Every column but the row id through ``change``."""
    return df.select(*[_col(f.name) if f.name == ROW_ID else change(_col(f.name), f).alias(f.name) for f in df.schema.fields])


def trim(keys: bool = False) -> Transform:
    """Strip white space and NUL from text cells, and from column names if asked."""

    def run(df: DataFrame) -> DataFrame:
        out = _each(df, lambda c, f: C.trimmed(c) if isinstance(f.dataType, T.StringType) else c)
        return out.toDF(*[n.strip(C.SPACES) for n in out.columns]) if keys else out

    return run


def null_as(value: str) -> Transform:
    """Replace null cells by a text; other cells of a column that is no text become text."""
    return lambda df: _each(df, lambda c, f: F.coalesce(c if isinstance(f.dataType, T.StringType) else F.when(c.isNotNull(), C.stringify(c, f.dataType)), F.lit(value)))


def bool_as(true: str, false: str) -> Transform:
    """Replace booleans by two texts; null stays null."""
    return lambda df: _each(df, lambda c, f: F.when(c, true).when(~c, false) if isinstance(f.dataType, T.BooleanType) else c)


def map_cells(fn: Callable[[Column, str], Column]) -> Transform:
    """Replace every cell by an expression of it and its column's name."""
    return lambda df: _each(df, lambda c, f: fn(c, f.name))


def map_rows(fn: Callable, schema: T.StructType | str | None = None) -> Transform:
    """Replace every row.

    Without ``schema``, ``fn(df, index)`` returns the columns of the new row as
    expressions. With a schema, ``fn(row, index)`` is Python: it takes and
    returns a mapping and runs on Arrow batches.
    """
    if schema is None:

        def declared(df: DataFrame) -> DataFrame:
            require_row_id(df, "map_rows")
            return df.select(_col(ROW_ID), *fn(df, _col(ROW_ID)))

        return declared

    def opaque(df: DataFrame) -> DataFrame:
        require_row_id(df, "map_rows")
        target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        full = T.StructType([T.StructField(ROW_ID, T.LongType()), *target.fields])
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    index = row.pop(ROW_ID)
                    rows.append({ROW_ID: index, **fn(row, index)})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return df.mapInArrow(run, full)

    return opaque


def filter_rows(predicate: Column | Callable[[Column], Column]) -> Transform:
    """Keep rows that an expression holds for; a callable gets the index that rows had before."""

    def run(df: DataFrame) -> DataFrame:
        if isinstance(predicate, Column):
            return df.filter(predicate)
        require_row_id(df, "a filter by index")
        return df.filter(predicate(_col(ROW_ID)))

    return run


def cast(types: Mapping[str, str]) -> Transform:
    """Permissive casts by column (int, float, bool, string, date, each with ``?`` for nullable); names that are not there are passed over."""
    return lambda df: _each(df, lambda c, f: C.cast_value(c, f.dataType, types[f.name]) if f.name in types else c)


def cast_strict(types: Mapping[str, str]) -> Transform:
    """Casts that raise, with row and column, for a value that does not fit."""
    for kind in types.values():
        if kind.removeprefix("?") not in C.CAST_TYPES:
            raise ValueError(f"unknown type: {kind}")

    def run(df: DataFrame) -> DataFrame:
        require_row_id(df, "cast_strict")
        return _each(df, lambda c, f: C.cast_strict(c, f.dataType, types[f.name], _col(ROW_ID), f.name) if f.name in types else c)

    return run


def chunk(size: int) -> Transform:
    """Rows in lists of ``size``, the last one shorter: (chunk, rows), rows in order.

    A chunk is a group of ``size`` rows at most, so groups stay small however many rows there are.
    """
    if size <= 0:
        raise ValueError("a chunk must hold at least one row")

    def run(df: DataFrame) -> DataFrame:
        require_row_id(df, "chunk")
        row = F.struct(_col(ROW_ID), *[_col(n) for n in df.columns if n != ROW_ID])
        return df.groupBy(F.floor(_col(ROW_ID) / size).alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    return run


def slice_rows(offset: int = 0, limit: int | None = None) -> Transform:
    """Rows from ``offset`` on, ``limit`` at most, numbered anew from 0.

    The row ids are dense, so this is a filter on a range of them; no sort is needed.
    """
    if offset < 0 or limit is not None and limit < 0:
        raise ValueError("offset and limit must not be negative")

    def run(df: DataFrame) -> DataFrame:
        require_row_id(df, "slice_rows")
        at = _col(ROW_ID)
        inside = at >= offset if limit is None else (at >= offset) & (at < offset + limit)
        return df.filter(inside).withColumn(ROW_ID, at - offset)

    return run


def renumber(df: DataFrame, order_by: Any = None) -> DataFrame:
    """Dense row ids again after rows went."""
    from ..rowid import with_row_id

    require_row_id(df, "renumber")
    return with_row_id(df.withColumnRenamed(ROW_ID, "_old_row_id"), order_by or "_old_row_id").drop("_old_row_id")
