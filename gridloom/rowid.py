"""Row identity: order is explicit in a column, ``_row_id``, dense from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

ROW_ID = "_row_id"
#: Partitions whose first row ids stand in the plan as a map; with more, they are a small table.
LITERAL_PARTS = 500


def with_row_id(df: DataFrame, order_by: Sequence[Column | str] | str | None = None, name: str = ROW_ID) -> DataFrame:
    """``df`` with a dense row number by ``order_by``, which should order the rows fully.

    Rows are range-partitioned, sorted and written once, because neither the
    bounds of the ranges nor how small ones are put together is the same in
    another run; only the row counts of the partitions meet in one place, never
    the rows. A frame that has the column keeps it.
    """
    if name in df.columns:
        return df
    if order_by is None:
        raise ValueError(f"rows have no order: give order_by, or a frame with a column {name}")
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    at = F.monotonically_increasing_id()
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.shiftright(at, 33), "_place": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each partition
    start, starts = 0, []
    for part, n in sorted(sizes):
        starts.append((part, start))
        start += n
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    if len(starts) <= LITERAL_PARTS:
        first = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("_part").cast("long")]
    else:
        placed = placed.join(F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long")), "_part")
        first = F.col("_start")
    return placed.withColumn(name, (first + F.col("_place")).cast("long")).drop("_part", "_place", "_start")


def require_row_id(df: DataFrame, what: str) -> None:
    """Raise if the rows have no identity."""
    if ROW_ID not in df.columns:
        raise ValueError(f"{what} needs the column {ROW_ID}: use with_row_id(df, order_by) or read with row_id=True")
