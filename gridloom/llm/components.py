"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (u, v), both long.

    Each round sends every vertex to its smallest neighbour under an order that
    is shuffled anew by a hash, relabels the links and drops those that became
    loops, so chains shrink by a constant factor whatever their ids are. The
    moves of all rounds are then composed. All steps are joins and partial
    aggregations; a hub of any degree is one row of the aggregation.
    """
    moves: list[DataFrame] = []
    links = cut(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    seed = 0
    while not links.isEmpty():
        seed += 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        both = links.select(F.col("u").alias("vertex"), order("v").alias("o")).unionAll(links.select(F.col("v").alias("vertex"), order("u").alias("o")))
        near = both.groupBy("vertex").agg(F.min("o").alias("o"))
        move = cut(near.select("vertex", F.least(F.col("o"), order("vertex")).getField("x").alias("root")))
        moves.append(move)
        to = lambda end: move.select(F.col("vertex").alias(end), F.col("root").alias(f"{end}_to"))  # noqa: E731, B023
        moved = links.join(to("u"), "u").join(to("v"), "v").select("u_to", "v_to").filter("u_to <> v_to")
        links = cut(moved.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct())
    if not moves:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).limit(0)

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        step = later.select(F.col("vertex").alias("root"), F.col("root").alias("last"))
        return cut(earlier.join(step, "root", "left").select("vertex", F.coalesce("last", "root").alias("root")))

    return reduce(compose, reversed(moves))
