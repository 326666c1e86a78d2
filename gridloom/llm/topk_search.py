"""Exact top-k inner-product search over a bit-sliced index.

Components are quantised to integers and the rows are cut into blocks. For each
attribute and each bit of its values a block holds one bitmap over its rows. A
query's score for all rows of a block is then one sum of shifted bitmaps, done
with carry-save adders on whole bitmaps: each component of the query is written
with digits +1, 0, -1, and a negative digit takes the complement. The sum is
itself bit-sliced; the best rows are found by walking its slices from the most
significant downward, and rows that tie at the boundary are taken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SCALE = 1024
#: Rows of a block, and queries that meet a block at a time.
BLOCK_ROWS, CHUNK_QUERIES = 8192, 128
K, EVERY = 10, 100
TOO_LARGE = "topk: a component or one of the best scores does not fit 64 bits"


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(shift, sign) of the non-adjacent form of an integer."""
    out, shift = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((shift, sign))
            value -= sign
        value >>= 1
        shift += 1
    return out


def bit_slices(values: np.ndarray, low: int, bits: int) -> np.ndarray:
    """Bitmaps of the rows' values above ``low``: [attribute, bit, word of 64 rows]."""
    n, dims = values.shape
    shifted = (values - low).view(np.uint64)  # right modulo 2^64, whatever the span
    plain = np.zeros((dims, bits, max(1, -(-n // 64)) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        plain[:, b, : packed.shape[0]] = packed.T
    return plain.view(np.uint64)


class Block:
    """The stored bitmaps of ``n`` rows, and those of the complements: slices[sign, attribute, bit]."""

    def __init__(self, plain: np.ndarray, n: int, low: int):
        self.low, self.bits = low, plain.shape[1]
        rows = np.zeros(plain.shape[2] * 8, np.uint8)
        packed = np.packbits(np.ones(n, np.uint8), bitorder="little")
        rows[: len(packed)] = packed
        self.rows = rows.view(np.uint64)
        self.slices = np.stack([plain, ~plain & self.rows])

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the score of every row, least significant first, and the constant to add."""
        full = (1 << self.bits) - 1
        constant, levels = self.low * sum(query.tolist()), {}
        for d, q in enumerate(query.tolist()):
            for shift, sign in signed_digits(q):
                if sign < 0:
                    constant -= full << shift
                for b in range(self.bits):
                    levels.setdefault(shift + b, []).append((sign < 0, d, b))
        out, carried, level, top = [], [], 0, max(levels, default=-1)
        while level <= top or carried:
            at = np.array(levels.get(level, []), int).reshape(-1, 3)
            x = np.concatenate([self.slices[at[:, 0], at[:, 1], at[:, 2]], *carried]) if len(at) or carried else np.zeros((0, len(self.rows)), np.uint64)
            carried = []
            while len(x) > 2:
                k = len(x) // 3
                a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                half = a ^ b
                carried.append((a & b) | (half & c))
                x = np.concatenate([half ^ c, x[3 * k :]])
            if len(x) == 2:
                carried.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
            out.append(x[0] if len(x) else np.zeros_like(self.rows))
            level += 1
        return out, constant

    def best(self, query: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows but one; ties go to the first rows."""
        slices, constant = self.scores(query)
        sure, maybe = np.zeros_like(self.rows), self.rows.copy()
        if without >= 0:
            maybe[without >> 6] &= ~(np.uint64(1) << np.uint64(without & 63))
        need = k
        for s in reversed(slices):
            up = maybe & s
            n = int(np.bitwise_count(up).sum())
            if n > need:
                maybe = up
            else:
                sure, maybe, need = sure | up, maybe & ~s, need - n
                if not need:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if need:
            ties = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))[:need]
            rows = np.concatenate([rows, ties])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        # the constant and the slices by themselves may be beyond 64 bits
        total = [constant] * len(rows)
        for i, s in enumerate(slices):
            set_ = ((s[word] >> bit) & np.uint64(1)).tolist()
            total = [t + (one << i) for t, one in zip(total, set_)]
        if any(not -(1 << 63) <= t < 1 << 63 for t in total):
            raise ValueError(TOO_LARGE)
        return rows, np.array(total, np.int64)


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows; one that is shorter counts as ending in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.array([len(x) for x in lists], int))])
    out = np.zeros((len(lists), dims), np.int64)
    for i in range(len(lists)):
        out[i, : ends[i + 1] - ends[i]] = values[ends[i] : ends[i + 1]]
    return out


def _index(dims: int, low: int, bits: int):
    """One row for a block of vectors: ids and uids by id, and the bitmaps of their components."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, uids, values = _by_id(rows, dims)
        return _blobs(ids=ids, uids=uids, slices=bit_slices(values, low, bits))

    return run


def _asked(dims: int):
    """One row for a chunk of queries: ids, uids and components."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, uids, values = _by_id(rows, dims)
        return _blobs(q_ids=ids, q_uids=uids, q_v=values)

    return run


def _by_id(rows: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, uids = rows.column("vec_id").to_numpy(), rows.column("uid").to_numpy()
    order = np.lexsort((uids, ids))
    return ids[order], uids[order], _matrix(rows.column("v"), dims)[order]


def _blobs(**arrays: np.ndarray) -> pa.Table:
    return pa.table({name: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for name, a in arrays.items()})


def _search(low: int, bits: int, dims: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        name, block, order, sorted_uids = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, uids, plain, q_ids, q_uids, q_v = (np.frombuffer(c[i].as_py(), "<i8") for c in batch.columns)
                if name != uids.tobytes():
                    name, block = uids.tobytes(), Block(plain.view(np.uint64).reshape(dims, bits, -1), len(ids), low)
                    order = np.argsort(uids)
                    sorted_uids = uids[order]
                at = np.minimum(np.searchsorted(sorted_uids, q_uids), len(uids) - 1)
                own = np.where(sorted_uids[at] == q_uids, order[at], -1).tolist()
                for q_id, q_uid, q, itself in zip(q_ids.tolist(), q_uids.tolist(), q_v.reshape(-1, dims), own):
                    rows, points = block.best(q, k, itself)
                    found = ids[rows]
                    if (q_id, q_uid) in best:
                        before = best[q_id, q_uid]
                        found, points = np.concatenate([before[0], found]), np.concatenate([before[1], points])
                    top = np.lexsort((found, ~points))[:k]
                    best[q_id, q_uid] = found[top], points[top]
        for (q_id, q_uid), (found, points) in best.items():
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([q_id] * n, pa.int64()), pa.array([q_uid] * n, pa.int64()), pa.array(found, pa.int64()), pa.array(points, pa.int64())], names=["query_id", "q_uid", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest inner product for each row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding. A component x counts as
    floor(1024 * x); a vector that is null or has a null, NaN or infinite
    component takes no part, nor does a row without id. A shorter vector counts
    as ending in zeros. A row is not a candidate for itself, but a repeated row
    is for its twin, and each twin of a query gives results. Ties go to the
    smaller vec_id. A component that does not fit 64 bits when quantised, or a
    score among the best of a block that does not, raises; others are exact. An
    empty table gives an empty result; other columns are not read.
    """
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    fits = F.forall(scaled, lambda x: F.abs(x) < float(1 << 63))
    quantised = F.when(fits, F.transform(scaled, lambda x: F.floor(x))).otherwise(F.raise_error(F.lit(TOO_LARGE)).cast("array<bigint>"))
    rows = vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised.alias("v"))
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    n, dims, low, high = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n or not dims:
        return empty
    low, high = min(0, low), max(0, high)
    bits = max(1, (high - low).bit_length())

    def groups(of: DataFrame, size: int, count: int, gather, names: str) -> DataFrame:
        parts = max(1, -(-count // size))
        keyed = of.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)))
        packed = keyed.repartition(parts, "part").groupBy("part").applyInArrow(gather, ", ".join(f"{n} binary" for n in names.split()))
        return cut(packed).coalesce(parts)  # a block is one row: no empty partitions go into the pairs

    queries = rows.filter(F.col("vec_id") % every == 0)
    n_queries = queries.count()
    if not n_queries:
        return empty
    index = groups(rows, BLOCK_ROWS, n, _index(dims, low, bits), "ids uids slices")
    asked = groups(queries, CHUNK_QUERIES, n_queries, _asked(dims), "q_ids q_uids q_v")
    # the stated query set against all rows, block by block
    found = index.crossJoin(asked).mapInArrow(_search(low, bits, dims, k), "query_id long, q_uid long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q_uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every hundredth embedding."""
    return topk(table(spark, sf_dir, "embeddings"))


QUERY = ("op3_topk_search", op3_topk_search)

ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
