"""Exact dedup by a tree-merge of sorted digest runs.

Every partition turns its rows into one run of (digest, length, smallest row,
count), sorted by digest. The partitions are then nodes of a hypercube: in each
round a node cuts its run into 2^RADIX_BITS pieces by the next bits of the
digest and sends each piece to the peer whose address has those bits, where the
pieces of all peers meet in a multiway merge that keeps the smallest row of
every digest. After log2(nodes) bits each digest lives at one node. A digest
occurs once in a run however many copies a text has, so large groups of copies
weigh nothing in the exchange. Runs are flat arrays of 65 bytes a digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_rows, table

#: Address bits that one round settles: 2^3 peers exchange runs.
RADIX_BITS = 3

#: Rows of a partition that wait to be merged into its run.
BUFFER_ROWS = 1 << 20
#: A row of a run: bytes of the digest, length of the text, whether the smallest row has no id, that id and row number, number of rows.
RUN = np.dtype([("digest", "S32"), ("length", "<i8"), ("none", "?"), ("id", "<i8"), ("uid", "<i8"), ("n", "<i8")])
_PIECE = "node long, run binary"
_GROUP = "digest binary, length long, id long, uid long, n long"


def normalised(text):
    """The text as it is compared: null is empty, each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """Multiway merge of runs: one row for each digest and length, with its smallest row (null ids last) and the sum of the counts.

    The sort is stable and merges stretches that are in order, as runs are.
    """
    rows = np.concatenate([np.empty(0, RUN), *runs])
    rows = rows[np.lexsort((rows["uid"], rows["id"], rows["none"], rows["length"], rows["digest"]))]
    if not len(rows):
        return rows
    new = np.concatenate([[True], (rows["digest"][1:] != rows["digest"][:-1]) | (rows["length"][1:] != rows["length"][:-1])])
    starts = np.flatnonzero(new)
    out = rows[starts]
    out["n"] = np.add.reduceat(rows["n"], starts)
    return out


def _digests(run: np.ndarray) -> np.ndarray:
    """The digests as rows of 32 bytes: a fixed string would lose zeros at its end."""
    return np.ascontiguousarray(run["digest"]).view(np.uint8).reshape(-1, 32)


def _sent(node: int, run: np.ndarray, bits: int, settled: int) -> pa.Table:
    """The run cut by the address bits of the next round: (node, run) for each peer."""
    width = min(RADIX_BITS, bits - settled)
    mask = ((1 << width) - 1) << settled
    address = _digests(run)[:, :8].copy().view(">u8").ravel().astype(np.int64) & mask
    peers = np.unique(address).tolist()
    pieces = [run[address == to].tobytes() for to in peers]
    return pa.table({"node": pa.array([(node & ~mask) | to for to in peers], pa.int64()), "run": pa.array(pieces, pa.binary())})


def _groups(run: np.ndarray) -> pa.Table:
    digest = pa.Array.from_buffers(pa.binary(32), len(run), [None, pa.py_buffer(_digests(run).tobytes())]).cast(pa.binary())
    ids = pa.array(run["id"].copy(), mask=run["none"].copy())
    return pa.table({"digest": digest, "length": run["length"].copy(), "id": ids, "uid": run["uid"].copy(), "n": run["n"].copy()})


def _as_run(batch: pa.RecordBatch) -> np.ndarray:
    """Rows (digest, length, id, uid), each as a row of a run that is not in order."""
    out = np.empty(batch.num_rows, RUN)
    digest, length, ids, uid = batch.columns
    out["digest"] = np.frombuffer(b"".join(digest.to_pylist()), "S32")
    out["none"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["length"], out["id"], out["uid"], out["n"] = length.to_numpy(), ids.fill_null(0).to_numpy(), uid.to_numpy(), 1
    return out


def _local_run(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, waiting, size = np.empty(0, RUN), [], 0
        for batch in (b for b in batches if b.num_rows):
            waiting.append(_as_run(batch))
            size += batch.num_rows
            if size >= max(BUFFER_ROWS, len(run)):
                run, waiting, size = merge([run, *waiting]), [], 0
        run = merge([run, *waiting])
        node = TaskContext.get().partitionId() & ((1 << bits) - 1)
        yield from _sent(node, run, bits, 0).to_batches()

    return build


def _merge_round(bits: int, settled: int):
    def at_node(key: tuple, pieces: pa.Table) -> pa.Table:
        run = merge([np.frombuffer(b, RUN) for b in pieces.column("run").to_pylist()])
        return _sent(key[0].as_py(), run, bits, settled) if settled < bits else _groups(run)

    return at_node


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row for each (digest, length) of ``rows`` (digest, length, id, uid): its smallest row and its count."""
    bits = max(0, rows.rdd.getNumPartitions() - 1).bit_length()
    pieces = rows.mapInArrow(_local_run(bits), _PIECE)
    settled = 0
    while True:
        settled = min(bits, settled + RADIX_BITS)
        last = settled >= bits
        pieces = pieces.groupBy("node").applyInArrow(_merge_round(bits, settled), _GROUP if last else _PIECE)
        if last:
            return pieces


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide for every row whether it stays: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are identical after each run of ASCII white space
    became one space; null is the empty text. The row with the smallest id
    stays; a null id comes after all others, and of rows that share the smallest
    id one stays. SHA-256 and the length both have to agree. An empty table
    gives an empty result; other columns are not read.
    """
    text = normalised(F.col(text_col))
    rows = cut(
        docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).select(
            F.unhex(F.sha2(F.col("t"), 256)).alias("digest"),
            F.octet_length("t").cast("long").alias("length"),
            "id",
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    groups = digest_groups(rows).withColumnsRenamed({"id": "keep_id", "uid": "keep_uid", "n": "group_size"})
    joined = rows.join(groups, ["digest", "length"])
    return joined.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group of equal texts, all columns as they were."""
    decided = exact_dedup(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"), "kept")
    return drop_rows(docs, F.sha2(normalised(F.col("text")), 256), decided)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERY = ("op10_exact_dedup", op10_exact_dedup)

ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g ON n.text_sha256 = g.text_sha256
"""
