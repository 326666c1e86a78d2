"""SimHash near-dedup: a self-join of a binary trie over the fingerprints.

Two fingerprints within 3 bits differ in at most one bit of one of their
halves. So two tries are walked, one over the bits as they are and one with the
halves swapped, each with an error budget of 1 bit for the first half and 3 for
all. The walk takes pairs of nodes together from the roots, adds up the bits in
which they differ and drops a pair as soon as its budget is exceeded.

The top of each trie is walked by Spark: a fingerprint goes to the cell of its
own prefix and to one cell for each bit of the prefix in which a partner may
differ. The rest of a cell is walked in one task, level by level over arrays.
A cell that is still crowded where the first half ends is cut as a trie of its
own: what is left of the budget, 3 bits or 2, leaves at most one bit to one of
the second half's quarters. So each cell has a bound, whatever fingerprints are
alike. A cell returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_rows, slices, table, worker_cache
from .components import components

BITS, HALF, QUARTER = 64, 32, 16
#: Differing bits that link two fingerprints, and those allowed in the first half of a trie.
MAX_DIFF, HALF_DIFF = 3, 1
SHINGLE_WORDS, SEED = 3, 42
#: Fingerprints that a prefix cell should hold on average.
CELL_SIZE = 8192
#: Fingerprints beyond which a cell is split by so many bits more.
CELL_LIMIT, SPLIT_BITS = 1 << 17, 4
#: Node pairs that are expanded at a time; pairs with at most BRUTE leaf pairs are compared at once.
CHUNK, BRUTE = 1 << 17, 64


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a whole text: 3-word shingles, each with its repeats, hashed by XXH64."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("simhash_dedup")  # lets go of what another operator has cached
    for part in slices(batches):
        prints = pa.array([fingerprint(t) for t in part.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), prints], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null and empty texts have fingerprint zero."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


class Forest:
    """Labels of connected leaves, updated by batches of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._changes()

    def _changes(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else self.label

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        grown = False
        while True:
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                break
            grown = True
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            low, high = np.minimum(a, b), np.maximum(a, b)
            up = np.arange(len(self.label))
            np.minimum.at(up, high, low)
            while True:
                jump = up[up]
                if (jump == up).all():
                    break
                up = jump
            self.label = up[self.label]
        if grown:
            self._changes()

    def same(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the leaves from lo up to hi share a label."""
        return self.changes[hi - 1] == self.changes[lo]


def trie_join(leaves: np.ndarray, first_bit: int = 0, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (leaf, root indexes) of the links among sorted distinct ``leaves``.

    Bits above ``first_bit`` have been walked. With ``split``, leaves before it
    and from it on are two subtrees whose prefixes differ in one bit, and only
    pairs across them are walked. Pairs within budget on the first half and in
    all are links.
    """
    n, forest = len(leaves), Forest(len(leaves))
    if n < 2 or split in (0, n):
        return np.empty(0, int), np.empty(0, int)
    start = (0, n, 0, n, 0) if split is None else (0, split, split, n, 1)
    stack = [(first_bit, np.array([start], dtype=np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > CHUNK:
            stack.append((depth, pairs[CHUNK:]))
            pairs = pairs[:CHUNK]
        a0, a1, b0, b1, _ = pairs.T
        known = forest.same(a0, a1) & forest.same(b0, b1) & (forest.label[a0] == forest.label[b0])
        pairs = pairs[~known]
        few = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= BRUTE
        if few.any() or depth == BITS:
            at = few | (depth == BITS)
            _compare(leaves, forest, pairs[at])
            pairs = pairs[~at]
        if len(pairs):
            stack.append((depth + 1, _expand(leaves, pairs, depth)))
    member = np.flatnonzero(forest.label != np.arange(n))
    return member, forest.label[member]


def _expand(leaves: np.ndarray, pairs: np.ndarray, depth: int) -> np.ndarray:
    """The pairs of children that are still within budget after the bit at ``depth``."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
    a0, a1, b0, b1, diff = pairs.T

    def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.clip(np.searchsorted(leaves, (leaves[lo] & ~(bit | (bit - np.uint64(1)))) | bit), lo, hi)

    am, bm = middle(a0, a1), middle(b0, b1)
    own = (a0 == b0) & (a1 == b1)
    children = [
        np.stack([a0, am, b0, bm, diff], 1),
        np.stack([am, a1, bm, b1, diff], 1),
        np.stack([a0, am, bm, b1, diff + 1], 1),
        np.stack([am, a1, b0, bm, diff + 1], 1)[~own],
    ]
    out = np.concatenate(children)
    budget = HALF_DIFF if depth < HALF else MAX_DIFF
    full = (out[:, 0] < out[:, 1]) & (out[:, 2] < out[:, 3]) & (out[:, 4] <= budget)
    alone = (out[:, 0] == out[:, 2]) & (out[:, 1] - out[:, 0] == 1) & (out[:, 3] - out[:, 2] == 1)
    return out[full & ~alone]


def _compare(leaves: np.ndarray, forest: Forest, pairs: np.ndarray) -> None:
    """Link the leaves of the given node pairs that are within the budget."""
    for at in range(0, len(pairs), CHUNK // 8):
        a0, a1, b0, b1, _ = pairs[at : at + CHUNK // 8].T
        width = b1 - b0
        size = (a1 - a0) * width
        which = np.repeat(np.arange(len(size)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        i, j = a0[which] + k // width[which], b0[which] + k % width[which]
        near = (i != j) & (np.bitwise_count(leaves[i] ^ leaves[j]) <= MAX_DIFF)
        forest.link(i[near], j[near])


def _walk_cell(key: tuple, rows: pa.Table) -> pa.Table:
    """The links of one cell (side, prefix, way, turn, depth)."""
    side, _, way, _, depth = (k.as_py() for k in key)
    leaves = np.sort(_word(np.unique(rows.column("fp").to_numpy().astype(np.int64).view(np.uint64)), side))
    split = None
    if way >= 0:
        bit = np.uint64(1) << np.uint64(BITS - 1 - way)
        split = int(np.searchsorted(leaves, (leaves[0] & ~(bit | (bit - np.uint64(1)))) | bit)) if len(leaves) else 0
    # below the first half all bits of the cell's leaves but that of its way agree down to there
    u, v = (_print(leaves[x], side) for x in trie_join(leaves, min(depth, HALF), split))
    return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})


def _swap(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(HALF)) | (x >> np.uint64(HALF))


def _swap_quarters(x: np.ndarray) -> np.ndarray:
    """The quarters of the second half in the other order."""
    low = np.uint64((1 << QUARTER) - 1)
    return (x & ~np.uint64((1 << HALF) - 1)) | ((x & low) << np.uint64(QUARTER)) | ((x >> np.uint64(QUARTER)) & low)


def _word(x: np.ndarray, side: int) -> np.ndarray:
    """Fingerprints in the order of bits of a trie: halves swapped on odd sides, then quarters of the second one from side 2 on."""
    x = _swap(x) if side & 1 else x
    return _swap_quarters(x) if side & 2 else x


def _print(x: np.ndarray, side: int) -> np.ndarray:
    """The inverse of _word()."""
    x = _swap_quarters(x) if side & 2 else x
    return _swap(x) if side & 1 else x


_CELL = ["side", "prefix", "way", "turn", "depth"]


def _prefix(side: Column, depth: int) -> Column:
    """The first ``depth`` bits of a fingerprint in the trie of a side."""
    word = F.when(side % 2 == 0, F.col("fp")).otherwise(F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF)))
    if depth > HALF:
        low = lambda c: c.bitwiseAND(F.lit((1 << QUARTER) - 1))
        turned = word.bitwiseAND(F.lit(-1 << HALF)).bitwiseOR(F.shiftleft(low(word), QUARTER)).bitwiseOR(low(F.shiftrightunsigned(word, QUARTER)))
        word = F.when(side < 2, word).otherwise(turned)
    return F.shiftrightunsigned(word, BITS - depth) if depth else F.lit(0).cast("long")


def _deeper(cells: DataFrame, above: int, depth: int) -> DataFrame:
    """The cells at ``depth`` of fingerprints that are in the given ones at ``above``; both are in the first half, or not above its end.

    A cell of one node has a cell for each node below it, and one for each pair
    of them that differs in one bit (the way in the first half, the turn beyond
    it; -1 for none): clearing that bit leads both partners to the same cell. A
    cell of two nodes has spent the budget of one bit, so only equal ways down
    go on together. Where the second half begins there are two tries again, by
    the quarter that comes first.
    """
    if depth > HALF == above:
        cells = cells.withColumn("side", F.explode(F.array(F.col("side"), F.col("side") + 2)))
    clear = lambda of, bit: of.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth - 1) - bit).cast("int"))))
    prefix = _prefix(F.col("side"), depth)
    prefix = F.when(F.col("way") < 0, prefix).otherwise(clear(prefix, F.col("way")))
    mark = "way" if depth <= HALF else "turn"
    own = lambda p, bit: F.struct(p.alias("prefix"), bit.cast("int").alias(mark))
    forks = F.transform(F.sequence(F.lit(above), F.lit(depth - 1)), lambda b: own(clear(prefix, b), b)) if depth > above else F.array().cast(f"array<struct<prefix:bigint,{mark}:int>>")
    marked = F.array(own(clear(prefix, F.col(mark)), F.col(mark)))
    found = F.when(F.col(mark) < 0, F.concat(F.array(own(prefix, F.lit(-1))), forks)).otherwise(marked)
    kept = [c for c in ("side", "way", "turn") if c != mark]
    return cells.select("fp", *kept, F.explode(found).alias("c")).select("fp", *kept, "c.*", F.lit(depth).alias("depth")).select("fp", *_CELL)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that connect the rows of ``distinct`` (fp) as all pairs within MAX_DIFF bits would.

    Cells that hold more than CELL_LIMIT fingerprints are split further down
    their trie, to the end of the next quarter beyond the first half: there the
    fingerprints of a cell agree but in two bits of 48, so it holds at most
    2^18.
    """
    n = distinct.count()
    depth = min(HALF, max(0, (n // CELL_SIZE).bit_length()))
    roots = distinct.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumns({"way": F.lit(-1), "turn": F.lit(-1)})
    cells, walked = _deeper(roots, 0, depth), []
    while depth < HALF + QUARTER:
        full = cut(cells.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL_LIMIT).drop("n"))
        if full.isEmpty():
            break
        walked.append(cells.join(full, _CELL, "left_anti"))
        below = min(HALF if depth < HALF else HALF + QUARTER, depth + SPLIT_BITS)
        cells, depth = cut(_deeper(cells.join(full, _CELL, "left_semi"), depth, below)), below
    for part in walked:
        cells = cells.unionByName(part)
    return cells.groupBy(*_CELL).applyInArrow(_walk_cell, "u long, v long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints that differ in at most 3 bits are linked; component_id is the
    smallest id that links reach, the row's own included. Null and empty texts
    have fingerprint zero and are linked like any other. A null id counts as
    none: a component of null ids has component_id null. Repeated rows come back
    as often as they came; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = cut(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the row of the smallest id of each component, all columns as they were."""
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    named = docs.select(F.struct("doc_id", key.alias("key")).alias("both"), "text")
    prints = cut(named.mapInArrow(_keyed_fingerprints, "doc_id long, key string, fp long"))
    distinct = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("first")))
    roots = components(links(distinct.select("fp")))
    rooted = cut(distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("best"))
    by_print = cut(rooted.join(least, "root").select("fp", F.col("best.doc_id").alias("best_id"), F.col("best.key").alias("best_key")))
    kept = (F.col("key") == F.col("best_key")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    decided = prints.join(by_print, "fp").select(F.col("doc_id").alias("id"), "key", kept.alias("kept"))
    return drop_rows(docs, key, decided)


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("simhash_dedup")  # lets go of what another operator has cached
    for part in slices(batches):
        both = part.column(0)
        prints = pa.array([fingerprint(t) for t in part.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([both.field(0).cast(pa.int64()), both.field(1), prints], names=["doc_id", "key", "fp"])


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash_dedup(table(spark, sf_dir, "documents"))


QUERY = ("op9_simhash_dedup", op9_simhash_dedup)
ORACLE = None
