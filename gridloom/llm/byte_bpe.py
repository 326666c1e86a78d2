"""Byte-level BPE by recursive DuckDB queries in every partition.

A pattern splits a text into words, and each word that a worker has not met yet
goes into a DuckDB table. A recursive query unnests the words that still change
into token-position rows, joins neighbouring pairs with the merge table and
contracts each word's leftmost pair of least rank, until no pair can merge.
Decoding joins (text, position, id) rows with the vocabulary and aggregates the
bytes in order of position.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, worker_cache

#: Characters of text, and tokens to decode, that go into one round of queries.
ROUND_CHARS, ROUND_TOKENS = 3_000_000, 400_000
#: Words in each of the two generations of a worker's cache.
CACHE_WORDS = 250_000
#: A longer word is merged with a heap: a query would need a round for each of its bytes.
QUERY_BYTES = 200

_CONTRACT = """
WITH RECURSIVE step(w, l) USING KEY (w) AS (
  SELECT w, list(s ORDER BY p) FROM symbols GROUP BY w
  UNION (
    WITH pairs AS (SELECT w, unnest(l[1:-2]) AS s, unnest(l[2:]) AS ns, unnest(range(1, len(l))) AS p FROM step),
    best AS (SELECT w, min(m.rank * 4294967296 + p) AS b FROM pairs JOIN merges m ON m.pair = s * 4294967296 + ns GROUP BY w)
    SELECT w, l[1:(b % 4294967296) - 1] || [b // 4294967296] || l[(b % 4294967296) + 2:] FROM step JOIN best USING (w)
  )
)
SELECT w, l AS ids FROM step
"""

_EXPAND = "SELECT t, unhex(string_agg(h, '' ORDER BY p)) AS b FROM tokens JOIN vocabulary USING (id) GROUP BY t"


class Bpe:
    """The merge table and vocabulary of a rank file in a DuckDB database, with a cache of words."""

    def __init__(self, ranks_file: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        merges = [(self.ranks[b[:i]], self.ranks[b[i:]], r) for b, r in self.ranks.items() for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks]
        left, right, rank = np.array(merges, np.int64).reshape(-1, 3).T
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '400MB'")
        self._load("merges_in", pa.table({"pair": (left << 32) + right, "rank": rank}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self._load("vocabulary_in", pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "h": [b.hex() for b in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register(name, rows)

    def _learn(self, words: list[str]) -> None:
        """Put the ids of the given words into the cache."""
        if len(self.new) + len(words) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [i for i, b in enumerate(raw) if len(b) <= QUERY_BYTES]
        for i, b in enumerate(raw):
            if len(b) > QUERY_BYTES:
                self.new[words[i]] = np.array(self.merge_long(b), "<u4").tobytes()
        if not short:
            return
        lengths = np.array([len(raw[i]) for i in short])
        flat = np.frombuffer(b"".join(raw[i] for i in short), np.uint8)
        word = np.repeat(np.arange(len(short)), lengths)
        position = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self._load("symbols", pa.table({"w": word, "p": position, "s": self.byte_id[flat]}))
        found = self.db.sql(_CONTRACT).to_arrow_table()
        ids = found.column("ids").combine_chunks()
        values, ends = ids.values.to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy()
        for w, lo, hi in zip(found.column("w").to_pylist(), ends.tolist(), ends[1:].tolist()):
            self.new[words[short[w]]] = values[4 * lo : 4 * hi]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges by a heap of pairs, for one word."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

        def pair(i: int):
            j = after[i]
            return None if j >= len(parts) else self.ranks.get(parts[i] + parts[j])

        heap = [(r, i) for i in range(len(parts)) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if parts[i] is None or pair(i) != rank:
                continue
            j = after[i]
            parts[i], ids[i], parts[j] = parts[i] + parts[j], rank, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [ids[i] for i, p in enumerate(parts) if p is not None]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.split(t) for t in texts]
        seen, missing = self.new, set()
        for ws in words:
            missing.update(w for w in ws if w not in seen)
        for w in [w for w in missing if w in self.old]:
            self.new[w] = self.old[w]
            missing.discard(w)
        local = self.new
        if missing:
            self._learn(list(missing))
            if self.new is not local:  # a new generation began: what this round needs is in either
                both = self.old | self.new
                return [b"".join(map(both.__getitem__, ws)) for ws in words]
        return [b"".join(map(self.new.__getitem__, ws)) for ws in words]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence; a long one is taken in parts."""
        out: list[list[bytes]] = [[] for _ in ids]
        part: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal part, size
            if part:
                lengths = np.array([len(a) for _, a in part])
                position = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                self._load("tokens", pa.table({"t": np.repeat(np.arange(len(part)), lengths), "p": position, "id": np.concatenate([a for _, a in part]).astype(np.int64)}))
                found = self.db.sql(_EXPAND).to_arrow_table()
                by = dict(zip(found.column("t").to_pylist(), found.column("b").to_pylist()))
                for k, (i, _) in enumerate(part):
                    out[i].append(by[k])
            part, size = [], 0

        for i, blob in enumerate(ids):
            a = np.frombuffer(blob, "<u4")
            while len(a):
                take = a[: ROUND_TOKENS - size]
                part.append((i, take))
                size += len(take)
                a = a[len(take) :]
                if size == ROUND_TOKENS:
                    flush()
        flush()
        return [b"".join(parts) for parts in out]


def bpe(ranks_file: str, pattern: str) -> Bpe:
    """The worker's tables for a rank file."""
    cache = worker_cache("byte_bpe")
    if (ranks_file, pattern) not in cache:
        cache[ranks_file, pattern] = Bpe(ranks_file, pattern)
    return cache[ranks_file, pattern]


def _rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids of rows and their texts, up to ROUND_CHARS at a time."""
    keys, texts, size = [], [], 0
    for part in slices(batches, 64):
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            keys.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= ROUND_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _default(ranks_file: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, ids as little-endian unsigned 32-bit integers; a null text is empty."""
    names = _default(ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _rounds(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bpe(*names).encode(texts), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes) of ``encoded`` (doc_id, ids), the inverse of encode()."""
    names = _default(ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            found = bpe(*names).decode([b or b"" for b in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and its ids decoded again.

    A null text is empty: no tokens, and the hashes of no bytes. Words of any
    length are merged in full. Repeated rows come back each, null ids stay null,
    an empty table gives an empty result; other columns are not read.
    """
    names = _default(ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = bpe(*names)
        for keys, texts in _rounds(batches):
            ids = tables.encode(texts)
            back = tables.decode(ids)
            sha = lambda blobs: pa.array([hashlib.sha256(b).hexdigest() for b in blobs])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(b) // 4 for b in ids], pa.int64()), sha(ids), sha(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return round_trip(table(spark, sf_dir, "documents"))


QUERY = ("op5_byte_bpe", op5_byte_bpe)
ORACLE = None
