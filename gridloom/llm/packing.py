"""Packing of tokenised documents into windows by non-negative least squares.

A document of a window or more fills whole windows; what remains is one piece.
The lengths of these pieces are rounded up to size classes (at most 256, each
within 1/32 of its size), whose histogram goes to the driver. There, shallow
combinations of sizes that fill a window are enumerated, non-negative least
squares finds how often each should be used to meet the histogram, and the
counts are rounded. Every piece then has a rank within its class, and the plan
tells by rank in which sequence it lies. Pieces that the plan leaves over are
packed greedily one after the other and cut where a window ends; the last,
partial window is cut at powers of two, so it needs no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, table, worker_cache

WINDOW = 4096
END_ID = 2
#: Lengths up to 2^FINE have a class of their own; each octave above has 2^(FINE - 1) classes.
FINE = 6
#: A combination may leave this share of a window empty.
WASTE = 1 / 128
#: Entries in each of the two generations of a worker's caches.
CACHE_WORDS = 200_000
#: Pieces that are ranked together.
SHARD_ROWS = 20_000
#: Cut pieces that may be broadcast; with more, pieces and documents meet in a shuffle.
BROADCAST_ROWS = 50_000


def encoder(tokenizer: str):
    """A function from text to ids (little-endian unsigned 16 bit), cached for the worker.

    The vocabulary's pre-tokenizer never joins what white space parts, so a text
    is encoded word by word and the results are cached. Whatever could make
    this differ from the whole text's encoding goes to the tokenizer as a whole.
    """
    cache = worker_cache(f"packing:{tokenizer}")
    if "encode" in cache:
        return cache["encode"]
    import re
    import unicodedata
    from array import array

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    tokenize = whole.model.tokenize
    if whole.get_vocab_size() > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    # separators and spaces beyond ASCII, letters whose lower case depends on their place, special tokens
    odd = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u03a3\\u0130]|<\\|")
    # chunks of visible ASCII and Latin letters are split here as the vocabulary's pre-tokenizer does; others go to it
    latin = "a-z\\xe0-\\xf6\\xf8-\\xff\\u0101-\\u017e"
    plain = re.compile(f"[!-~{latin}]+")
    strange = re.compile(f"[^ -~\\t\\n\\v\\f\\r\\xc0-\\xd6\\xd8-\\xde{latin}]")
    parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{latin}]+|[0-9]|[^\s{latin}0-9]+")
    hidden = [*range(33), *range(127, 161), 173]
    visible = {b: 256 + i for i, b in enumerate(hidden)}  # how byte-level vocabularies write bytes that are no visible Latin-1 sign

    def ids_of(text: str) -> bytes:
        return array("H", whole.encode(text, add_special_tokens=False).ids).tobytes()

    class Cache(dict):
        """Two generations, so that common entries outlive the turn-over."""

        def __init__(self, make):
            self.make, self.old = make, {}

        def __missing__(self, key: str) -> bytes:
            found = self.old.get(key) or self.make(key)
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = found
            return found

    def word_ids(word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(visible)
        return array("H", [t.id for t in tokenize(spelled)]).tobytes()

    words = Cache(word_ids)
    def chunk_ids(chunk: str) -> bytes:
        return b"".join(map(words.__getitem__, parts.findall(chunk)))

    chunks = Cache(chunk_ids)
    mixed_chunks = Cache(lambda chunk: chunk_ids(chunk) if plain.fullmatch(chunk) else ids_of(chunk))

    def encode(text: str) -> bytes:
        if not strange.search(text) and "<|" not in text:
            return b"".join(map(chunks.__getitem__, text.lower().split()))
        if odd.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return ids_of(text)
        return b"".join(map(mixed_chunks.__getitem__, text.lower().split()))

    cache["encode"] = encode
    return encode


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenise(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([END_ID], "<u2").tobytes()
        for part in slices(batches):
            blobs = [encode(t or "") + end for t in part.column(1).to_pylist()]
            sums = []
            for b in blobs:
                ids = np.frombuffer(b, "<u2")
                sums.append([crc(ids[at : at + WINDOW]) for at in range(0, len(ids), WINDOW)])
            counts = pa.array([len(b) // 2 for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(sums, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], names=["doc_id", "n", "crcs", "ids"])

    return run


def tokenise(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, n, crcs, ids) of every row; rid tells rows apart, crcs has one sum for each window of ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(_tokenise(tokenizer), "doc_id long, n long, crcs array<long>, ids binary").withColumn("rid", F.monotonically_increasing_id()))


def size_class(length: int) -> int:
    """The length rounded up to its class."""
    step = max(0, (length - 1).bit_length() - FINE)
    return -(-length >> step) << step


def size_column(length: Column) -> Column:
    """size_class as a column of longs."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(length - 1)) - FINE))
    return (F.ceil(length / unit) * unit).cast("long")


def combinations(sizes: np.ndarray, window: int = WINDOW) -> list[dict[int, int]]:
    """Shallow combinations, as size to count, that fill a window up to WASTE: up to three sizes, or one repeated and another."""
    sizes = np.sort(sizes)
    least = window - int(window * WASTE)
    found: dict[tuple, dict[int, int]] = {}

    def add(items: list[tuple[int, int]]) -> None:
        combo: dict[int, int] = {}
        for size, k in items:
            combo[size] = combo.get(size, 0) + k
        found[tuple(sorted(combo.items()))] = combo

    def below(room: int) -> int:
        at = int(np.searchsorted(sizes, room, side="right")) - 1
        return int(sizes[at]) if at >= 0 else 0

    for a in map(int, sizes[::-1]):
        for k in range(1, window // a + 1):
            b = below(window - k * a)
            if k * a >= least:
                add([(a, k)])
            if b and k * a + b >= least:
                add([(a, k), (b, 1)])
        for b in map(int, sizes[sizes <= min(a, window - a)]):
            c = below(window - a - b)
            if c and a + b + c >= least and c <= b:
                add([(a, 1), (b, 1), (c, 1)])
    return list(found.values())


def nnls(columns: list[dict[int, float]], rows: int, target: np.ndarray) -> np.ndarray:
    """argmin |A x - target| over x >= 0 by the active-set method; A is given by its sparse columns."""
    which = np.concatenate([np.full(len(c), j) for j, c in enumerate(columns)])
    row = np.concatenate([np.fromiter(c.keys(), int, len(c)) for c in columns])
    value = np.concatenate([np.fromiter(c.values(), float, len(c)) for c in columns])
    norm = np.sqrt(np.bincount(which, value**2, len(columns)))
    x = np.zeros(len(columns))
    passive: list[int] = []
    banned: set[int] = set()
    for _ in range(3 * rows):
        residual = target - np.bincount(row, value * x[which], rows)
        slope = np.bincount(which, value * residual[row], len(columns)) / norm
        slope[passive + list(banned)] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-7 * (1 + np.linalg.norm(target)):
            break
        passive.append(j)
        while True:
            dense = np.zeros((rows, len(passive)))
            for at, p in enumerate(passive):
                for r, v in columns[p].items():
                    dense[r, at] = v
            z = np.linalg.lstsq(dense, target, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[passive] = z
                banned.clear()
                break
            old = x[passive]
            low = z <= 0
            if low[-1] and old[-1] == 0:
                banned.add(passive.pop())
                break
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            x[passive] = old + step * (z - old)
            for p in [p for p in passive if x[p] <= 1e-9]:
                x[p] = 0
                passive.remove(p)
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(combination, repeats) that use at most the pieces of the histogram (size to count)."""
    sizes = np.array(sorted(histogram))
    combos = combinations(sizes, window) if len(sizes) else []
    if not combos:
        return []
    at = {int(s): i for i, s in enumerate(sizes)}
    x = nnls([{at[s]: float(k) for s, k in c.items()} for c in combos], len(sizes), np.array([histogram[int(s)] for s in sizes], float))
    left, out = dict(histogram), []
    for j in np.argsort(-x, kind="stable"):
        repeats = min(int(round(x[j])), *(left[s] // k for s, k in combos[j].items())) if x[j] > 0 else 0
        if repeats > 0:
            out.append((combos[j], repeats))
            for s, k in combos[j].items():
                left[s] -= repeats * k
    return out


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with their rank within size, counted within hash shards first so that a common size is spread."""
    shards = max(16, -(-rows // SHARD_ROWS))
    cells = pieces.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))
    before = Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = cells.groupBy("size", "shard").agg(F.count(F.lit(1)).alias("n_cell"))
    start = counts.select("size", "shard", F.coalesce(F.sum("n_cell").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("size", "shard").orderBy("rid")
    return cells.withColumn("own", F.row_number().over(own) - 1).join(start, ["size", "shard"]).withColumn("rank", F.col("first") + F.col("own")).drop("own", "first", "shard")


def _running(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with ``at``, the tokens of all pieces before."""
    shards = max(16, -(-rows // SHARD_ROWS))
    cells = pieces.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))
    sums = cells.groupBy("shard").agg(F.sum("length").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    start = sums.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("own", F.coalesce(F.sum("length").over(own), F.lit(0))).join(start, "shard").withColumn("at", F.col("first") + F.col("own")).drop("own", "first", "shard")


def _piece_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        named = dict(zip(part.schema.names, part.columns))
        sums = [crc(np.frombuffer(b, "<u2")[s : s + n]) for b, s, n in zip(named["ids"].to_pylist(), named["start"].to_pylist(), named["length"].to_pylist())]
        named["ids_crc32"] = pa.array(sums, pa.int64())
        yield pa.RecordBatch.from_arrays([named[c] for c in _PIECE.names], names=_PIECE.names)


_PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_PIECE_DDL = ", ".join(f"{c} long" for c in _PIECE.names)


def pack(tokens: DataFrame) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``tokens`` as tokenise() returns them."""
    spark = tokens.sparkSession
    pieces = tokens.select("rid", "doc_id", F.col("n").alias("doc_tokens"), F.posexplode("crcs").alias("w", "ids_crc32"))
    pieces = pieces.withColumn("start", F.col("w").cast("long") * WINDOW).withColumn("length", F.least(F.lit(WINDOW).cast("long"), F.col("doc_tokens") - F.col("start"))).drop("w")
    whole = pieces.filter(F.col("length") == WINDOW).withColumns({"sequence_id": F.lit(1 << 62).bitwiseOR(F.monotonically_increasing_id()), "offset": F.lit(0).cast("long")})
    rest = pieces.filter(F.col("length") < WINDOW).withColumn("size", size_column(F.col("length")))
    histogram = {int(r["size"]): int(r["n"]) for r in rest.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(histogram.values())

    chosen, base, used, lines = plan(histogram), 0, dict.fromkeys(histogram, 0), []
    for combo, repeats in chosen:
        slot = 0
        for size, k in sorted(combo.items(), reverse=True):
            lines.append((size, used[size], used[size] + repeats * k, base, k, slot))
            used[size] += repeats * k
            slot += k
        base += repeats
    ddl = "psize long, lo long, hi long, base long, k long, slot long"
    lookup = F.broadcast(spark.createDataFrame(lines, ddl))  # three rows at most for each of at most 256 combinations
    placed = cut(_ranked(rest, rows).join(lookup, (F.col("size") == F.col("psize")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left"))

    step = F.col("rank") - F.col("lo")
    fits = placed.filter("base is not null").withColumns({"sequence_id": (F.col("base") + F.floor(step / F.col("k"))).cast("long"), "order": F.col("slot") + step % F.col("k")})
    order = Window.partitionBy("sequence_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    fits = fits.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))

    over = placed.filter("base is null").select("rid", "doc_id", "doc_tokens", "start", "length", "ids_crc32")
    n_over, n_tokens = over.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    greedy = _greedy(tokens, over, n_over, n_tokens, base)
    same = [F.col(c) for c in _PIECE.names]
    return whole.select(*same).unionAll(fits.select(*same)).unionAll(greedy)


def _greedy(tokens: DataFrame, over: DataFrame, rows: int, n_tokens: int, base: int) -> DataFrame:
    """The left-over pieces one after the other, cut where a window ends and at powers of two in the last one."""
    windows, tail = divmod(int(n_tokens), WINDOW)
    ends = [windows * WINDOW]
    for bit in reversed(range(WINDOW.bit_length() - 1)):
        if tail >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    tails = F.array(*[F.struct(F.lit(base + windows + i).cast("long").alias("sequence_id"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for i, (lo, hi) in enumerate(zip(ends, ends[1:]))])
    tails = tails if len(ends) > 1 else tails.cast("array<struct<sequence_id:bigint,lo:bigint,hi:bigint>>")
    run = _running(over, rows).withColumn("end", F.col("at") + F.col("length"))
    first, last = F.floor(F.col("at") / WINDOW), F.floor((F.col("end") - 1) / WINDOW)
    spans = F.transform(F.sequence(first, last), lambda i: F.struct((F.lit(base) + i).cast("long").alias("sequence_id"), (i * WINDOW).cast("long").alias("lo"), ((i + 1) * WINDOW).cast("long").alias("hi")))
    spans = F.concat(F.filter(spans, lambda s: s["lo"] < ends[0]), F.filter(tails, lambda s: (s["lo"] < F.col("end")) & (s["hi"] > F.col("at"))))
    cuts = run.withColumn("s", F.explode(spans))
    lo, hi = F.greatest("at", F.col("s.lo")), F.least("end", F.col("s.hi"))
    cuts = cuts.select("rid", "doc_id", "doc_tokens", F.col("ids_crc32").alias("known"), F.col("length").alias("whole"), (F.col("start") + lo - F.col("at")).alias("start"), (hi - lo).alias("length"), F.col("s.sequence_id").alias("sequence_id"), (lo - F.col("s.lo")).alias("offset"))
    cuts = cut(cuts)
    uncut = cuts.filter("length = whole").withColumn("ids_crc32", F.col("known")).select(*_PIECE.names)
    again = cut(cuts.filter("length < whole").drop("known", "whole"))
    # the ids of few documents are looked for without moving those of all
    few = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    again = tokens.select(F.col("rid").alias("rid_"), "ids").join(few, F.col("rid_") == F.col("rid")).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    return uncut.unionAll(again.mapInArrow(_piece_sums, _PIECE_DDL))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every row's whole text into sequences of at most WINDOW tokens.

    One row per piece: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset). A null text is empty and has its end id alone;
    repeated rows are packed each; null ids stay null; an empty table gives an
    empty result. Other columns are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(tokenise(docs, tokenizer, id_col, text_col))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERY = ("op1_packing", op1_packing)
ORACLE = None
