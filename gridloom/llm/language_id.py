"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; for each bit one binary classifier
over hashed byte n-grams tells the languages whose codeword has +1 from the
others. A text's bits are decoded by loss: the language whose codeword has the
least logistic loss, bits weighted by how well they separate the training
texts, is chosen; if the next one is almost as near, the text is ambiguous.
A text is in none of the languages, and rejected, if it is far from every
codeword or ambiguous as a whole and its pieces are far from every codeword, too:
a text that mixes learned languages is near to one piece by piece.

The classifiers are naive Bayes log-odds, so they need only n-gram frequencies
by language, which executors gather from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import shared_value, slices, table, worker_cache

#: Labelled rows of each language that the classifiers are fitted on, about; more rows are sampled by a hash of their id.
SAMPLE_ROWS = 2000
#: Partitions of the sampled rows, each of which makes a table of counts for each language.
FIT_PARTS = 32
ORDERS, BUCKET_BITS = (1, 2, 3, 4), 16
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
SMOOTHING, LOSS_SCALE, SHARPNESS = 0.01, 3.0, 12.0
#: A text whose second language is within this share of the loss is ambiguous.
AMBIGUOUS = 0.02
#: A mean loss beyond which no codeword fits: half of what bits that say nothing have (log 2).
REJECT_LOSS = 0.5 * math.log(2)
#: Letters that a text must have to be rejected for its loss or ambiguity; with fewer there is too little to go by.
EVIDENCE_LETTERS = 16
#: Signs of the pieces of a text that is looked at again.
PIECE = 256
UND = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts == part


def buckets(raw: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams of folded bytes, by order; the first n - 1 places of an order have none."""
    b, window, out = raw.astype(np.uint32), np.zeros(len(raw), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        if len(raw) < n:
            break
        window = (window[: len(raw) - n + 1] << np.uint32(8)) | b[n - 1 :]
        if n in ORDERS:
            out.append(((window * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64))
    return out


def folded(text: str) -> np.ndarray:
    """The text's bytes, ASCII letters lower-cased and other ASCII as spaces."""
    return _FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]


def has_letter(text: str | None) -> bool:
    import regex

    return bool(text) and regex.search(r"\p{L}", text) is not None


def has_evidence(text: str) -> bool:
    """Whether a text has EVIDENCE_LETTERS letters."""
    import regex

    return sum(1 for _ in islice(regex.finditer(r"\p{L}", text), EVIDENCE_LETTERS)) == EVIDENCE_LETTERS


def codebook(n: int) -> np.ndarray:
    """Codewords of n classes as rows of +1 and -1: all splits up to six classes, else the best of random ones."""
    if n <= 6:
        splits = [[1] + [1 if s >> i & 1 else -1 for i in range(n - 1)] for s in range(2 ** (n - 1) - 1)] if n > 1 else [[1]]
        return np.array(splits).T
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    best, distance = None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1, 1], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = int((code.shape[1] - (code @ code.T)[~np.eye(n, dtype=bool)].max()) // 2)
        if apart > distance:
            best, distance = code, apart
    return best


@dataclass(frozen=True)
class Model:
    """Codewords, n-gram weights and bit weights of the learned languages."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray

    def bits(self, text: str) -> np.ndarray:
        """The classifiers' margins: mean log-odds of the whole text's n-grams."""
        raw = folded(text)
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in range(0, len(raw), BLOCK):
            for h in buckets(raw[max(0, at - max(ORDERS) + 1) : at + BLOCK]):
                total += np.bincount(h, minlength=len(self.weights)) @ self.weights if len(h) > len(self.weights) else self.weights[h].sum(axis=0, dtype=np.float64)
                n += len(h)
        return total / max(1, n)

    def decode(self, bits: np.ndarray) -> tuple[str, float, bool, float]:
        """(language, confidence, ambiguous, loss) of the margins of a text."""
        loss = (np.logaddexp(0, -LOSS_SCALE * self.code * bits) * self.bit_weights).sum(axis=1) / self.bit_weights.sum()
        order = np.argsort(loss, kind="stable")
        p = np.exp(-SHARPNESS * (loss - loss[order[0]]))
        near = len(order) > 1 and loss[order[1]] - loss[order[0]] < AMBIGUOUS * max(loss[order[1]], 1e-12)
        return self.languages[order[0]], float(p[order[0]] / p.sum()), bool(near), float(loss[order[0]])

    def predict(self, text: str | None) -> tuple[str, float, bool, bool]:
        """(language, confidence, ambiguous, rejected) of a text."""
        if not has_letter(text):
            return UND, 0.0, False, True
        if not self.languages:
            return UND, 0.0, False, False
        lang, score, near, loss = self.decode(self.bits(text))
        return lang, score, near, (near or loss > REJECT_LOSS) and has_evidence(text) and self.is_strange(text)

    def is_strange(self, text: str) -> bool:
        """Whether the pieces of a text are far from all codewords, on average."""
        pieces = [text[at : at + PIECE] for at in range(0, len(text), PIECE)]
        return sum(len(p) * self.decode(self.bits(p))[3] for p in pieces) > REJECT_LOSS * len(text)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, sums): n-gram frequencies of this partition's texts, each text with weight 1."""
    found: dict[str, list] = {}
    for part in slices(batches):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            raw = folded(text or "")
            counts = np.zeros(1 << BUCKET_BITS)
            for at in range(0, len(raw), BLOCK):
                for h in buckets(raw[max(0, at - max(ORDERS) + 1) : at + BLOCK]):
                    counts += np.bincount(h, minlength=1 << BUCKET_BITS)
            if counts.any():
                known = found.setdefault(lang, [0, np.zeros(1 << BUCKET_BITS)])
                known[0] += 1
                known[1] += counts / counts.sum()
    for lang, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.int64()), pa.array([sums.astype("<f8").tobytes()])], names=["lang", "n", "sums"])


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(b, "<f8") for b in rows.column("sums").to_pylist())
    return pa.table({"lang": pa.array([key[0].as_py()]), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "sums": pa.array([sums.tobytes()], pa.binary())})


def fit(training: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows (id, lang, text) of known language: about ``sample_rows`` of each language, chosen by a hash of the id."""
    counts = {r["lang"]: r["n"] for r in training.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model((), np.empty((0, 0)), np.empty((0, 0)), np.empty(0))
    spark, top = training.sparkSession, 1 << 30
    bounds = spark.createDataFrame([(k, int(min(1.0, sample_rows / n) * top)) for k, n in counts.items()], "lang string, bound long")
    chosen = training.join(F.broadcast(bounds), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(top)) < F.col("bound")).select("lang", "text")
    chosen = chosen.repartition(FIT_PARTS)  # few partitions, so few tables of counts meet in a language's group
    rows = chosen.mapInArrow(_frequencies, "lang string, n long, sums binary").groupBy("lang").applyInArrow(_summed, "lang string, n long, sums binary").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    if not rows:
        return Model((), np.empty((0, 0)), np.empty((0, 0)), np.empty(0))
    freq = np.stack([np.frombuffer(r["sums"], "<f8") / r["n"] for r in rows])
    code = codebook(len(rows))
    uniform = SMOOTHING / freq.shape[1]
    weights = np.empty((freq.shape[1], code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        plus, minus = (freq[code[:, b] == s].mean(axis=0) if (code[:, b] == s).any() else 0 for s in (1, -1))
        weights[:, b] = np.log(plus + uniform) - np.log(minus + uniform)
    margins = freq @ weights * code
    return Model(tuple(r["lang"] for r in rows), code, weights, np.maximum(margins.min(axis=0), 1e-3))


def predict_columns(spark: SparkSession, model: Model):
    """A mapInArrow function that replaces the column ``_gl_text`` of batches by lang_pred, score, ambiguous and rejected."""
    shared = shared_value(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language_id")  # lets go of what another operator has cached
        known = shared()
        for part in slices(batches):
            at = part.schema.names.index("_gl_text")
            found = [known.predict(t) for t in part.column(at).to_pylist()]
            lang, score, near, rejected = zip(*found) if found else ((), (), (), ())
            rest = [i for i in range(part.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in rest), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_()), pa.array(rejected, pa.bool_())],
                names=[*(part.schema.names[i] for i in rest), "_gl_lang", "_gl_score", "_gl_ambiguous", "_gl_rejected"],
            )

    return run


def training_rows(docs: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """(id, lang, text) of the rows that may be learned from."""
    rows = docs.filter(~held_out(F.col("doc_id"), parts, part) & F.col("lang").isNotNull())
    return rows.select(F.col("doc_id").alias("id"), "lang", "text")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous, rejected) of every row.

    A null text and one without a letter is ``und`` with score 0 and rejected;
    ``und``, but not rejected, is every text with a letter if there was nothing
    to learn from. Other texts have the nearest language, and are rejected if
    they are ambiguous or no codeword is near (REJECT_LOSS), as a whole and by
    pieces, given at least EVIDENCE_LETTERS letters. A null id counts as empty
    text for held_out. Repeated rows come back each and an empty table gives an
    empty result; only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("text").alias("_gl_text"))
    found = rows.mapInArrow(predict_columns(docs.sparkSession, model), "doc_id long, held_out boolean, _gl_lang string, _gl_score double, _gl_ambiguous boolean, _gl_rejected boolean")
    return found.withColumnsRenamed({"_gl_lang": "lang_pred", "_gl_score": "score", "_gl_ambiguous": "ambiguous", "_gl_rejected": "rejected"})


def keep_identified(docs: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """``docs`` without the rows that the classifier rejects. Columns stay as they were.

    A row goes if its text is null or has no letter, or if it has at least
    EVIDENCE_LETTERS letters and is far from all codewords, as a text in a
    language that was not learned, or in none, is. With ``languages``
    rows predicted as another one go too. Where no row has a language to learn
    from, texts with a letter stay.
    """
    model = fit(training_rows(docs))
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = StructType(
        [*numbered.schema.fields, StructField("_gl_lang", StringType()), StructField("_gl_score", DoubleType()), StructField("_gl_ambiguous", BooleanType()), StructField("_gl_rejected", BooleanType())]
    )
    found = numbered.withColumn("_gl_text", F.col(f"c{names.index('text')}")).mapInArrow(predict_columns(docs.sparkSession, model), schema)
    kept = ~F.col("_gl_rejected")
    if languages is not None and model.languages:
        kept &= F.col("_gl_lang").isin(*languages)
    return found.filter(kept).drop("_gl_lang", "_gl_score", "_gl_ambiguous", "_gl_rejected").toDF(*names)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(training_rows(docs)))


QUERY = ("op4_language_id", op4_language_id)
ORACLE = None
