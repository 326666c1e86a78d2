"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled rows: words that stand in many different
contexts in toxic texts and in few others, and the beginnings of words that do
so, which cover the compounds of languages that build them. Words are compared
after undoing common obfuscation (digits and signs for letters, marks between
letters, drawn-out letters). A text's features are densities of lexicon words, how near
they stand to a second person, capitals, punctuation and obfuscation rates.
Trees are boosted on the logistic loss over binned features; scores are
calibrated by isotonic regression of out-of-fold scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, shared_value, slices, table, worker_cache
from .language_id import held_out

#: Labelled rows that the model is fitted on, about; more are sampled by a hash of their id.
SAMPLE_ROWS = 12_000
#: Lexicon words, and what a word needs to be one: toxic texts, contexts in toxic texts, and log-odds of its share of texts.
LEXICON_WORDS, LEXICON_TEXTS, LEXICON_CONTEXTS, LEXICON_ODDS = 400, 3, 4, 2.5
#: The same for beginnings of words, which are never as telling.
STEM_LETTERS, STEMS, STEM_ODDS = 5, 200, 1.5
CACHE_WORDS = 300_000
LIMIT = 0.3
#: Rows that a step of the calibration stands on; fewer if there are few labels.
CALIBRATION_ROWS = 8
TREES, DEPTH, RATE, BINS, FOLDS, LEAST_LEAF = 80, 3, 0.15, 32, 5, 15.0

SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo vosotros usted ustedes".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
_LETTERS = re.compile(r"[^\W\d_]+")
_DRAWN = re.compile(r"(.)\1{2,}")
_LEX, _YOU, _CAPS, _MASKED, _WORD, _STEM = 1, 2, 4, 8, 16, 32


def plain_word(token: str) -> str:
    """The token's letters, lower-cased."""
    return "".join(_LETTERS.findall(token.lower()))


def unmasked(token: str) -> str:
    """The token with obfuscation undone: look-alike signs read as letters, marks between letters and drawn-out letters dropped."""
    core = token.lower().strip(".,;:?\"'()[]{}<>|*#%&").rstrip("!?.,;:")
    return _DRAWN.sub(r"\1", "".join(_LETTERS.findall(core.translate(_LEET))))


def is_masked(token: str) -> bool:
    """Whether signs or digits stand between the letters of the token, or a letter is drawn out."""
    inner = token.strip(".,;:?!\"'()[]{}<>|*#%&$-")
    return any(c.isalpha() for c in inner) and (not inner.replace("'", "").replace("-", "").isalpha() or _DRAWN.search(inner.lower()) is not None)


class Featurizer:
    """Dense features of whole texts, with a worker's cache of what each token is."""

    NAMES = ("lexicon", "lexicon_log", "lexicon_kinds", "lexicon_near_you", "lexicon_densest", "lexicon_masked", "you", "caps_letters", "caps_words", "exclaim", "question", "punct", "masked", "digits", "words_log", "stems", "stems_log")

    def __init__(self, lexicon: frozenset[str]):
        """``lexicon`` holds words, and stems with the mark ``~`` in front."""
        self.lexicon = lexicon
        cache = worker_cache("toxicity")
        if cache.get("lexicon") != lexicon:
            cache.clear()
            cache["lexicon"], cache["codes"] = lexicon, {}
        self.codes: dict[str, int] = cache["codes"]

    def code(self, token: str) -> int:
        plain, masked = plain_word(token), is_masked(token)
        c = _WORD * bool(plain) | _YOU * (plain in SECOND_PERSON) | _CAPS * (len(plain) > 1 and token.upper() == token) | _MASKED * masked
        c |= _STEM * ("~" + plain[:STEM_LETTERS] in self.lexicon)
        return c | _LEX * (plain in self.lexicon or masked and unmasked(token) in self.lexicon)

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.split()
        codes = self.codes
        if len(codes) > CACHE_WORDS:
            codes.clear()
        for t in tokens:
            if t not in codes:
                codes[t] = self.code(t)
        c = np.fromiter(map(codes.__getitem__, tokens), np.uint8, len(tokens))
        n = max(1, int(np.count_nonzero(c & _WORD)))
        hits = np.flatnonzero(c & _LEX)
        you = np.flatnonzero(c & _YOU)
        near = densest = 0
        if len(hits):
            if len(you):
                at = np.clip(np.searchsorted(you, hits), 1, len(you)) - 1
                after = np.minimum(at + 1, len(you) - 1)
                near = int((np.minimum(np.abs(you[at] - hits), np.abs(you[after] - hits)) <= 3).sum())
            densest = int((np.searchsorted(hits, hits + 50) - np.arange(len(hits))).max())
        kinds = len({plain_word(tokens[i]) for i in hits}) if len(hits) else 0
        stems = int(np.count_nonzero(c & _STEM))
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
        size = max(1, int(raw.sum()))
        punct = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
        return [
            len(hits) / n,
            float(np.log1p(len(hits))),
            float(kinds),
            near / n,
            float(densest),
            float(np.count_nonzero((c & _LEX > 0) & (c & _MASKED > 0))) / n,
            len(you) / n,
            upper / max(1, upper + lower),
            float(np.count_nonzero(c & _CAPS)) / n,
            int(raw[33]) / size,
            int(raw[63]) / size,
            punct / size,
            float(np.count_nonzero(c & _MASKED)) / n,
            int(raw[48:58].sum()) / size,
            float(np.log1p(n)),
            stems / n,
            float(np.log1p(stems)),
        ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of fixed depth: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting on the logistic loss, with Newton leaves over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    score, inner = np.full(len(y), start), 2**DEPTH - 1
    features, thresholds, values = [], [], []
    offset = np.arange(x.shape[1]) * BINS
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(y), int)
        f, t = np.zeros(inner, int), np.full(inner, np.inf)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            if len(rows):
                flat = (binned[rows] + offset).ravel()
                gs, hs, ns = (np.bincount(flat, np.repeat(w, x.shape[1]), x.shape[1] * BINS).reshape(-1, BINS).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows))))
                G, H, N = g[rows].sum(), h[rows].sum(), len(rows)
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                gain[(ns < LEAST_LEAF) | (N - ns < LEAST_LEAF)] = -np.inf
                for j, e in enumerate(edges):
                    gain[j, len(e) :] = -np.inf
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] > 1e-6:
                    f[k], t[k] = j, edges[j][b]
            node = np.where(node == k, 2 * k + 1 + (x[:, f[k]] > t[k]), node)
        leaf = node - inner
        G, H = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        v = RATE * G / (H + 1)
        score += v[leaf]
        features.append(f), thresholds.append(t), values.append(v)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def isotonic(score: np.ndarray, y: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing fit, by pooling adjacent violators.

    Neighbours are pooled first until ``least`` rows stand together, so that a few odd labels make no step.
    """
    values, which = np.unique(score, return_inverse=True)  # equal scores are one point
    sums, counts = np.bincount(which, y), np.bincount(which)
    blocks: list[list[float]] = []
    open_: list[float] | None = None
    left = len(score)
    for s, v, n in zip(values, sums, counts):
        open_ = [float(v), float(n), float(s), float(s)] if open_ is None else [open_[0] + v, open_[1] + n, open_[2], float(s)]
        left -= n
        if open_[1] < least or 0 < left < least:
            continue
        blocks.append(open_)
        open_ = None
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    ps = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return xs, ps


@dataclass(frozen=True)
class Model:
    """Lexicon, trees and calibration; without trees every score is ``base``."""

    lexicon: frozenset[str]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.base)
        features = Featurizer(self.lexicon)
        return self.calibrated(np.array([features(t) for t in texts]))

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        """Isotonic probability, with a trace of the trees' own, so that scores within a step keep their order."""
        raw = self.trees.raw(x)
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 / (1 + np.exp(-raw)), 0, 1)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, before, toxic, first): each text's words with a hash of the word before; ``first`` once for each word of a text."""
    import zlib

    for part in slices(batches, 64):
        words, before, toxic, first = [], [], [], []
        for text, mark in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            tokens = [plain_word(t) for t in (text or "").split()]
            pairs = {(w, zlib.crc32(b.encode("utf-8", "surrogatepass"))) for b, w in zip(["", *tokens], tokens) if 1 < len(w) <= 40}
            pairs |= {("~" + w[:STEM_LETTERS], b) for w, b in pairs if len(w) > STEM_LETTERS}
            met: set[str] = set()
            for w, b in pairs:
                words.append(w)
                before.append(b)
                first.append(int(w not in met))
                met.add(w)
            toxic += [mark] * len(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.int64()), pa.array(toxic, pa.int32()), pa.array(first, pa.int32())], names=["word", "before", "toxic", "first"])


def learn_lexicon(rows: DataFrame) -> frozenset[str]:
    """Words whose texts are mostly toxic ones and that stand in several contexts there.

    Copies of a text add no contexts, so they alone add no words; words that are
    common everywhere have no odds, however long a toxic text is.
    """
    pairs = rows.mapInArrow(_contexts, "word string, before long, toxic int, first int")
    mine, other = F.col("toxic"), 1 - F.col("toxic")
    once = pairs.groupBy("word", "before").agg(F.max(mine).alias("context"), F.sum(F.col("first") * mine).alias("t"), F.sum(F.col("first") * other).alias("c"))
    words = once.groupBy("word").agg(F.sum("context").alias("contexts"), F.sum("t").cast("double").alias("t"), F.sum("c").cast("double").alias("c"))
    total = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic, clean = float(total[0] or 0), float(total[1] or 0)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    known = words.filter((F.col("t") >= LEXICON_TEXTS) & (F.col("contexts") >= LEXICON_CONTEXTS)).withColumns({"odds": odds, "stem": F.col("word").startswith("~")})
    best = lambda of, least, most: of.filter(F.col("odds") >= least).orderBy((F.col("odds") * F.sqrt("t")).desc(), "word").limit(most)
    found = best(known.filter(~F.col("stem")), LEXICON_ODDS, LEXICON_WORDS).unionAll(best(known.filter("stem"), STEM_ODDS, STEMS))
    return frozenset(r["word"] for r in found.select("word").collect())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), none of them held out.

    Of rows that share a labelled id the least text counts, once. Words of more
    than 40 letters are no lexicon words, so a text without spaces has none.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    top = 1 << 30
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(top)) < int(min(1.0, sample_rows / max(1, n)) * top)).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = cut(rows.select("doc_id", "text", "toxic"))  # about SAMPLE_ROWS rows, however often an id repeats, taken out of all documents once
    base = rows.agg(F.avg("toxic"), F.count(F.lit(1)), F.sum("toxic")).first()
    if not base[1] or base[2] in (0, base[1]):
        return Model(frozenset(), None, None, float(base[0] or 0.0))
    lexicon = learn_lexicon(rows.select("text", "toxic"))
    width = len(Featurizer.NAMES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(lexicon)
        for part in slices(batches, 64):
            x = [make(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(features, "doc_id long, toxic int, x array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in found]).reshape(-1, width)
    y = np.array([r["toxic"] for r in found], float)
    fold = np.array([hash(tuple(np.round(v, 2))) % FOLDS for v in x])  # copies of a text share a fold
    out = np.empty(len(y))
    for k in range(FOLDS):
        inside = fold != k
        if inside.all() or not inside.any():
            inside = np.ones(len(y), bool)
        out[fold == k] = boost(x[inside], y[inside]).raw(x[fold == k]) if (fold == k).any() else 0
    return Model(lexicon, boost(x, y), isotonic(out, y, max(1, min(CALIBRATION_ROWS, len(y) // 1000))), float(y.mean()))


def _scorer(spark: SparkSession, model: Model):
    """A mapInArrow function that replaces the column ``_gl_text`` by ``_gl_score``."""
    shared = shared_value(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for part in slices(batches):
            at = part.schema.names.index("_gl_text")
            rest = [i for i in range(part.num_columns) if i != at]
            scores = known.scores(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(scores, pa.float64())], names=[*(part.schema.names[i] for i in rest), "_gl_score"])

    return run


def score(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts get the score of a text without words. Without labelled
    rows of both kinds every score is the share of toxic ones, 0 if there are
    none. A null id counts as empty text for held_out; repeated rows come back
    each and an empty table gives an empty result. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("text").alias("_gl_text"))
    found = rows.mapInArrow(_scorer(docs.sparkSession, model), "doc_id long, held_out boolean, _gl_score double").withColumnRenamed("_gl_score", "score")
    return found.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more, all columns as they were."""
    model = fit(docs, labels)
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = StructType([*numbered.schema.fields, StructField("_gl_score", DoubleType())])
    found = numbered.withColumn("_gl_text", F.col(f"c{names.index('text')}")).mapInArrow(_scorer(docs.sparkSession, model), schema)
    return found.filter(F.col("_gl_score") < limit).drop("_gl_score").toDF(*names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERY = ("op8_toxicity", op8_toxicity)
ORACLE = None
