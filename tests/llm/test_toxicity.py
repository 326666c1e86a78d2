import zlib

import numpy as np
import pytest
from llm_helpers import frame, prose

from gridloom.llm import toxicity as op

BAD = ["zorp", "blarg", "fnord", "grumb"]


def text(i, toxic):
    words = prose(i, 80).split()
    if toxic:
        for k in range(6):
            words.insert((i * 13 + k * 11) % len(words), BAD[(i + k) % 4] if k % 3 else "You")
    return " ".join(words)


@pytest.fixture(scope="module")
def data(spark):
    marks = [(i, i % 5 == 0) for i in range(900)]
    docs = frame(spark, [(i, text(i, t)) for i, t in marks])
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in marks] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out(data):
    docs, labels = data
    model = op.fit(docs, labels)
    assert set(BAD) <= model.lexicon
    rows = op.score(docs, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = [(r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in held]
    assert len(held) > 150 and sum(right) / len(right) > 0.97


def test_copies_add_no_words(spark):
    copied = "some quite peculiar snorkelwort sentence that was copied"
    texts = [(i, copied if i % 2 else prose(i, 30)) for i in range(200)]
    rows = spark.createDataFrame([(t, int(i % 2)) for i, t in texts], "text string, toxic int")
    assert "snorkelwort" not in op.learn_lexicon(rows)


def test_messy_and_empty(spark, data, messy, nothing):
    docs, labels = data
    model = op.fit(docs, labels)
    assert op.score(messy, model).count() == messy.count() and op.score(nothing, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for few in (none, labels.filter("toxic = 1"), labels.filter("toxic = 0")):
        base = op.fit(docs, few)
        assert base.trees is None and {r["score"] for r in op.score(messy, base).collect()} == {base.base}
    out = op.keep_clean(docs.unionByName(messy.withColumn("doc_id", messy.doc_id + 10_000)), labels)
    assert out.schema == docs.schema
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out.collect()}
    assert sum(i % 5 == 0 for i in gone) > 0.97 * len(gone) and len(gone) > 170


def test_words():
    assert op.unmasked("z0rp!") == "zorp" and op.unmasked("b.l.a.r.g") == "blarg" and op.unmasked("fnoooord") == "fnord" and op.unmasked("$tup1d") == "stupid"
    assert op.is_masked("z0rp") and op.is_masked("b.l.a") and not op.is_masked("word,") and not op.is_masked("don't") and not op.is_masked("123")


def test_features():
    make = op.Featurizer(frozenset(BAD))
    x = dict(zip(make.NAMES, make("You are a ZORP and z0rp! Really?")))
    assert x["lexicon"] == pytest.approx(2 / 7) and x["lexicon_near_you"] == pytest.approx(1 / 7) and x["lexicon_masked"] > 0 and x["caps_words"] == pytest.approx(1 / 7) and x["you"] == pytest.approx(1 / 7)
    assert make(None) == make("") and np.isfinite(make(None)).all()


def test_trees_and_isotonic():
    r = np.random.default_rng(1)
    x = r.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = op.boost(x, y)
    assert ((trees.raw(x) > 0) == (y == 1)).mean() > 0.95
    xs, ps = op.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(ps) >= 0).all() and np.interp([1, 2], xs, ps).tolist() == [0.5, 0.5]


def test_equal_scores_are_calibrated_together():
    xs, ps = op.isotonic(np.array([0.0] * 10 + [1.0, 2.0]), np.array([0.0] * 9 + [1, 1, 1]))
    assert np.interp(0.0, xs, ps) == pytest.approx(0.1) and np.interp(2.0, xs, ps) == 1
