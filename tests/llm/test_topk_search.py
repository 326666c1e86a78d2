import math
import random

import numpy as np
import pytest
from llm_helpers import as_rows

from gridloom.llm import topk_search as op

SCHEMA = "vec_id long, embedding array<float>, label int, v string, uid string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 0, "v", "u") for i, e in rows], SCHEMA)


def brute(rows, k=10, every=100):
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (q, a) in enumerate(whole):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(whole) if m != n)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(op, "BLOCK_ROWS", 70)
    monkeypatch.setattr(op, "CHUNK_QUERIES", 2)
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(420)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6), (904, []), (905, [0.5])]
    assert sorted(as_rows(op.topk(table(spark, rows)))) == brute(rows)


def test_few_rows_and_repeats(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 2.0])]
    assert sorted(as_rows(op.topk(table(spark, rows)))) == brute(rows)
    assert op.topk(table(spark, [])).count() == 0 and op.topk(table(spark, [(5, [1.0])])).count() == 0 and op.topk(table(spark, [(100, None)])).count() == 0


def test_signed_digits():
    for n in range(-300, 300):
        digits = op.signed_digits(n)
        assert sum(s << k for k, s in digits) == n and all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:]))


def test_block_scores():
    r = np.random.default_rng(0)
    values = r.integers(-500, 700, (130, 5))
    block = op.Block(op.bit_slices(values, -500, 11), 130, -500)
    for _ in range(5):
        q = r.integers(-900, 900, 5)
        rows, scores = block.best(q, 130, -1)
        assert sorted(rows.tolist()) == list(range(130)) and (scores == values[rows] @ q).all()


def test_scores_near_64_bits(spark):
    most = 2929687.5  # 3e9 when quantised: the products are 9.0e18, the slices and the constant by themselves more
    rows = [(100, [most]), (1, [most]), (2, [-most]), (200, [-most]), (3, [most / 2]), (4, [0.0])]
    assert sorted(as_rows(op.topk(table(spark, rows)))) == brute(rows)


@pytest.mark.parametrize("vectors", [[[3.0e6], [3.0e6]], [[1.0e30], [1.0]]])
def test_beyond_64_bits(spark, vectors):
    rows = list(zip((100, 1), vectors))
    with pytest.raises(Exception, match="64 bits"):
        op.topk(table(spark, rows)).collect()
