import random

import numpy as np
import pytest
from llm_helpers import as_rows, brute_components, brute_fingerprint

from gridloom.llm import simhash_dedup as op
from gridloom.llm.components import components


def flip(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def fingerprints(seed, n):
    """Random fingerprints and neighbours 0 to 5 bits away."""
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n)]
    near = [flip(r.choice(base), r.sample(range(64), r.randint(0, 5))) for _ in range(n)]
    hub = r.getrandbits(64)
    ball = [flip(hub, r.sample(range(64), r.randint(1, 3))) for _ in range(n)]
    return sorted(set(base + near + ball))


def groups(labels):
    seen = {}
    return [seen.setdefault(x, len(seen)) for x in labels]


def test_fingerprints(messy):
    texts = dict(zip(*zip(*[(r["text"], 0) for r in messy.collect()])))
    for t in texts:
        if t is None or len(t) < 20_000:
            assert op.fingerprint(t) % 2**64 == brute_fingerprint(t)
    assert op.fingerprint(None) == op.fingerprint(" \n") == 0


@pytest.mark.parametrize("seed", range(3))
def test_walks_find_all_links(seed):
    prints = fingerprints(seed, 150)
    leaves = np.array(prints, np.uint64)
    forest = op.Forest(len(leaves))
    order = np.argsort(op._swap(leaves))
    for member, root in (op.trie_join(leaves), [order[x] for x in op.trie_join(op._swap(leaves)[order])]):
        forest.link(member, root)
    assert groups(forest.label.tolist()) == groups(brute_components(prints))


@pytest.mark.parametrize("cell, limit", [(4, 1 << 17), (64, 1 << 17), (64, 5), (4, 30)])
def test_links_over_cells(spark, monkeypatch, cell, limit):
    monkeypatch.setattr(op, "CELL_SIZE", cell)
    monkeypatch.setattr(op, "CELL_LIMIT", limit)
    monkeypatch.setattr(op, "CHUNK", 64)
    prints = fingerprints(7, 120)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = as_rows(op.links(spark.createDataFrame([(s,) for s in signed], "fp long")))
    forest, place = op.Forest(len(signed)), {s: i for i, s in enumerate(signed)}
    forest.link(np.array([place[u] for u, _ in found]), np.array([place[v] for _, v in found]))
    assert groups(forest.label.tolist()) == groups(brute_components(prints))


def crowded(seed, n):
    """Fingerprints that share a half or three quarters, but for a bit or none, and others near them."""
    r = random.Random(seed)
    high, low, three = r.getrandbits(32), r.getrandbits(32), r.getrandbits(48)
    base = [high << 32 | r.getrandbits(32) for _ in range(n)] + [r.getrandbits(32) << 32 | low for _ in range(n)] + [three << 16 | r.getrandbits(16) for _ in range(n)]
    return sorted({flip(r.choice(base), r.sample(range(64), r.randint(0, 4))) for _ in range(3 * n)} | set(base))


@pytest.mark.parametrize("limit", [5, 40])
def test_crowded_halves(spark, monkeypatch, limit):
    """Cells above the limit where the first half ends are cut along the quarters."""
    monkeypatch.setattr(op, "CELL_LIMIT", limit)
    monkeypatch.setattr(op, "SPLIT_BITS", 16)
    prints = crowded(3, 120)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = as_rows(op.links(spark.createDataFrame([(s,) for s in signed], "fp long")))
    forest, place = op.Forest(len(signed)), {s: i for i, s in enumerate(signed)}
    forest.link(np.array([place[u] for u, _ in found]), np.array([place[v] for _, v in found]))
    assert groups(forest.label.tolist()) == groups(brute_components(prints))


@pytest.mark.parametrize("side", range(4))
def test_orders_of_bits(side):
    x = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    assert (op._print(op._word(x, side), side) == x).all() and (side == 0 or (op._word(x, side) != x).any())


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (70, 71), (71, 70)]
    got = dict(as_rows(components(spark.createDataFrame(edges, "u long, v long"))))
    assert len({got[i] for i in range(61)}) == 1 and len({got[1000 + i] for i in range(80)}) == 1 and got[70] == got[71] and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_operator(messy, nothing):
    rows = as_rows(messy.select("doc_id", "text"))
    prints = [brute_fingerprint(t) if len(t or "") < 20_000 else op.fingerprint(t) % 2**64 for _, t in rows]
    roots = brute_components(prints)
    want = []
    for (i, _), p, r in zip(rows, prints, roots):
        want.append((i, f"{p:016x}", min((d for (d, _), x in zip(rows, roots) if x == r and d is not None), default=None)))
    assert sorted(as_rows(op.simhash_dedup(messy)), key=repr) == sorted(want, key=repr)
    assert op.simhash_dedup(nothing).count() == 0


def test_stage(messy, nothing):
    out = op.keep_one_of_each(messy)
    assert out.columns == messy.columns and op.keep_one_of_each(nothing).count() == 0
    rows = as_rows(messy.select("doc_id", "text"))
    n = len(set(brute_components([op.fingerprint(t) % 2**64 for _, t in rows])))
    assert out.count() == n
