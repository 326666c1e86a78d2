import hashlib
import re
from collections import defaultdict

import numpy as np
from llm_helpers import as_rows, brute_dedup

from gridloom.llm import exact_dedup as op


def test_against_brute_force(messy):
    got = sorted(as_rows(op.exact_dedup(messy)), key=repr)
    want = sorted(brute_dedup(as_rows(messy.select("doc_id", "text"))), key=repr)
    assert [(a, b, c, e) for a, b, c, _, e in got] == [(a, b, c, e) for a, b, c, e in want]
    kept = defaultdict(list)
    for doc_id, keep_id, _, k, sha in got:
        if k:
            kept[sha].append(doc_id == keep_id)
    assert all(v == [True] for v in kept.values()) and len(kept) == len({e for *_, e in want})


def run(*rows):
    return np.array([(d.ljust(32, b"\0"), n, i is None, i or 0, u, c) for d, n, i, u, c in rows], op.RUN)


def test_merge_keeps_smallest_of_each():
    runs = [run((b"a", 1, 5, 0, 1), (b"c", 1, None, 1, 2)), run((b"a", 1, 3, 9, 4), (b"b", 2, 7, 2, 1)), run((b"a", 2, 1, 3, 1), (b"c", 1, 8, 4, 1))]
    assert op.merge(runs).tolist() == run((b"a", 1, 3, 9, 5), (b"a", 2, 1, 3, 1), (b"b", 2, 7, 2, 1), (b"c", 1, 8, 4, 3)).tolist()
    assert len(op.merge([])) == 0


def test_runs_meet_at_one_node():
    """Every digest of the pieces ends at the peer of its address, and groups carry all 32 bytes."""
    digests = [bytes([i]) * 8 + b"\x01" * 23 + b"\0" for i in range(40)]
    parts = op._sent(5, op.merge([run(*[(d, 1, 1, 1, 1) for d in digests])]), 5, 0)
    assert sorted(d for b in parts.column("run").to_pylist() for d in op._groups(np.frombuffer(b, op.RUN)).column("digest").to_pylist()) == sorted(digests)
    assert all(d[7] & 7 == node & 7 and node >> 3 == 0 for node, b in zip(*(parts.column(c).to_pylist() for c in ("node", "run"))) for d in op._groups(np.frombuffer(b, op.RUN)).column("digest").to_pylist())


def test_many_partitions(spark, messy):
    wide = messy.repartition(37)
    assert sorted(as_rows(op.exact_dedup(wide)), key=repr) == sorted(as_rows(op.exact_dedup(messy)), key=repr) or {r[1:3] for r in as_rows(op.exact_dedup(wide))} == {r[1:3] for r in as_rows(op.exact_dedup(messy))}


def test_empty(nothing):
    df = op.exact_dedup(nothing)
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0
    assert op.keep_first_copies(nothing).count() == 0


def test_stage_keeps_one_row_of_each_text(messy):
    out = op.keep_first_copies(messy)
    assert out.columns == messy.columns
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    texts = [norm(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({norm(r["text"]) for r in messy.collect()})
    assert 3 in {r["doc_id"] for r in out.collect()} and 5 not in {r["doc_id"] for r in out.collect()}
