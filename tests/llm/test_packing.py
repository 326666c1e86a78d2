import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from llm_helpers import frame, prose

from gridloom.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, texts):
    """Every id in exactly one piece, no gap in a sequence; the share of padding."""
    whole = Tokenizer.from_file(PATH)
    want = sorted((len(ids := np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")), zlib.crc32(ids.tobytes())) for t in texts)
    rows = [r.asDict() for r in df.collect()]
    sequences, padding, total = defaultdict(list), 0, 0
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert total == sum(n for n, _ in want)
    return rows, padding / max(1, total)


def test_encoder_is_exact(messy):
    whole, encode = Tokenizer.from_file(PATH), op.encoder(PATH)
    for r in messy.collect():
        t = r["text"] or ""
        assert np.frombuffer(encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pieces(messy):
    texts = [r["text"] for r in messy.collect()]
    rows, _ = check(op.pack_documents(messy), texts)
    whole, by = Tokenizer.from_file(PATH), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc in (20, 23, 16, 25, 10):
        text = next(r["text"] for r in messy.collect() if r["doc_id"] == doc)
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_little_padding_with_one_hot_length(spark):
    texts = [(i, prose(1, 700) if i % 3 == 0 else prose(i, 10 + i * 7 % 900)) for i in range(300)]
    _, padding = check(op.pack_documents(frame(spark, texts)), [t for _, t in texts])
    assert padding < 0.02


def test_empty(nothing):
    assert op.pack_documents(nothing).count() == 0


def test_size_classes(spark):
    lengths = list(range(1, 4096))
    got = [r[0] for r in spark.createDataFrame([(n,) for n in lengths], "n long").coalesce(1).select(op.size_column(F.col("n"))).collect()]
    assert got == [op.size_class(n) for n in lengths] and len(set(got)) <= 256
    assert all(n <= s <= n * 33 / 32 + 1 for n, s in zip(lengths, got))


def test_nnls_and_plan():
    x = op.nnls([{0: 1.0}, {1: 1.0}, {0: 1.0, 1: 1.0}], 2, np.array([3.0, 5.0]))
    assert np.allclose([x[0] + x[2], x[1] + x[2]], [3, 5]) and (x >= 0).all()
    assert op.nnls([{0: 1.0}], 1, np.array([-2.0])).tolist() == [0.0]
    histogram = {1000: 400, 3096: 90, 2048: 51, 100: 2000, 4: 7}
    used = defaultdict(int)
    for combo, repeats in op.plan(histogram):
        assert op.WINDOW * (1 - op.WASTE) <= sum(s * k for s, k in combo.items()) <= op.WINDOW
        for s, k in combo.items():
            used[s] += k * repeats
    assert all(used[s] <= n for s, n in histogram.items()) and used[100] == 900 and used[3096] == 90
    assert op.plan({}) == []
