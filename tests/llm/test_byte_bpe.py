import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridloom.llm import byte_bpe as op

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(messy, nothing, library):
    rows = messy.select("doc_id", "text").collect()
    want = sorted((str(d), len(ids := np.array(library.encode_ordinary(t or ""), "<u4")), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted((str(a), b, c, d) for a, b, c, d in op.round_trip(messy).collect()) == want
    assert op.round_trip(nothing).count() == 0


def test_encode_and_decode_frames(messy):
    back = op.decode(op.encode(messy)).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((r["text"] or "").encode() for r in messy.collect())


def test_long_words_and_generations(library, monkeypatch):
    monkeypatch.setattr(op, "CACHE_WORDS", 5)
    monkeypatch.setattr(op, "ROUND_TOKENS", 7)
    tables = op.Bpe(PATH, public_tokenizers.PATTERN)
    for text in ("a" * 3000, "thequickbrownfox" * 40, "ab cd ef gh ij kl mn ab cd", "日本語" * 200, " \n\n x  "):
        for _ in range(2):
            ids = tables.encode([text, text[::-1]])
            assert np.frombuffer(ids[0], "<u4").tolist() == library.encode_ordinary(text)
            assert tables.decode(ids) == [text.encode(), text[::-1].encode()]


def test_query_and_heap_agree():
    tables = op.Bpe(PATH, public_tokenizers.PATTERN)
    words = ["understanding", "zzzzzzzz", "Ünïcödé", "0123456789", "antidisestablishmentarianism"]
    tables._learn(words)
    for w in words:
        assert np.frombuffer(tables.new[w], "<u4").tolist() == tables.merge_long(w.encode())
