import zlib

import numpy as np
from llm_helpers import DOCS, as_rows

from gridloom.llm import language_id as op

SAMPLES = {"en": "the quick brown fox and the lazy dog were there with them", "de": "der schnelle braune fuchs und der faule hund waren nicht zu hause", "fr": "le renard brun et rapide saute par dessus le chien qui est là", "es": "el zorro marrón rápido salta sobre el perro que está en la casa"}


def corpus(spark, n=400, langs=tuple(SAMPLES)):
    rows, r = [], np.random.default_rng(0)
    for i in range(n):
        lang = langs[i % len(langs)]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(r.choice(words, 12)), lang, "s", 1, "k", "i", "n", "f", "u"))
    return spark.createDataFrame(rows, DOCS)


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = op.identify(docs, op.fit(op.training_rows(docs))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert len(held) > 80 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_learns_only_from_training_rows(spark):
    docs = corpus(spark)
    ids = {r["id"] for r in op.training_rows(docs).collect()}
    assert ids == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_messy_and_empty(spark, messy, nothing):
    model = op.fit(op.training_rows(corpus(spark)))
    by = {r["doc_id"]: r for r in op.identify(messy, model).collect() if r["doc_id"] is not None}
    for blank in (10, 11, 12, 15):
        assert (by[blank]["lang_pred"], by[blank]["score"]) == ("und", 0.0)
    assert by[13]["lang_pred"] in SAMPLES and op.identify(messy, model).count() == messy.count()
    assert op.identify(nothing, model).count() == 0
    unlearned = op.fit(op.training_rows(nothing))
    assert {r[2] for r in as_rows(op.identify(messy, unlearned))} == {"und"}
    single = op.fit(op.training_rows(corpus(spark, 60, ("en",))))
    assert {r[2] for r in as_rows(op.identify(messy, single))} == {"en", "und"}


#: In languages that are not learned.
STRANGE = {1001: "これは日本語の文章です。とても長いので、分類器はどの符号語にも近くありません。", 1002: "Αυτό είναι ένα ελληνικό κείμενο που δεν έχει μάθει κανείς", 1003: "lorem ipsum dolor sit amet consectetur adipiscing elit"}


def test_stage(spark, messy, nothing):
    """The classifier decides: texts in languages that were learned stay, others go, but for those too short to tell."""
    more = [*STRANGE.items(), (1010, "語"), (1011, "12 345")]
    docs = corpus(spark).unionByName(spark.createDataFrame([(i, t, None, "s", 1, "k", "i", "n", "f", "u") for i, t in more], DOCS))
    model = op.fit(op.training_rows(docs))
    assert all(model.predict(t)[3] for t in STRANGE.values()) and not model.predict("語")[3] and not any(model.predict(t)[3] for t in SAMPLES.values())
    out = op.keep_identified(docs)
    assert out.schema == docs.schema and {r["doc_id"] for r in out.collect()} == {*range(400), 1010}
    german = op.keep_identified(corpus(spark), languages=["de"])
    assert {r["doc_id"] for r in german.collect()} == {i for i in range(400) if i % 4 == 1}
    both = corpus(spark).unionByName(messy)
    left = {r["doc_id"] for r in op.keep_identified(both).collect()}
    assert {*range(400)} - {10, 11, 12, 15} <= left and op.keep_identified(nothing).count() == 0


def test_against_loops(spark):
    """Every row of the query's result against one text at a time."""
    docs = corpus(spark, 60).unionByName(spark.createDataFrame([(i, t, None, "s", 1, "k", "i", "n", "f", "u") for i, t in STRANGE.items()], DOCS))
    model = op.fit(op.training_rows(docs))
    got = {r[0]: r[2:] for r in as_rows(op.identify(docs, model))}
    for r in docs.collect():
        bits = [sum(float(model.weights[g, b]) for order in op.buckets(op.folded(r["text"])) for g in order) for b in range(model.weights.shape[1])]
        n = sum(len(order) for order in op.buckets(op.folded(r["text"])))
        losses = [sum(w * np.log1p(np.exp(-op.LOSS_SCALE * c * s / n)) for w, c, s in zip(model.bit_weights, word, bits)) / sum(model.bit_weights) for word in model.code]
        assert got[r["doc_id"]][0] == model.languages[int(np.argmin(losses))] and got[r["doc_id"]][3] == (min(losses) > op.REJECT_LOSS)  # texts of one piece


def test_mixtures_of_languages_stay(spark):
    model = op.fit(op.training_rows(corpus(spark)))
    parts = [" ".join([SAMPLES[lang]] * (op.PIECE // len(SAMPLES[lang]) + 1))[: op.PIECE] for lang in SAMPLES]
    mixed, strange = "".join(parts), "".join(list(STRANGE.values()) * 6)
    loss = model.decode(model.bits(mixed))[3]
    assert loss > op.REJECT_LOSS and not model.predict(mixed)[3] and model.predict(strange)[3]


def test_stage_with_nothing_to_learn(messy):
    out = op.keep_identified(messy.drop("lang").selectExpr("*", "cast(null AS string) AS lang"))
    assert out.count() == messy.count() - 5 and not {r["doc_id"] for r in out.collect()} & {10, 11, 12, 15}


def test_codebooks():
    for n in (2, 3, 4, 6, 9, 20):
        code = op.codebook(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)
        assert len({tuple(c) for c in code.T if n <= 6}) == (code.shape[1] if n <= 6 else 0)


def test_ambiguity():
    code = op.codebook(4)
    model = op.Model(("a", "b", "c", "d"), code, np.zeros((4, 7)), np.ones(7))
    assert model.decode(code[2] * 1.0)[0] == "c" and not model.decode(code[2] * 1.0)[2]
    assert model.decode(np.zeros(7))[2]
    flipped = code[1] * 1.0
    flipped[0] *= -1
    assert model.decode(flipped)[0] == "b"


def test_buckets_are_those_of_each_gram():
    raw = np.frombuffer(b"abcabc", np.uint8)
    grams = op.buckets(raw)
    assert [len(g) for g in grams] == [6, 5, 4, 3] and all(g[0] == g[3] for g in grams[:3]) and all(g.max() < 1 << op.BUCKET_BITS for g in grams)
