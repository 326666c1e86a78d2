import re

from llm_helpers import brute_components, brute_fingerprint, frame, prose

import corpus_pipeline
from gridloom.llm import catalogue, language_id, toxicity


def test_stages(spark, tmp_path):
    r = [(i, prose(i, 120)) for i in range(40)]
    near = prose(100, 400)
    r += [(100, near), (101, near + " end"), (102, r[0][1] + " "), (103, None), (104, "123 456"), (105, r[1][1])]
    frame(spark, r).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x["doc_id"] for x in out}
    assert set(range(40)) <= ids and 100 in ids and not ids & {101, 102, 103, 104, 105}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema


def test_against_loops(spark, tmp_path):
    """All stages by plain loops over the rows: the models' answers text by text, groups by dictionaries, links by all pairs."""
    texts = [(i, prose(i, 30 + i)) for i in range(60)] + [(60 + i, f"you idiot scum {prose(i, 5)} idiot scum you") for i in range(20)]
    texts += [(80 + i, prose(i, 30 + i).replace(" ", "  ", 2)) for i in range(5)] + [(90, "これは日本語の文章です。とても長いので分類器は知りません。"), (91, None), (92, "12")]
    long = prose(77, 900)
    texts += [(100 + i, long + f" tail{i}" * (i % 2)) for i in range(6)]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(60 <= i < 80)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    known = language_id.fit(language_id.training_rows(docs))
    rows = [(i, t) for i, t in texts if not known.predict(t)[3]]
    judge = toxicity.fit(docs.filter(docs["doc_id"].isin([i for i, _ in rows])), spark.read.parquet(str(tmp_path / "labels.parquet")))
    rows = [(i, t) for i, t in rows if judge.scores([t])[0] < toxicity.LIMIT]
    firsts = {}
    for i, t in sorted(rows):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    rows = sorted(firsts.values())
    roots = brute_components([brute_fingerprint(t) for _, t in rows])
    kept = [rows[k] for k, r in enumerate(roots) if k == r]
    assert sorted({x["doc_id"] for x in out}) == [i for i, _ in kept] and 90 not in {i for i, _ in kept} and len(kept) < len(texts) - 12
    for i, t in kept:
        pieces = sorted((x["start"], x["length"]) for x in out if x["doc_id"] == i)
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and {x["doc_tokens"] for x in out if x["doc_id"] == i} == {sum(n for _, n in pieces)}


def test_catalogue():
    import __spark_entry__

    names = catalogue.queries()
    assert sorted(n.partition("_")[0] for n in names) == sorted(f"op{i}" for i in range(1, 11)) and set(catalogue.oracle_sql()) <= set(names)
    assert {*names, "pipeline"} <= set(__spark_entry__.queries())
