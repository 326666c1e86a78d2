import random

import pytest
from llm_helpers import frame, prose

from gridloom.llm import line_dedup as op


def brute(rows, least):
    """Maximal later copies (first, last line) of each row, by its place, for rows in order."""
    seen, found = set(), []
    for _, text in rows:
        lines = [s for line in (text or "").split("\n") if (s := " ".join(line.split()))]
        out, end = [], 0
        for i in range(len(lines)):
            n = max((j for j in range(i + 1, len(lines) + 1) if tuple(lines[i:j]) in seen), default=i)
            if n > max(i, end) and sum(len(s.split()) for s in lines[i:n]) >= least:
                out.append((i, n - 1))
            end = max(end, n)
            seen.update(tuple(lines[i:j]) for j in range(i + 1, len(lines) + 1))
        found.append(out)
    return found


def spread(removed):
    return {k for span in removed.split(",") if span for a, b in [span.split("-")] for k in range(int(a), int(b) + 1)}


@pytest.fixture(scope="module")
def repeats():
    r = random.Random(4)
    pool = [prose(i, r.randint(1, 12)) for i in range(25)]
    runs = [[r.choice(pool) for _ in range(r.randint(3, 30))] for _ in range(6)]
    texts = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(1, 4)):
            lines += r.choice(runs) if r.random() < 0.5 else [prose(1000 + i * 10 + k, 8) for k in range(4)]
            lines += [""] * r.randint(0, 2)
        texts.append((i, "\n".join(lines)))
    return texts


def written(runs):
    return ",".join(f"{a}-{b}" for a, b in runs)


@pytest.mark.parametrize("least", [1, 50])
def test_against_brute_force(spark, repeats, least):
    got = {r["doc_id"]: r for r in op.line_dedup(frame(spark, repeats).repartition(5), least).collect()}
    for (i, _), runs in zip(repeats, brute(repeats, least)):
        assert got[i]["removed"] == written(runs) and got[i]["removed_lines"] == len(spread(written(runs)))


def test_nested_and_overlapping_runs(spark):
    """Few ids, so that every suffix shares prefixes of many lengths with many others, its own text among them."""
    r = random.Random(11)
    texts = [(i, "\n".join(r.choice("abc") for _ in range(r.randint(1, 40)))) for i in range(60)]
    texts += [(100 + i, "\n".join(["p q"] * n)) for i, n in enumerate([5, 1, 9, 9, 33])]
    texts += [(200 + i, "\n".join([f"line {k}" for k in range(70)][i : 70 - 2 * i])) for i in range(12)]
    got = {x["doc_id"]: x for x in op.line_dedup(frame(spark, texts).repartition(4)).collect()}
    for (i, _), runs in zip(texts, brute(texts, 1)):
        assert got[i]["removed"] == written(runs) and got[i]["removed_lines"] == len(spread(written(runs)))


def test_rows_that_share_all(spark):
    """Of repeated rows the texts stay as the first of them is cut."""
    docs = frame(spark, [(1, "a\nb"), (2, "x\na\nb\ny"), (2, "x\na\nb\ny")])
    assert sorted((r["doc_id"], r["text"]) for r in op.remove_repeated_lines(docs).collect()) == [(1, "a\nb"), (2, "x\ny"), (2, "x\ny")]
    assert sorted(r["removed"] for r in op.line_dedup(docs).collect()) == ["", "0-3", "1-2"]


def test_messy_and_empty(spark, messy, nothing):
    got = op.line_dedup(messy).collect()
    assert len(got) == messy.count() and op.line_dedup(nothing).count() == 0
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[10][0]["n_lines"] == by[11][0]["n_lines"] == by[12][0]["n_lines"] == 0 and [r["removed"] for r in by[13]] == ["0-0"]  # a line of 8
    assert sorted(r["removed_lines"] for r in by[3]) == [0, 1] and by[5][0]["removed"] == "0-0" and sorted(r["removed_lines"] for r in by[None]) == [0, 1]
    assert by[20][0]["removed_lines"] == by[21][0]["removed_lines"] == 0


def test_texts_without_later_copies(spark, repeats, nothing):
    docs = frame(spark, repeats)
    out = op.remove_repeated_lines(docs)
    assert out.schema == docs.schema and op.remove_repeated_lines(nothing).count() == 0
    gone = [spread(written(runs)) for runs in brute(repeats, 1)]
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    for (i, text), g in zip(repeats, gone):
        kept = [s for k, s in enumerate(line for line in text.split("\n") if line.strip()) if k not in g]
        assert [s for s in texts[i].split("\n") if s.strip()] == kept


def test_shortest_runs():
    assert op.shortest_runs([3, 4, 5, 1], 7).tolist() == [2, 2, 0, 0] and op.shortest_runs([], 5).tolist() == []


def test_tail_of_a_whole_run(spark):
    text = prose(1, 60) + "\n" + prose(2, 5)
    docs = frame(spark, [(1, text), (2, text), (3, text + "\n" + prose(3, 5)), (4, text + "\n" + prose(3, 5) + "\n" + prose(4, 5))])
    for least in (1, 50):
        assert {r["doc_id"]: r["removed"] for r in op.line_dedup(docs, least).collect()} == {1: "", 2: "0-1", 3: "0-1", 4: "0-2"}
        assert {r["doc_id"]: r["text"] for r in op.remove_repeated_lines(docs, least).collect()}[4] == prose(4, 5)
