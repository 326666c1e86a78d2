"""Dedup of repeated line runs by a suffix array over line ids.

A document is a sequence of line ids (blank lines aside); all documents in order
of their ids are one long sequence with a gap after each, so that a line is known
by its place in it. Prefix doubling ranks the suffixes by their first 1, 2, 4,
... lines: a round joins each suffix' rank with the rank of the suffix as many
lines further on, and numbers the distinct pairs in sorted order, by ranges over
all executors. Suffixes whose prefix occurs once drop out, so later rounds handle
only what is still repeated.

The ranks of the rounds then give the longest-common-prefix intervals. A suffix
starts in the interval of the longest power of two that it shares with an earlier
suffix. From the longest power down, intervals are split by the rank of what
comes next: the members of a part share that many lines more, and all but its
first go down into it. The first stays and stands for the part, so there are
never more than two rows for a suffix that still moves. Where a suffix comes to
rest is its longest common prefix with any earlier suffix: a maximal repeated
run, unless the run of the line before covers it. Later copies are deleted.

Documents with equal lines are one sequence: the first enters, the others are
later copies as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, stored, table

#: Words that a repeated run must have: none is left for its shortness.
MIN_WORDS = 1

_LINES = "uid long, doc_id long, key string, same binary, n_lines long, enough boolean, a array<long>, b array<long>, need array<int>"


def split_lines(text: str | None) -> list[str]:
    """The lines of a text; a null text has one, empty."""
    return (text or "").split("\n")


def shortest_runs(words: list[int], least: int) -> np.ndarray:
    """For each line the number of lines from it on that hold ``least`` words, 0 if too few follow."""
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + least, side="left")
    return np.where(end <= len(words), end - np.arange(len(words)), 0)


def content(text: str | None) -> list[tuple[int, str]]:
    """(physical line, line with white space collapsed) of the lines that are not blank."""
    return [(i, s) for i, line in enumerate(split_lines(text)) if (s := " ".join(line.split()))]


def text_key(text: str | None) -> str:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def _lines(least: int):
    """A row for each text: a key of it, one of its lines, and the id and shortest run of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            found = []
            for uid, doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                lines = [s for _, s in content(text)]
                digests = b"".join(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest() for s in lines)
                a, b = np.frombuffer(digests, "<i8").reshape(-1, 2).T
                need = shortest_runs([s.count(" ") + 1 for s in lines], least)
                found.append((uid, doc_id, text_key(text), hashlib.sha256(digests).digest(), len(lines), bool(len(need) and need[0]), a, b, need))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = [f.split()[0] for f in _LINES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    return run


def _ordered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` computed once in the order of ``by``, with the partition that each row is in (part) and its number there (k)."""
    row = F.monotonically_increasing_id()
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"part": F.shiftright(row, 33), "k": row.bitwiseAND(F.lit((1 << 33) - 1))}))


def _starts(placed: DataFrame, size) -> DataFrame:
    """(part, start): the sizes of the partitions before each; one row for each partition."""
    sizes = placed.groupBy("part").agg(size.alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")))


def _ranks(pairs: DataFrame) -> DataFrame:
    """(a, b, rank, first) of the pairs of ``pairs`` (a, b, place) that occur more than once: their number in sorted order over all partitions and their first place."""
    repeated = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).filter("n > 1").select("a", "b", "first")
    placed = _ordered(repeated, "a", "b")
    return placed.join(_starts(placed, F.count(F.lit(1))), "part").select("a", "b", (F.col("start") + F.col("k")).alias("rank"), "first")


def _heads(every: DataFrame) -> DataFrame:
    """(uid, doc_id, key, same, n_lines, enough, start): a row of each text with the place of its first line, in order of the ids (null ids last)."""
    heads = every.select("uid", "doc_id", "key", "same", "n_lines", "enough", F.col("doc_id").isNull().alias("none"))
    placed = _ordered(heads, "none", "doc_id", "uid")
    # a gap after each text: no run goes on into the next one
    upto = F.sum(F.col("n_lines") + 1).over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    inner = placed.withColumn("upto", F.coalesce(upto, F.lit(0))).join(_starts(placed, F.sum(F.col("n_lines") + 1)), "part")
    return inner.select("uid", "doc_id", "key", "same", "n_lines", "enough", (F.col("start") + F.col("upto")).alias("start"))


def _doubled(lines: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """By round k, the (place, rank) of suffixes whose first 2^k lines are repeated, and the suffixes that share 2^k lines, but no more powers, with an earlier one."""
    levels, resting, h = [], [], 1
    now = cut(lines.join(_ranks(lines), ["a", "b"]).select("start", "place", "need", "rank", "first"))
    while not now.isEmpty():
        levels.append(now.select("place", "rank"))
        ahead = now.select((F.col("place") - h).alias("place"), F.col("rank").alias("b"))
        pairs = now.withColumnRenamed("rank", "a").join(ahead, "place", "left")
        ranks = _ranks(pairs.filter("b is not null").select("a", "b", "place")).withColumnRenamed("first", "next")
        # without a rank ahead there is no such pair: a number of its own keeps such rows from meeting in one task
        done = stored(pairs.withColumn("b", F.coalesce("b", -1 - F.col("place"))).join(ranks, ["a", "b"], "left"))
        later = (F.col("place") != F.col("first")) & (F.col("next").isNull() | (F.col("next") == F.col("place")))
        resting.append(done.filter(later).select("start", "place", "need", F.col("first").alias("node"), F.lit(h).cast("long").alias("length")))
        now = done.filter("rank is not null").select("start", "place", "need", "rank", F.col("next").alias("first"))
        h *= 2
    return levels, resting


def _intervals(levels: list[DataFrame], resting: list[DataFrame]) -> DataFrame:
    """(start, place, need, length): every line that an earlier one equals, with its longest common prefix with any earlier suffix."""
    found = resting[0]
    if len(resting) > 1:
        moving = resting[1]
        for more in resting[2:]:
            moving = moving.unionAll(more)
        own = lambda nodes: nodes.select(F.lit(None).cast("long").alias("start"), F.col("node").alias("place"), F.lit(None).cast("int").alias("need"), "node", "length")
        moving = moving.unionAll(own(moving.select("node", "length").distinct()))
        for k in range(len(resting) - 2, -1, -1):
            step = 1 << k
            reach = levels[k].select(F.col("place").alias("at"), "rank")
            open_ = moving.filter(F.col("length") > step)
            seen = cut(open_.join(reach, F.col("place") + F.col("length") == F.col("at"), "left").drop("at").withColumn("rank", F.coalesce("rank", -1 - F.col("place"))))
            parts = cut(seen.filter("rank >= 0").groupBy("node", "length", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).filter("n > 1").drop("n"))
            goes = F.col("first").isNotNull() & (F.col("first") != F.col("place"))
            down = seen.join(parts, ["node", "length", "rank"], "left").select(
                "start", "place", "need", F.when(goes, F.col("first")).otherwise(F.col("node")).alias("node"), F.when(goes, F.col("length") + step).otherwise(F.col("length")).alias("length")
            )
            leads = own(parts.select(F.col("first").alias("node"), (F.col("length") + step).alias("length")))
            moving = stored(down.unionAll(leads).unionAll(moving.filter(F.col("length") <= step)))
        found = found.unionAll(moving.filter("place <> node"))
    return found.select("start", "place", "need", "length")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """A row for each of ``docs`` (doc_id, key, n_lines, start, copy: all of its lines are a later copy) and the maximal later copies in the others (start, place, length)."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = cut(rows.mapInArrow(_lines(min_words), _LINES))
    heads = _heads(every)
    firsts = heads.groupBy("same").agg(F.min("start").alias("least"))
    heads = cut(heads.join(firsts, "same").withColumn("copy", F.col("start") != F.col("least")).drop("same", "least"))
    at = F.posexplode(F.arrays_zip("a", "b", "need")).alias("pos", "line")
    whole = every.select("uid", "a", "b", "need").join(heads.filter("not copy and n_lines > 0").select("uid", "start"), "uid").select("start", at)
    lines = cut(whole.select("start", (F.col("start") + F.col("pos")).alias("place"), "line.need", "line.a", "line.b"))
    levels, resting = _doubled(lines)
    if not levels:
        return heads, heads.select("start", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("length")).limit(0)
    by = Window.partitionBy("start").orderBy("place")
    before = F.lag(F.col("place") + F.col("length")).over(by)
    runs = _intervals(levels, resting).withColumn("covered", before)
    # ends never go back, so a run that the one before covers ends where that does
    maximal = runs.filter("(covered is null or covered < place + length) and need > 0 and length >= need")
    return heads, maximal.select("start", "place", "length")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, removed_lines, removed) of every row.

    Lines are compared with white space collapsed; blank lines are not counted,
    so a run goes on over them. ``removed`` lists the removed runs as ranges of
    non-blank lines from 0 on, as ``3-7,6-13``; it is empty if none are. They
    are the longest runs that an earlier place has too and that hold
    ``min_words`` words; runs with different earlier places may overlap.
    ``removed_lines`` counts each line once. Earlier is a smaller doc_id (null
    ids last), within a document a line before; of repeated rows the later ones
    lose all lines. Null, empty and blank texts have no lines; an empty table
    gives an empty result. Only doc_id and text are read. The runs of one text
    are listed in one task, as the text itself is read in one.
    """
    return _decided(docs, min_words).select("doc_id", "n_lines", "removed_lines", "removed")


def _decided(docs: DataFrame, min_words: int) -> DataFrame:
    heads, runs = repeated_runs(docs, min_words)
    end = F.col("place") + F.col("length")
    before = F.lag(end).over(Window.partitionBy("start").orderBy("place"))
    new = runs.withColumn("new", end - F.greatest(F.col("place"), F.coalesce(before, F.lit(0))))
    span = F.struct((F.col("place") - F.col("start")).alias("lo"), (end - F.col("start") - 1).alias("hi"))
    listed = new.groupBy("start").agg(F.sum("new").alias("lost"), F.array_sort(F.collect_list(span)).alias("spans"))
    text = F.array_join(F.transform("spans", lambda s: F.concat(s["lo"], F.lit("-"), s["hi"])), ",")
    found = heads.join(listed.select("start", "lost", text.alias("text")), "start", "left")
    gone = F.col("copy") & F.col("enough")
    return found.select(
        "doc_id", "key", "start", "n_lines",
        F.when(gone, F.col("n_lines")).otherwise(F.coalesce("lost", F.lit(0))).alias("removed_lines"),
        F.when(gone, F.concat(F.lit("0-"), F.col("n_lines") - 1)).otherwise(F.coalesce("text", F.lit(""))).alias("removed"),
    )


def without_lines(text: str, removed: str) -> str:
    """The text without the given ranges of non-blank lines."""
    lines = content(text)
    gone = {lines[k][0] for span in removed.split(",") for a, b in [span.split("-")] for k in range(int(a), int(b) + 1)}
    return "\n".join(line for i, line in enumerate(split_lines(text)) if i not in gone)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 64):
        at, cuts = part.schema.names.index("_gl_text"), part.column(part.num_columns - 1).to_pylist()
        texts = [without_lines(t, r) if r else t for t, r in zip(part.column(at).to_pylist(), cuts)]
        columns = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(part.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with later copies of repeated runs deleted from the texts.

    Rows that share id and text are cut alike, as the first of them is.
    """
    by = [F.col("doc_id").alias("_gl_id"), F.col("key").alias("_gl_key")]
    decided = _decided(docs, min_words).groupBy(*by).agg(F.min_by("removed", "start").alias("_gl_removed")).filter("_gl_removed <> ''")
    names = docs.columns
    keyed = docs.withColumn("_gl_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = keyed.join(decided, F.col("doc_id").eqNullSafe(F.col("_gl_id")) & (F.col("_gl_hash") == F.col("_gl_key")), "left")
    out = joined.select(*[F.col(f"`{c}`").alias("_gl_text" if c == "text" else f"c{i}") for i, c in enumerate(names)], "_gl_removed")
    schema = type(out.schema)(out.schema.fields[:-1])
    return out.mapInArrow(_rewrite, schema).toDF(*names)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated line runs of all documents."""
    return line_dedup(table(spark, sf_dir, "documents"))


QUERY = ("op7_line_dedup", op7_line_dedup)
#: White space as Python splits at it.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# The query's floor is one word, so the SQL needs no words: the longest run from each line on that an earlier line begins, a line at a time.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d
), grown AS (
  SELECT doc_id, pos, 1 AS n, line AS name, count(*) OVER (PARTITION BY line) AS copies, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy FROM l
  UNION ALL
  SELECT g.doc_id, g.pos, g.n + 1, md5(g.name || chr(10) || l.line), count(*) OVER (PARTITION BY g.name, l.line), row_number() OVER (PARTITION BY g.name, l.line ORDER BY g.doc_id, g.pos)
  FROM grown g JOIN l ON l.doc_id = g.doc_id AND l.pos = g.pos + g.n WHERE g.copies > 1
), e AS (
  SELECT doc_id, pos, max(n) AS n FROM grown WHERE copy > 1 GROUP BY doc_id, pos
), w AS (
  SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM e
), t AS (
  SELECT doc_id, sum(pos + n - greatest(pos, coalesce(covered, 0)))::BIGINT AS removed_lines, string_agg(pos || '-' || (pos + n - 1), ',' ORDER BY pos) AS removed
  FROM w WHERE covered IS NULL OR covered < pos + n GROUP BY doc_id
)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(removed_lines, 0) AS removed_lines, coalesce(removed, '') AS removed FROM d LEFT JOIN t USING (doc_id)
"""
