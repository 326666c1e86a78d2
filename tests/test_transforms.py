from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.errors import InvalidRow, typed_errors
from gridloom.operators import transforms as X
from gridloom.rowid import ROW_ID, with_row_id


def cells(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def people(spark):
    return with_row_id(spark.createDataFrame([(i, f" n{i}\t", None if i % 3 else i % 2 == 0) for i in range(20)], "id int, name string, flag boolean"), "id")


def test_row_ids_are_dense(spark):
    df = with_row_id(spark.range(1000).select((1000 - F.col("id")).alias("v")).repartition(7), "v")
    assert [r["_row_id"] for r in df.orderBy("v").collect()] == list(range(1000))
    assert with_row_id(spark.createDataFrame([], "v int"), "v").count() == 0
    with pytest.raises(ValueError):
        with_row_id(spark.range(3))


@pytest.mark.parametrize("literal_parts", [500, 1])
def test_row_ids_are_dense_over_many_partitions(spark, monkeypatch, literal_parts):
    monkeypatch.setattr("gridloom.rowid.LITERAL_PARTS", literal_parts)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = with_row_id(spark.range(120_000).select(F.xxhash64("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("wide")), "v")
        found = df.agg(F.countDistinct(ROW_ID), F.max(ROW_ID), F.count("*")).first()
        assert tuple(found) == (120_000, 119_999, 120_000)
        rows = [r["v"] for r in df.orderBy(ROW_ID).limit(50_000).select("v").collect()]
        assert rows == sorted(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trim_null_bool(people):
    out = people.transform(X.trim()).transform(X.bool_as("Y", "N")).transform(X.null_as("-")).orderBy(ROW_ID)
    assert cells(out.select("name", "flag"))[:4] == [("n0", "Y"), ("n1", "-"), ("n2", "-"), ("n3", "N")]
    assert people.withColumnRenamed("name", " name ").transform(X.trim(keys=True)).columns == ["id", "name", "flag", ROW_ID]


def test_map_filter_slice_chunk(people):
    mapped = people.transform(X.map_rows(lambda row, i: {"x": row["id"] * 10 + i}, "x long"))
    assert sorted(cells(mapped)) == [(i, 11 * i) for i in range(20)]
    assert people.transform(X.filter_rows(lambda i: i % 5 == 0)).count() == 4
    part = people.transform(X.slice_rows(5, 3)).orderBy(ROW_ID)
    assert [(r[ROW_ID], r["id"]) for r in part.collect()] == [(0, 5), (1, 6), (2, 7)]
    assert people.transform(X.slice_rows(0, 0)).count() == 0 and people.transform(X.slice_rows(18)).count() == 2
    chunks = sorted((r["chunk"], [x["id"] for x in r["rows"]]) for r in people.transform(X.chunk(8)).collect())
    assert [len(c) for _, c in chunks] == [8, 8, 4] and chunks[0][1] == list(range(8))
    for wrong in (lambda: X.chunk(0), lambda: X.slice_rows(-1), lambda: X.slice_rows(0, -1)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError, match="_row_id"):
        people.drop(ROW_ID).transform(X.chunk(2))


def test_permissive_cast(spark):
    values = ["42", "19.99", "-19.99", "abc", "", None, " 7 ", "1e3", "yes", "0", "On"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    got = lambda kind: [r[0] for r in df.transform(X.cast({"v": kind})).orderBy("i").select("v").collect()]
    assert got("int") == [42, 19, -19, 0, 0, 0, 7, 1000, 0, 0, 0]
    assert got("?int") == [42, 19, -19, None, None, None, 7, 1000, None, 0, None]
    assert got("float")[:5] == [42.0, 19.99, -19.99, 0.0, 0.0] and got("?float")[3] is None
    assert got("bool") == [False] * 8 + [True, False, True] and got("?bool")[3:6] == [False, None, None]
    assert got("string")[4:6] == ["", ""] and got("?string")[4:6] == [None, None]
    assert got("mystery") == values
    dates = spark.createDataFrame([("2024-01-02",), ("2024-02-30",), ("2024-01-02T03:04:05Z",), ("x",), ("",)], "v string").coalesce(1).transform(X.cast({"v": "date", "missing": "int"}))
    assert [r[0] for r in dates.collect()] == [datetime(2024, 1, 2), datetime(2024, 3, 1), datetime(2024, 1, 2, 3, 4, 5), None, None]
    when = spark.createDataFrame([(datetime(2024, 1, 2, 3),)], "v timestamp_ntz")
    assert when.transform(X.cast({"v": "date"})).first()[0] == datetime(2024, 1, 2, 3) and when.transform(X.cast({"v": "int"})).first()[0] == 0


def test_strict_cast(spark):
    df = with_row_id(spark.createDataFrame([(0, "1", "2024-01-01"), (1, "x", "bad"), (2, None, "")], "k int, n string, d string"), "k")
    assert cells(df.filter("k = 0").transform(X.cast_strict({"n": "int", "d": "date"})).select("n", "d")) == [(1, datetime(2024, 1, 1))]
    for rows, types, row, column in (("k = 1", {"n": "int"}, 1, "n"), ("k = 1", {"d": "date"}, 1, "d"), ("k = 2", {"n": "int"}, 2, "n")):
        with pytest.raises(InvalidRow) as e, typed_errors():
            df.filter(rows).transform(X.cast_strict(types)).collect()
        assert (e.value.row, e.value.column) == (row, column)
    assert df.filter("k = 2").transform(X.cast_strict({"n": "?int", "d": "date"})).first()["n"] is None
    with pytest.raises(ValueError):
        X.cast_strict({"n": "mystery"})


def test_chain_is_one_projection(people):
    plan = people.transform(X.trim()).transform(X.null_as("")).transform(X.filter_rows(F.col("id") > "3"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 2
