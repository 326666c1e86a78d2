import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import DataFrame

from gridloom import facade, options, segments
from gridloom.errors import InvalidDocument
from gridloom.rowid import with_row_id
from gridloom.segments import segments_of
from gridloom.sinks import staged
from gridloom.sources import frames, package


def numbered(spark, n=500):
    return with_row_id(spark.range(n).selectExpr("id AS k", "concat('s ', id % 7, ' <&> \"q\", é') AS s", "id * 0.5D AS f"), "k")


def no_rows_to_the_driver(monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows go through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)


@pytest.mark.parametrize("encoding", [None, "utf-16-le", "iso-8859-1"])
def test_csv_rows_pass_by_the_driver(spark, tmp_path, monkeypatch, encoding):
    frame = numbered(spark)
    by_lines = b"".join(facade.download(frame, "x", "csv", headers=["k", "s", "f"], bom=False, output_encoding=encoding)[2])
    no_rows_to_the_driver(monkeypatch)
    for path in (str(tmp_path / "a.csv"), f"file://{tmp_path}/b.csv"):
        facade.write(frame, path, headers=["k", "s", "f"], bom=False, output_encoding=encoding)
        with open(path.removeprefix("file://"), "rb") as f:
            assert f.read() == by_lines


def test_joined_checksums():
    draw = random.Random(1)
    for _ in range(50):
        a, b = draw.randbytes(draw.randrange(300)), draw.randbytes(draw.randrange(300))
        assert segments.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("kind,entry", [("xlsx", "xl/worksheets/sheet1.xml"), ("ods", "content.xml")])
def test_workbook_rows_pass_by_the_driver(spark, tmp_path, monkeypatch, kind, entry):
    monkeypatch.setattr(staged, "SEGMENT_BYTES", 1 << 12)
    monkeypatch.setattr(staged, "SLICE_ROWS", 50)
    no_rows_to_the_driver(monkeypatch)
    path = f"file://{tmp_path}/book.{kind}"
    facade.write(numbered(spark), path, assoc=True)
    with zipfile.ZipFile(path.removeprefix("file://")) as book:
        assert book.testzip() is None
        info = book.getinfo(entry)
        found = segments_of(info)
        assert sum(s.rows for s in found) == 501 and len(found) > 3
        assert book.read(info).count(b"<row>" if kind == "xlsx" else b"<table:table-row>") == 501
    assert facade.write_bytes(numbered(spark), kind, assoc=True)[:2] == b"PK"
    assert facade.read(spark, path, assoc=True).count() == 500


def test_shared_strings_pass_by_the_driver(spark, monkeypatch):
    no_rows_to_the_driver(monkeypatch)
    content = facade.write_bytes(numbered(spark), "xlsx", assoc=True, shared_strings=True)
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        found = book.read("xl/sharedStrings.xml").decode()
    assert 'count="10" uniqueCount="10"' in found and found.index(">k<") < found.index(">s 0 ") < found.index(">s 1 ") < found.index(">s 6 ")
    assert [r[1] for r in facade.read_bytes(spark, content, assoc=True).collect()] == [f's {i % 7} <&> "q", é' for i in range(500)]


@pytest.mark.parametrize("text", ['k,s\r\n1,"a ""b""\r\nc"\r\n\r\n2,é€\r\n3\n4,x\r5,"y', "k;s\n1;a"])
def test_csv_of_any_size(spark, tmp_path, monkeypatch, text):
    """Files that cannot be read in splits are read a piece at a time, with the rows that a read as a whole gives."""
    for i, (mark, encoding, options) in enumerate([("", "utf-16-le", {"input_encoding": "utf-16-le"}), ("﻿", "utf-16-be", {}), ("﻿", "utf-8", {"header_offset": 0}), ("", "cp1252", {"input_encoding": "auto", "offset": 0, "header_offset": 0})]):
        path = str(tmp_path / f"{i}.csv")
        (tmp_path / f"{i}.csv").write_bytes((mark + text).encode(encoding))
        want = facade.read_bytes(spark, (mark + text).encode(encoding), "csv", assoc=True, row_id=True, **options).collect()
        with monkeypatch.context() as m:
            m.setattr(frames, "STREAM_BYTES", 1)
            m.setattr(frames, "WHOLE_FILE_BYTES", 1)
            assert facade.read(spark, path, assoc=True, row_id=True, **options).collect() == want


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
@pytest.mark.parametrize("options", [{}, {"stringify_values": False}, {"columns": ["f", "k"]}, {"headers": ["a", "b", "c"]}, {"limit": 70}, {"strict": True}, {"row_id": True}])
def test_workbooks_in_pieces(spark, tmp_path, monkeypatch, kind, options):
    monkeypatch.setattr(staged, "SEGMENT_BYTES", 1 << 12)
    monkeypatch.setattr(staged, "SLICE_ROWS", 50)
    path = str(tmp_path / f"book.{kind}")
    facade.write(numbered(spark), path, assoc=True, shared_strings=True, bold_headers=True)
    want = sorted(map(repr, facade.read(spark, path, assoc=True, **options).collect()))
    monkeypatch.setattr(frames, "SPLIT_BYTES", 0)
    back = facade.read(spark, path, assoc=True, **options)
    assert sorted(map(repr, back.collect())) == want and len(want) in (70, 500, 501)
    assert (back.rdd.getNumPartitions() > 3) == (not options or set(options) <= {"stringify_values", "columns"})


def test_default_limit_is_for_what_unpacks_beyond_measure(monkeypatch):
    info = zipfile.ZipInfo("x")
    info.file_size, info.compress_size = 5_000_000_000, 400_000_000
    package.check_size(info, options.WORKSHEET_SIZE)
    with pytest.raises(InvalidDocument):
        package.check_size(info, options.WORKSHEET_SIZE - 1)
    info.compress_size = 5_000_000
    with pytest.raises(InvalidDocument):
        package.check_size(info, options.WORKSHEET_SIZE)
