import pytest
from pyspark.sql import functions as F

from gridloom import facade
from gridloom.errors import InvalidDocument, InvalidRow, MissingColumn, UnsupportedFormat
from gridloom.operators import transforms as X
from gridloom.options import make_options
from gridloom.rowid import with_row_id
from gridloom.sources.csv import detect_encoding, detect_separator
from gridloom.sources.files import check_path, ensure_extension, sniff
from gridloom.sources.frames import read_csv_splits


def read(spark, text, **options):
    content = text if isinstance(text, bytes) else text.encode()
    return facade.read_bytes(spark, content, "csv", **options)


def rows(df):
    return [tuple(r) for r in df.collect()]


def dicts(df):
    return [r.asDict(True) for r in df.collect()]


def test_pad_and_truncate(spark):
    df = read(spark, "id,name,email\n1,John\n2,Jane,jane@example.com,extra", assoc=True)
    assert dicts(df) == [{"id": "1", "name": "John", "email": None}, {"id": "2", "name": "Jane", "email": "jane@example.com"}]


def test_plain_and_blank_lines(spark):
    text = "id,name\n1,a\n\n2,b\n  \n"
    assert rows(read(spark, text)) == [("id", "name"), ("1", "a"), ("2", "b"), ("  ", None)]
    assert rows(read(spark, text, skip_empty_lines=False))[2] == (None, None)
    assert rows(read(spark, "", skip_empty_lines=False)) == [] and read(spark, "", assoc=True).columns == []
    assert rows(read(spark, 'a,b\n,""\n', assoc=True)) == [("", "")]


def test_offset_limit(spark):
    text = "h\n" + "\n".join(map(str, range(10)))
    assert rows(read(spark, text, assoc=True, offset=2, limit=3)) == [("2",), ("3",), ("4",)]
    assert rows(read(spark, text, assoc=True, limit=0)) == []
    with pytest.raises(MissingColumn):
        read(spark, text, assoc=True, limit=0, required_columns=["x"])


def test_strict(spark):
    with pytest.raises(InvalidRow, match="expected 3"):
        read(spark, "a,b,c\n1,2", strict=True)
    with pytest.raises(InvalidRow, match="Row 1 has 2 columns, expected 3"):
        read(spark, "1,John\n2,Jane,Doe\n", strict=True, headers=["id", "first", "last"], assoc=True)
    with pytest.raises(InvalidRow, match="unclosed quote"):
        read(spark, 'col1,col2\n"unclosed,quote\nrow2,data', strict=True)


def test_header_problems(spark):
    with pytest.raises(InvalidDocument, match="Duplicate header"):
        read(spark, "id,name,name\n1,John,Doe\n", assoc=True)
    with pytest.raises(InvalidDocument, match="Duplicate header"):
        read(spark, "1,2\n", headers=["a", "a"])
    with pytest.raises(MissingColumn) as e:
        read(spark, "a,b\n1,2\n", assoc=True, required_columns=["a", "x", "y"])
    assert e.value.columns == ["x", "y"]
    assert read(spark, "Name,name\n1,2\n", assoc=True).columns == ["Name", "name"]


def test_header_search(spark):
    text = "Export clients - 2026\nGenerated by Foo\n\nFirst Name,Email\nJohn,john@example.com\n"
    assert dicts(read(spark, text, assoc=True, header_offset="auto", required_columns=["First Name", "Email"])) == [{"First Name": "John", "Email": "john@example.com"}]
    nested = "Report Title\nGenerated 2026\n\nPerson,\nFirst Name,Email\nJohn,john@example.com\n"
    df = read(spark, nested, assoc=True, header_offset="auto", header_rows=2, required_columns={"Person": ["First Name"]})
    assert dicts(df) == [{"Person": {"First Name": "John", "Email": "john@example.com"}}]
    assert rows(read(spark, "Skip me\nAlso skip\nFirst Name,Email\nJohn,x\n", assoc=True, header_offset=2)) == [("John", "x")]
    with pytest.raises(InvalidDocument, match="Could not auto-detect"):
        read(spark, "Title\nOther\nName,Email\nJohn,x", assoc=True, header_offset="auto", required_columns=["Phone"])
    with pytest.raises(ValueError):
        read(spark, "a\n", assoc=True, header_offset="auto").collect()


def test_hierarchy_and_selection(spark):
    text = "Person,,\nFirst Name,Last Name,Email\nJohn,Doe,j@x\n"
    assert dicts(read(spark, text, assoc=True, header_rows=2)) == [{"Person": {"First Name": "John", "Last Name": "Doe", "Email": "j@x"}}]
    assert dicts(read(spark, text, assoc=True, header_rows=2, columns={"Person": ["Last Name", "Email"]})) == [{"Person": {"Last Name": "Doe", "Email": "j@x"}}]
    df = read(spark, '" First Name "," Email ",Age\nJohn,j@x,30', assoc=True, header_normalizer=lambda s: s.strip().lower(), columns=["email", "first name"], aliases={"email": "email_addr"})
    assert df.columns == ["email_addr", "first name"] and rows(df) == [("j@x", "John")]


def test_separators(spark):
    assert [detect_separator(s) for s in ("a,b;c", "", "a;b;c", "a|b", "a\tb", '"a,b,c";d')] == [",", ",", ";", "|", "\t", ";"]
    assert detect_separator("\n" * 9 + "a;b\nc;d,e") == ";"
    assert rows(read(spark, '"john""john";doe;x')) == [('john"john', "doe", "x")]
    assert rows(read(spark, "a'b;c'd", separator=";", enclosure="'")) == [("a'b", "c'd")]


@pytest.mark.parametrize("mark,encoding", [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xfe\xff", "utf-16-be")])
def test_marks(spark, mark, encoding):
    content = mark + "name,email\njohn,é".encode(encoding)
    assert dicts(read(spark, content, assoc=True)) == [{"name": "john", "email": "é"}]
    if encoding != "utf-8":
        with pytest.raises(InvalidDocument, match="Cannot parse UTF-"):
            read(spark, content, assoc=True, transcode_bom_input=False)


def test_encodings(spark):
    assert rows(read(spark, "é,à".encode("latin-1"), input_encoding="auto", output_encoding="UTF-8")) == [("é", "à")]
    assert detect_encoding("x€".encode("cp1252")) == "cp1252" and detect_encoding("abc".encode()) == "utf-8"
    assert rows(read(spark, "x€".encode("cp1252"), input_encoding="windows-1252")) == [("x€",)]
    with pytest.raises(ValueError):
        facade.write_bytes(spark.range(1), "csv", output_encoding="utf-16-le")


def test_write(spark):
    df = with_row_id(spark.createDataFrame([(1, "foo\\", True, None), (2, 'all"three\n,together', False, 1.5), (3, "=SUM(A1:A10)", None, 2.0)], "i int, t string, b boolean, f double"), "i")
    content = facade.write_bytes(df, "csv", headers=["i", "t", "b", "f"], bom=False)
    assert content.decode() == 'i,t,b,f\r\n1,foo\\,1,\r\n2,"all""three\n,together",0,1.5\r\n3,=SUM(A1:A10),,2\r\n'
    assert dicts(read(spark, content, assoc=True))[1]["t"] == 'all"three\n,together'
    assert b"'=SUM(A1:A10)" in facade.write_bytes(df, "csv", escape_formulas=True)
    assert b"!=SUM" in facade.write_bytes(df, "csv", escape_formulas=lambda c, i: F.concat(F.lit("!"), c))
    assert not facade.write_bytes(df, "csv", bom=False).startswith(b"i,t")
    assert facade.write_bytes(df, "csv").startswith(b"\xef\xbb\xbf")
    with pytest.raises(InvalidRow):
        facade.write_bytes(df, "csv", headers=["a", "b"], strict=True)


def test_nested_write(spark):
    df = spark.createDataFrame([(("1", "a"), "x")], "P struct<id:string,n:string>, note string")
    content = facade.write_bytes(df, "csv", headers={"P": ["id", "n"], "note": None}, bom=False)
    assert content.decode() == "P,,note\r\nid,n,\r\n1,a,x\r\n"
    assert dicts(read(spark, content, assoc=True, header_rows=2)) == [{"P": {"id": "1", "n": "a"}, "note": "x"}]


def test_splits(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id;name;n\n1;"a ""q""";\n2;b\n3;c;d;e\n')
    df = read_csv_splits(spark, str(path), make_options(assoc=True, columns=["n", "id"], aliases={"n": "m"}))
    assert df.columns == ["m", "id"] and sorted(rows(df), key=lambda r: r[1]) == [("", "1"), (None, "2"), ("d", "3")]
    plain = read_csv_splits(spark, str(path), make_options(columns=["x"]))
    assert plain.count() == 4
    with pytest.raises(Exception, match="another number of columns"):
        read_csv_splits(spark, str(path), make_options(assoc=True, strict=True)).collect()


def test_splits_of_files_with_other_headers(spark, tmp_path):
    for i, (bom, eol) in enumerate([("", "\n"), ("\ufeff", "\r\n"), ("\n", "\n")]):
        (tmp_path / f"p{i}.csv").write_bytes(f"{bom}a,b{eol}{i},x{eol}".encode())
    df = read_csv_splits(spark, str(tmp_path), make_options(assoc=True))
    assert df.columns == ["a", "b"] and sorted(r["a"] for r in df.collect()) == ["0", "1", "2"]
    for header in ("b,a", "a,c", "a;b"):
        (tmp_path / "p3.csv").write_text(f"{header}\n1,2\n")
        with pytest.raises(InvalidDocument, match="different headers"):
            read_csv_splits(spark, str(tmp_path), make_options(assoc=True))
        given = read_csv_splits(spark, str(tmp_path), make_options(assoc=True, headers=["a", "b"], separator=","))
        assert given.columns == ["a", "b"]


def test_folder_and_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_text(f"a,b\n{i},x\n{i + 10},y\n")
    df = facade.read(spark, str(tmp_path / "*.csv"), assoc=True, row_id=True, file_column=True)
    assert df.columns == ["_file", "_row_id", "a", "b"] and df.count() == 6 and {r["_row_id"] for r in df.collect()} == {0, 1}
    (tmp_path / "p3.csv").write_text("a,c\n1,2\n")
    with pytest.raises(InvalidDocument, match="different headers"):
        facade.read(spark, str(tmp_path / "*.csv"), assoc=True)


def test_facade(spark, tmp_path):
    with pytest.raises(UnsupportedFormat):
        facade.read(spark, "x.xls")
    with pytest.raises(UnsupportedFormat):
        facade.reader("doc")
    for bad in ("phar://x.csv", "http://x/y.csv", "php://filter/x", "data:text/plain,a"):
        with pytest.raises(ValueError):
            check_path(bad)
    assert check_path("s3a://b/x.csv") and check_path("/tmp/x.csv")
    assert sniff(b"PK\x03\x04....mimetypeapplication/vnd.oasis.opendocument.spreadsheet") == "ods" and sniff(b"PK\x03\x04") == "xlsx" and sniff(b"a,b") == "csv"
    assert ensure_extension("x", "csv") == "x.csv" and ensure_extension("x.CSV", "csv") == "x.CSV"
    df = spark.createDataFrame([("1", "a")], "i string, t string")
    media, headers, chunks = facade.download(df, "report", "csv", bom=False)
    assert media == "text/csv" and "report.csv" in headers["Content-Disposition"] and b"".join(chunks) == b"1,a\r\n"
    path = tmp_path / "noextension"
    path.write_bytes(b"".join(facade.download(df, "r", "csv", bom=False)[2]))
    assert rows(facade.read(spark, str(path))) == [("1", "a")]
    assert rows(facade.reader("CSV")(spark, facade.writer("csv")(df, str(tmp_path / "w.csv")))) == [("1", "a")]
    assert rows(read(spark, "1,2\n", assoc=True, headers=["x", "y"]).transform(X.cast({"x": "int"}))) == [(1, "2")]


def test_option_checks():
    for bad in ({"offset": -1}, {"limit": -1}, {"separator": "ab"}, {"enclosure": ""}, {"escape": "xx"}, {"max_worksheet_size": 0}, {"header_offset": -1}, {"header_rows": 0}):
        with pytest.raises(ValueError):
            make_options(**bad)


PLAIN = ["a,b,c\n1,2,3\n", "a,b,c\r\n1,,\r\n,2\r\n", "\ufeffa,b\n1,2\n\n3,4,5\n6\n", 'a;b\n"x;""y""";\n"";z\n""""\n"""q";"r"""\n', "a\tb\nü\t日本\n", 'a,b\n"1,1","2"\n3,"4,"""']
OTHER = ['a,b\n"1\n2",3\n', 'a,b\nx"y,2\n', "a,b\n1\r2,3\n", "a,b\n   \n1,2\n", 'a,b\n1,x""y\n', 'a,b\n"x"y,2\n', "a,b\n\x00,2\n"]


@pytest.mark.parametrize("text", PLAIN + OTHER)
def test_split_and_whole_reads_agree(spark, tmp_path, text):
    from gridloom.sources import frames

    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    for options in ({"assoc": True}, {}, {"assoc": True, "headers": ["p", "q"]}):
        whole = read(spark, text, row_id=True, **options)
        got = facade.read(spark, str(path), row_id=True, **options)
        assert got.columns == whole.columns and sorted(rows(got), key=str) == sorted(rows(whole), key=str)
    layout = frames.split_layout(spark, [str(path)], frames.file_heads(spark, [path.as_uri()]), make_options(assoc=True))
    assert (layout is not None) == (text in PLAIN)


NO_UTF8 = [b"k,v\r\n1,R\xe9x\xf1\r\n", b"k,v\n1,R\xe9\n", b"k,v\r\n1,x\xe9\r\n", b"k,v\r\n1,x\r\n\xe9\r\n", b"k,v\r\n1,x\xf1\r", b"k\xe9,v\r\n1,x\r\n", b"k,v\n1,\x80\n", b"k,v\n1,\xed\xa0\x80\n", b"k,v\n1,x\xc3"]


@pytest.mark.parametrize("content", NO_UTF8)
def test_files_of_other_bytes_than_utf8_are_read_whole(spark, tmp_path, content):
    from gridloom.sources import frames

    path = tmp_path / "x.csv"
    path.write_bytes(content)
    for options in ({"assoc": True, "input_encoding": "auto"}, {"input_encoding": "auto"}, {"assoc": True}, {"input_encoding": "utf-8"}):
        whole = read(spark, content, row_id=True, **options)
        got = facade.read(spark, str(path), row_id=True, **options)
        assert got.columns == whole.columns and rows(got) == rows(whole)
    assert frames.split_layout(spark, [str(path)], frames.file_heads(spark, [path.as_uri()]), make_options(assoc=True)) is None


def test_files_of_several_encodings(spark, tmp_path):
    for i, encoding in enumerate(("utf-8", "latin-1", "cp1252")):
        (tmp_path / f"{i}.csv").write_bytes(f"k,v\r\n{i},Ré{'€' if encoding == 'cp1252' else 'ñ'}\r\n".encode(encoding))
    assert sorted(rows(facade.read(spark, str(tmp_path), format="csv", assoc=True, input_encoding="auto"))) == [("0", "Réñ"), ("1", "Réñ"), ("2", "Ré€")]


def test_a_replacement_sign_of_its_own_is_read_in_splits(spark, tmp_path):
    from gridloom.sources import frames

    path = tmp_path / "x.csv"
    path.write_bytes("k,v\r\n1,R\ufffd\r\n".encode())
    assert rows(facade.read(spark, str(path), assoc=True)) == [("1", "R\ufffd")]
    assert frames.split_layout(spark, [str(path)], frames.file_heads(spark, [path.as_uri()]), make_options(assoc=True)) is not None


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("i,t\n" + "".join(f'{i},"t ""{i}"", x"\n' for i in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = facade.read(spark, str(path), assoc=True, row_id=True, file_column=True)
        assert sorted((r["_row_id"], r["i"], r["t"]) for r in df.collect()) == [(i, str(i), f't "{i}", x') for i in range(40_000)]
        assert facade.read(spark, str(path), assoc=True).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_that_no_way_reads(spark, tmp_path, monkeypatch):
    from gridloom.sources import frames

    monkeypatch.setattr(frames, "WHOLE_FILE_BYTES", 10)
    (tmp_path / "x.csv").write_text('a,b\n"1\n2",3\n')
    with pytest.raises(InvalidDocument, match="bytes"):
        facade.read(spark, str(tmp_path / "x.csv"), assoc=True)
