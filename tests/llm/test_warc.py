import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from llm_helpers import as_rows

from gridloom.llm import warc as op
from gridloom.llm.common import shared_folder

LONG = "<html>" + "é" * 80


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(7, "http://b.example.com/x?q=1", LONG), (3, "https://www.a.org/", LONG), (9, "http://a.org:80/y#z", LONG), (1, None, "tiny"), (2, "no scheme", "tiny"), (4, "http://[bad", ""), (5, "http://x.net/a b\r\nc", None), (None, "http://x.net/", LONG), (3, "https://www.a.org/", LONG), (6, "http://x.net/é", "y" * 100_000), (None, None, "z" * 200), (8, "http://long.org/" + "x" * 100_000, "short")]
    return spark.createDataFrame([(*r, i, "e") for i, r in enumerate(rows)], "page_id long, url string, html string, digest int, run string")


def test_round_trip(pages):
    got = as_rows(op.warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    want = []
    for i, _, html, *_ in as_rows(pages):
        body = (html or "").encode()
        copy = html == LONG and i != 3
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if copy else "response", 3 if copy else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_histories_are_ordered(spark, pages):
    many = spark.range(500).select((F.col("id") * 7 % 500).alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 5, F.lit(".example.com/"), F.col("id") % 3).alias("url"), F.lit("x").alias("html")).repartition(6)
    rows = op.warc_round_trip(many).collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in rows]
    assert len(rows) == 500 and keys == sorted(keys)


def test_archives_are_gzip_members(spark, pages):
    folder = shared_folder(spark, "warc-test")
    captured = pages.withColumn("captured", F.timestamp_seconds(F.lit(86_400)))
    names = [r[0] for r in op.write_archives(captured, folder).collect()]
    total = 0
    for name in names:
        path = folder.removeprefix("file:") + "/" + name
        whole = gzip.decompress(open(path, "rb").read())
        total += whole.count(b"WARC/1.1\r\n")
        for headers, block, offset in op.records(folder, name):
            assert headers["WARC-Date"] == "1970-01-02T00:00:00Z" and len(block) == int(headers["Content-Length"])
            assert gzip.GzipFile(fileobj=open(path, "rb")) and open(path, "rb").read()[offset : offset + 2] == b"\x1f\x8b"
    assert total == pages.count()


def test_empty(spark):
    assert op.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted((r.randrange(50),) for _ in range(r.randrange(40))) for _ in range(k)]
    assert list(op.LoserTree(map(iter, runs))) == sorted(x for run in runs for x in run)


def test_url_keys():
    assert op.url_key("https://WWW.Example.com:8080/a?b#c") == "com,example,www)/a?b" and op.url_key(None) == "" and op.url_key("http://x.org") == "org,x)/"
