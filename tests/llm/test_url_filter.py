import duckdb
import pandas as pd
import pytest
from llm_helpers import as_rows

from gridloom.llm import url_filter as op


@pytest.fixture(scope="module")
def tables(spark):
    urls = [None, "nothing", "http://A.Example.NET/en/x?q#f", "http://example.net", "http://example.net/", "https://x.example.com/de/y", "http://foo.org/fr/", "http://foo.org/frx", "http://net/z", "http://internet/z", "ftp://u@h.co.uk:81/p?x://y", "http://?x", "http://ÄB.org/", "a://b://c/d"]
    urls += [f"http://bad.spam.example.com/{i}" for i in range(40)] + [f"http://good.example.com/{i}" for i in range(40)] + [f"http://h{i}.few.io/" for i in range(10)]
    urls += [f"http://{h}/" for h in ("a.b.com.cn", "c.b.com.cn", "d.com.cn", "x.gov.uk", "192.168.1.1", "192.168.1.2:80", "10.0.1.1", "[::1]:8080", "u@e.f.co.kr.", "1.2.3.4.5", "com.cn", "com.de", "x" * 100_000 + ".example.org") for _ in range(3)]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls, "html": "x", "host": "clash", "verdict": "clash"})
    labels = pd.DataFrame([(i, int("bad" not in (u or "")), 0) for i, u in enumerate(urls) if i % 3] + [(20, 0, 1), (999, 1, 0)], columns=["doc_id", "quality", "toxic"])
    return pages, labels


def test_against_sql(spark, tables):
    pages, labels = tables
    db = duckdb.connect()
    db.register("pages", pages)
    db.register("labels", labels)
    want = sorted(map(str, db.execute("SELECT page_id, host, path, rule, verdict FROM (" + op.ORACLE + ")").fetchall()))
    p = spark.createDataFrame(pages.astype(object).where(pages.notna(), None).values.tolist(), "page_id long, url string, html string, host string, verdict string")
    got = op.url_filter(p, op.page_outcomes(spark.createDataFrame(labels)))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    verdicts = {r["host"]: r["verdict"] for r in got.collect()}
    assert verdicts["bad.spam.example.com"] == "block" and verdicts["good.example.com"] == "allow" and verdicts["foo.org"] == "allow" and verdicts[""] == "allow"


def test_parts_of_urls(spark, tables):
    rows = {r["url"]: (r["host"], r["path"], r["rule"]) for r in op.split_url(spark.createDataFrame([(u,) for u in tables[0]["url"] if u] + [(None,)], "url string")).withColumn("rule", op.rule_columns()[0]).collect()}
    assert rows["http://A.Example.NET/en/x?q#f"] == ("a.example.net", "/en/x", "example.net/en/") and rows["http://example.net"] == ("example.net", "", None)
    assert rows["ftp://u@h.co.uk:81/p?x://y"] == ("u@h.co.uk:81", "/p", None) and rows["http://?x"] == ("", "", None) and rows[None] == ("", "", None) and rows["http://ÄB.org/"][0] == "Äb.org" and rows["a://b://c/d"][:2] == ("b:", "//c/d")
    assert rows["http://net/z"][2] == "net/" and rows["http://internet/z"][2] is None


def test_levels(spark):
    from pyspark.sql import functions as F

    hosts = {"a.b.com.cn": ("b.com.cn", "com.cn"), "www.x.gov.uk": ("x.gov.uk", "gov.uk"), "192.168.1.1:80": ("192.168.1.1", "#"), "[::1]:8080": ("[::1]", "#"), "u@a.b.de.": ("b.de", "de"), "b.com": ("b.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""), "com.cn": ("com.cn", "com.cn"), "x.y.city.jp": ("city.jp", "jp"), "1.2.3.4.5": ("4.5", "5")}
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *op._levels(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == hosts
    more = spark.createDataFrame([("x.y.city.jp",)], "host string").select(*op._levels(F.col("host"), ("city.jp",))).first()
    assert tuple(more) == ("y.city.jp", "city.jp")


def test_shrinkage(spark):
    rows = [("big.bad.com", 1)] * 50 + [("new.bad.com", None)] + [("big.good.com", 0)] * 50 + [("one.good.com", 1)]
    by = {r["host"]: r for r in op.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert by["big.bad.com"]["lower"] > 0.8 and by["new.bad.com"]["bad_rate"] > by["one.good.com"]["bad_rate"] and by["new.bad.com"]["n"] == 0 and by["big.good.com"]["bad_rate"] < 0.1


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    assert op.url_filter(pages, labels).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c", None), (None, None, None), (1, "http://a.b/c", None)], pages.schema)
    assert {r[4] for r in as_rows(op.url_filter(one, labels))} == {"allow"} and op.url_filter(one, labels).count() == 3
