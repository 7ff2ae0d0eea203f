"""Web archives: pages written and read back, archives of others, and damaged ones."""

import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

from tidewindow.sources.pages import captured_pages
from tidewindow.sources.warc import WarcReader, read_warc, write_warc

ODD = [("u1", "<p>é</p>\r\n\r\nWARC/1.0\r\n"), ("u2", ""), ("u3", None), (None, "no address"), ("u\r\nWARC-Type: x", "x"), ("u1", "again"), ("long", "ab\n" * 400_000)]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([(k, *r, "other") for k, r in enumerate(ODD)], "page bigint, url string, html string, error string").repartition(3)
    write_warc(rows, path)
    got = [(r["url"], r["html"], r["error"]) for r in read_warc(spark, path).collect()]
    want = [((u or "").replace("\r\n", "%0D%0A") if u is not None else None, h, None) for u, h in ODD]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({r["page"] for r in read_warc(spark, path).collect()}) == len(ODD)
    write_warc(rows.limit(0), path)
    write_warc(rows.filter("url = 'u2'"), path)
    assert read_warc(spark, path).count() == len(ODD) + 1 and not [d for d in os.listdir(path) if d.startswith("_")]
    assert read_warc(spark, path).filter("url = 'u1'").count() == 2 and read_warc(spark, path).filter(F.col("url").isin("u2", "u3")).count() == 3
    assert read_warc(spark, path).filter("url like 'u%' and url <> 'u1'").count() == 4 and read_warc(spark, path).filter("url is null").count() == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "a"
    bad = spark.createDataFrame([("u", "1"), ("v", "x")], "url string, html string").repartition(2, "url").withColumn("html", F.when(F.col("html") == "x", F.raise_error(F.lit("stop"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="stop"):
        write_warc(bad, str(path))
    assert not [f for _, _, fs in os.walk(path) for f in fs if not f.startswith("_") and "/_" not in f and (path / f).exists()]


def record(kind, body, url="u"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2026-01-0{len(url)}T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def response(body, *headers):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(h.encode() + b"\r\n" for h in headers) + b"\r\n" + body


def test_archives_of_others(spark, tmp_path):
    parts = [
        record("warcinfo", b"software: x"), record("request", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", response("é".encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"), "latin"),
        record("response", response(gzip.compress(b"zipped"), "Content-Encoding: gzip"), "gz"),
        record("response", response(b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n", "Transfer-Encoding: chunked"), "chunk"),
        record("response", response(b"not gzip", "Content-Encoding: gzip"), "badgz"),
        record("response", response(b"plain", "Content-Type: text/html; charset=klingon"), "odd"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts))[:-30])
    (tmp_path / "c.warc").write_bytes(parts[2] + b"garbage\r\n")
    (tmp_path / "d.warc").write_bytes(parts[2][:-20])
    (tmp_path / "e.txt").write_text("other")
    rows = read_warc(spark, str(tmp_path)).collect()
    texts = [(r["url"], r["html"]) for r in rows if not r["error"]]
    whole = [("latin", "é"), ("gz", "zipped"), ("chunk", "abcde"), ("odd", "plain")]
    assert sorted(texts) == sorted(whole + whole[:3] + whole[:1])
    broken = sorted(r["error"] for r in rows if r["error"])
    assert len(broken) == 5 and sum(e.startswith(("b.warc.gz", "c.warc", "d.warc")) for e in broken) == 3 and len({r["page"] for r in rows}) == len(rows)
    with pytest.raises(Exception, match="ended before|not a WARC|breaks off"):
        read_warc(spark, str(tmp_path), broken="fail").collect()


def test_last_capture_of_each_source(spark, tmp_path):
    pages = [("u1", "2026-01-02", "new"), ("u1", "2026-01-01", "old"), ("u2", None, "one"), ("u3", "2026-01-01", None)]
    write_warc(spark.createDataFrame(pages, "url string, date string, html string"), str(tmp_path / "a"))
    got = captured_pages(spark, str(tmp_path / "a"), {"a": "u1", "b": "u2", "c": "u3", "d": "u4"})
    assert [got[k].first()["html"] for k in "ab"] == ["new", "one"] and got["c"] is None and got["d"] is None and got["a"].columns == ["page", "url", "html"]


def test_filters_on_addresses_reach_the_reader(tmp_path):
    reader = WarcReader({"path": str(tmp_path)})
    given = [StringStartsWith(("url",), "https://"), EqualTo(("url",), "https://a"), GreaterThan(("page",), 1)]
    assert list(reader.pushFilters(given)) == given  # Spark applies them again
    head = lambda url, kind="resource": {"warc-type": kind} | ({"warc-target-uri": url} if url else {})
    assert [reader._wanted(head(u)) for u in ("https://a", "https://b", "http://a", None)] == [True, False, False, False]
    assert not reader._wanted(head("https://a", "request"))
