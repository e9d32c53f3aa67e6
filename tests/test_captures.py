"""Capture archives: round trips, foreign and broken ones, filters."""

import gzip

from pyspark.sql import functions as F

from folioscope.sources import captures
from folioscope.sources.captures import read_captures, write_captures


def record(kind, url, body, extra=""):
    body = body if isinstance(body, bytes) else body.encode()
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_round_trip(spark, tmp_path):
    rows = [("https://a.org/1", 200, "text/html", {"x-a": "b"}, b"\x00\xff\r\n\r\nWARC/1.0"), ("http://b.org/", 404, None, None, b""), ("https://a.org/1", 200, None, {"k": "v\r\nw"}, None)]
    df = spark.createDataFrame(rows, "url string, status_code int, content_type string, headers map<string,string>, content binary")
    path = str(tmp_path / "c")
    write_captures(df.repartition(3), path)
    found = read_captures(spark, path)
    assert found.rdd.getNumPartitions() == len(list((tmp_path / "c").glob("*.warc.gz")))
    got = sorted(((r.url, r.status_code, r.content_type, r.headers.get("x-a"), r.headers.get("k"), bytes(r.content)) for r in found.collect()), key=str)
    assert got == sorted([("https://a.org/1", 200, "text/html", "b", None, rows[0][4]), ("http://b.org/", 404, None, None, None, b""), ("https://a.org/1", 200, None, None, "v w", b"")], key=str)
    assert found.where("url = 'http://b.org/'").count() == 1 and found.where(F.col("url").isin("http://b.org/", "x")).count() == 1 and found.where(F.col("url").startswith("https")).count() == 2
    write_captures(df.limit(1), path, overwrite=True)
    assert read_captures(spark, path).count() == 1 and not list((tmp_path / "c").glob("_*"))


def test_foreign_and_broken_archives(spark, tmp_path):
    """Other records are passed over; an archive that breaks off, or isn't one, gives what comes before."""
    answer = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin1\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n<p>é"
    good = record("warcinfo", "", "software: x") + record("request", "http://a.org", "GET /") + record("response", "<http://a.org>", answer, "WARC-Date: 2024-01-02T03:04:05Z\r\n") + record("response", "dns:a.org", "x")
    (tmp_path / "good.warc").write_bytes(good)
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(record("response", f"http://b.org/{i}", "HTTP/1.0 301\r\nLocation: /x\r\n\r\n")) for i in range(3)))
    (tmp_path / "cut.warc").write_bytes(record("response", "http://c.org/1", answer) + record("response", "http://c.org/2", answer)[:-30])
    (tmp_path / "none.warc").write_bytes(b"not an archive\r\n\r\n")
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "other.txt").write_text("x")
    got = {r.url: r for r in read_captures(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["http://a.org", "http://b.org/0", "http://b.org/1", "http://b.org/2", "http://c.org/1"]
    assert str(got["http://a.org"].captured) == "2024-01-02 03:04:05" and bytes(got["http://a.org"].content).decode() == "<p>é" and got["http://a.org"].headers["set-cookie"] == "b" and got["http://b.org/0"].status_code == 301
    assert read_captures(spark, str(tmp_path / "good.warc")).count() == 1


def test_large_records_go_in_small_batches():
    """By bytes as well as by number; none is lost."""
    kinds = captures.pa.schema([("url", "string"), ("captured", captures.pa.timestamp("us", "UTC")), ("status_code", "int32"), ("content_type", "string"), ("headers", captures.pa.map_("string", "string")), ("content", "binary")])
    sizes = [b.num_rows for b in captures._batches(((f"u{i}", None, 200, None, {"a": "b"}, b"x" * (captures.BYTES // 4)) for i in range(10)), kinds)]
    assert sizes == [4, 4, 2] and [b.num_rows for b in captures._batches((("u", None, 200, None, {}, b"") for _ in range(captures.ROWS + 1)), kinds)] == [captures.ROWS, 1]
