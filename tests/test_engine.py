"""What SQL doesn't reach: files, streams, order of rows, and the pages table's own pages."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from folioscope.operators import pages as P
from folioscope.operators import results as R
from folioscope.functions import text
from folioscope.plans.all import QUERIES
from cases_pages import LONG
from folioscope.sources import sinks
from folioscope.sources import urls as sources
from folioscope.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_text_and_sheet_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  https://a.org/1 \nnot one\n\nHTTP://a.org\nhttp://b.org")
    assert [r.url for r in sources.from_text(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()] == ["https://a.org/1", "http://b.org"]
    (tmp_path / "b.csv").write_text('id, LINK \n1, https://a.org/1\n2,none\n3,"https://a.org/3,4"\n')
    assert [r.url for r in sources.from_sheet(spark, str(tmp_path / "b.csv")).orderBy("ord").collect()] == ["https://a.org/1", "https://a.org/3,4"]
    (tmp_path / "c.csv").write_text("Url\n,https://a.org/1,\nurl\nhttps://a.org/2\n" + "http://x.org\n" * 60)
    found = sources.from_web_csv(spark, str(tmp_path / "c.csv")).orderBy("ord").collect()
    assert [r.url for r in found][:3] == ["https://a.org/1", "https://a.org/2", "http://x.org"] and len(found) == 50


def results(spark, n):
    rows = [(i, f"https://p.org/{i}", "success", f"Ann <{i}> & Co", f"https://p.org/a{i}", "x\ny", None, "", "in", "tw", [("github", "g")], "Org", 'The "Town"') for i in range(n)]
    return spark.createDataFrame(rows, "ord long, article_url string, status string, name string, profile_url string, job_title string, bio string, email string, linkedin string, twitter string, social_links array<struct<platform string, url string>>, organization string, location string")


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.xlsx")
    assert sinks.write_workbook(results(spark, 3), path) == 3
    rows = [r.cells for r in sources.read_xlsx(spark, path).orderBy("row").collect()]
    assert rows[0][:4] == ["Article URL", "Status", "Name", "Profile URL"]
    assert rows[1] == ["https://p.org/0", "success", "Ann <0> & Co", "https://p.org/a0", "x\ny", None, None, "in", "tw", "github: g", "Org", 'The "Town"']
    assert [r.url for r in sources.from_sheet(spark, path).orderBy("ord").collect()] == [f"https://p.org/{i}" for i in range(3)]
    assert sinks.write_workbook(results(spark, 0), path) == 0


def test_csv_round_trip(spark, tmp_path):
    sinks.write_csv(results(spark, 2), str(tmp_path / "csv"))
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert {r["Location"] for r in read.collect()} == {'The "Town"'} and "Article URLs" not in read.columns


def test_article_urls_only_where_a_row_has_them(spark):
    rows = results(spark, 2)
    none = rows.withColumn("article_urls", F.array().cast("array<string>"))
    some = rows.withColumn("article_urls", F.when(F.col("ord") == 1, F.array(F.lit("u"), F.lit("v"))))
    assert "Article URLs" not in sinks.export_rows(none).columns
    assert sorted(r["Article URLs"] for r in sinks.export_rows(some).collect()) == ["https://p.org/0", "u; v"]


def test_job_stream(spark, tmp_path):
    """Open jobs end at their limit, finished ones are forgotten; other events move the watermark."""
    schema = "job_id long, status string, ts timestamp, event_id long"
    batches = [[(1, "processing", "2024-01-01 00:00:00", 1), (2, "processing", "2024-01-01 00:00:05", 2)], [(2, "completed", "2024-01-01 00:00:50", 3)], [(9, "processing", "2024-01-01 00:10:00", 4)], [(9, "completed", "2024-01-01 03:00:00", 5)], [(8, "processing", "2024-01-01 06:00:00", 6)], [(8, "completed", "2024-01-01 06:00:01", 7)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(j, s, t, e) for j, s, t, e in rows], "job_id long, status string, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    listener = jobs.Progress()
    spark.streams.addListener(listener)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = jobs.job_stream(events).writeStream.format("memory").queryName("job_changes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert jobs.run_until(query, 120)
    finally:
        spark.streams.removeListener(listener)
    found = [(r.job_id, r.status, str(r.updated)) for r in spark.table("job_changes").collect()]
    assert (1, "timeout", "2024-01-01 00:02:00") in found
    assert (2, "completed", "2024-01-01 00:00:50") in found and (2, "timeout", "2024-01-01 00:02:05") not in found
    assert (2, "expired", "2024-01-01 01:00:50") in found and (1, "expired", "2024-01-01 01:02:00") in found
    assert (9, "completed", "2024-01-01 03:00:00") in found


def test_a_stream_is_cancelled_at_the_deadline(spark, tmp_path):
    query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    assert not jobs.run_until(query, 1.0) and not query.isActive


def test_rows_in_any_order(spark):
    """No result depends on where a row stands."""
    rows = results(spark, 12).withColumn("profile_url", F.lit(None).cast("string")).withColumn("name", F.concat(F.lit("n"), (F.col("ord") % 5).cast("string")))
    merged = [sorted(map(str, R.dedupe(df).collect())) for df in (rows, rows.orderBy(F.desc("ord")).repartition(5))]
    assert merged[0] == merged[1] and len(merged[0]) == 5


def test_crawl_of_odd_tables(spark):
    kinds = "page_id long, url string, html string"
    article = f'<a rel=author href="/authors/a/">Ann</a><p>{LONG * 4}</p>'
    rows = [(1, "https://p.org/1", article), (2, "https://p.org/2", None), (3, "https://p.org/3", ""), (4, None, article), (5, "https://p.org/5", "<p>" * 3000 + article)]
    captured = spark.createDataFrame([("https://p.org/authors/a/", None), ("https://p.org/authors/a/", "<h1>Ann</h1>"), (None, "x")], "url string, html string")
    got = {r.page_id: r.status for r in P.crawl(spark.createDataFrame(rows, kinds), captured).collect()}
    assert got == {1: "success", 2: "no_author_found", 3: "no_author_found", 4: "no_author_page", 5: "success"}
    assert P.crawl(spark.createDataFrame([], kinds), captured).count() == 0
    assert P.crawl(spark.createDataFrame(rows, kinds), captured.where("false")).where("status = 'success'").count() == 0


class Words(HTMLParser):
    """Visible strings, one by one."""

    def __init__(self):
        super().__init__()
        self.out, self.hidden, self.head = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "svg")
        self.head += tag == "head"

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "svg")
        self.head -= tag == "head"

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.out.append((self.head > 0, data.strip()))


def test_real_pages(spark):
    """The pages table's own pages by a second, plain reading."""
    got = {r.page_id: r for r in QUERIES["p1_real_pages"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        reader = Words()
        reader.feed(p.html)
        content = " ".join(s for head, s in reader.out if not head)
        name = re.search(r"<h1>(.*?)</h1>", p.html, re.S)
        assert got[p.page_id].state == ("thin" if len(content) < 200 else "ok"), p.page_id
        if name and "<" not in name[1]:
            plain = " ".join(name[1].replace("&quot;", '"').replace("&amp;", "&").replace("&copy;", "©").replace("&middot;", "·").split())
            assert got[p.page_id].name == (plain if 0 < len(plain) < 80 else None)
        assert got[p.page_id].social == "" and got[p.page_id].organization is None


@pytest.mark.parametrize("name", ["p1_real_pages"])
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_a_code_is_worked_out_once(spark):
    """Not for each of its bytes, however it comes about; and any length of it in time in proportion."""
    rows = spark.createDataFrame([("0041",), ("2a4b6a",), ("00",), ("zz00",), (None,), ("01" + "40" * 50000,), ("ffE9",)], "c string")
    out = rows.repartition(2).select("c", text.decode_hidden_email(F.reverse(F.reverse("c"))).alias("e"))
    assert out._jdf.queryExecution().analyzed().toString().count("reverse(reverse(") == 1
    assert {r.c: r.e for r in out.collect()} == {"0041": "A", "2a4b6a": "a@", "00": None, "zz00": None, None: None, "01" + "40" * 50000: "A" * 50000, "ffE9": "\x16"}


def test_python_gets_only_bytes_of_charsets_that_spark_lacks(spark):
    """Not those in UTF-8 or of Latin sorts, nor those of unknown names; whatever the bytes are, they are read as before."""
    rows = spark.createDataFrame([(b"\xe9\x80", None), (b"\xe9\x81", "no-such"), ("é’".encode(), "ISO-8859-1"), ("日".encode("shift_jis"), "Shift_JIS"), (b"\xff", "utf-8"), (None, "big5")], "b binary, c string")
    found = rows.select("c", text.decode_bytes(F.col("b"), F.col("c")).alias("t"))
    assert [r.t for r in found.collect()] == ["é€", "é\x81", "é’", "日", "ÿ", None]
    assert [text._declared(text.pa.array([b"x", None]), text.pa.array(["no-such", None])).to_pylist()] == [[None, None]]
