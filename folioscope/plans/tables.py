"""Queries of sources, sinks, joins, results and jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import results as R
from ..operators import robots
from ..sources import sinks
from ..sources import urls as sources
from ..streaming import jobs
from .queries import RESULTS, result_rows
from .register import query, read

LINES = ["  §\t", "§", "ftp://a.org/x", "", "HTTP://A.org", ",§,", "URL"]


def lines(spark, sf_dir) -> DataFrame:
    """A line for each page: its URL as written in various files."""
    p = read(spark, sf_dir, "pages")
    made = F.element_at(F.array(*map(F.lit, LINES)), (F.col("page_id") % len(LINES) + 1).cast("int"))
    return p.select(F.col("page_id").alias("ord"), F.replace(made, F.lit("§"), F.col("url")).alias("value"))


@query("SELECT 0 AS source, * FROM (VALUES (0::BIGINT, 'https://a.org/1'), (1::BIGINT, 'not a url')) v(ord, url) UNION ALL SELECT 1, page_id, url FROM pages WHERE page_id % 7 IN (0, 1)")
def s1_s2_u5_url_lists(spark, sf_dir):
    return sources.appended(sources.from_args(spark, ["https://a.org/1", "not a url"]), sources.url_lines(lines(spark, sf_dir)))


def sheet(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "pages").orderBy("page_id")
    body = p.select((F.col("page_id") + 10).alias("row"), F.array(F.col("page_id").cast("string"), F.concat(F.lit(" "), F.when(F.col("page_id") % 3 == 0, "none").otherwise(F.col("url")))).alias("cells"))
    head = spark.createDataFrame([(1, ["Id", " Article URL "])], "row long, cells array<string>")
    return body.unionByName(head).unionByName(spark.createDataFrame([(5, ["x"]), (6, [])], "row long, cells array<string>"))


@query("SELECT page_id + 10 AS ord, url FROM pages p WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def s3_s4_u6_sheet_urls(spark, sf_dir):
    return R.not_loaded(sources.url_cells(sheet(spark, sf_dir)), read(spark, sf_dir, "pages").where("page_id % 4 = 0"))


@query("SELECT page_id AS ord, CASE WHEN page_id % 7 = 4 THEN 'HTTP://A.org' ELSE url END AS url FROM pages WHERE page_id % 7 IN (0, 1, 4, 5) ORDER BY page_id LIMIT 50")
def s5_o6_web_lines(spark, sf_dir):
    return sources.web_lines(lines(spark, sf_dir))


@query("SELECT page_id AS ord, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT (SELECT max(page_id) FROM pages WHERE page_id % 2 = 0) + row_number() OVER (ORDER BY url), url FROM (SELECT DISTINCT url FROM pages WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0))")
def s6_added_urls(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url")
    typed = p.where("ord % 2 = 1").select(F.concat(F.lit(" "), "url").alias("url"))
    return sources.added(p.where("ord % 2 = 0"), typed.unionByName(spark.createDataFrame([(" ",)], "url string")))


@query(
    "WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),"
    " f AS (SELECT origin, min(path) AS low, max(path) AS high, count(*) AS n FROM u GROUP BY origin)"
    " SELECT page_id, CASE WHEN length(origin) % 5 = 0 THEN true WHEN n % 2 = 0 THEN starts_with(path, low) OR NOT starts_with(path, '/' || split_part(low, '/', 2) || '/') ELSE starts_with(path, high) OR NOT starts_with(path, left(high, length(high) - 2)) END AS allowed FROM u JOIN f USING (origin)"
)
def s10_f7_j6_robots(spark, sf_dir):
    """A file for each origin, made of its own paths: one keeps a language out but for its first path, one whatever begins as its last path does."""
    from ..functions import urls

    p = read(spark, sf_dir, "pages").select("page_id", "url")
    found = p.groupBy(urls.origin(F.col("url")).alias("origin")).agg(F.min(urls.path(F.col("url"))).alias("low"), F.max(urls.path(F.col("url"))).alias("high"), F.count(F.lit(1)).alias("n"))
    mine = F.concat(F.lit("User-agent: *\nDisallow: /\n\nUser-agent: Folio\nAllow: "), "low", F.lit("\nDisallow: /"), F.split_part("low", F.lit("/"), F.lit(2)), F.lit("/\nAllow: /\n"))
    every = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: "), "high", F.lit("\nDisallow: "), F.expr("left(high, length(high) - 2)"), F.lit(" # all like it\nDisallow:\n"))
    files = found.select("origin", F.when(F.length("origin") % 5 == 0, 404).otherwise(200).alias("status"), F.when(F.col("n") % 2 == 0, mine).otherwise(every).alias("body"))
    return robots.with_robots(p, files, "folio").select("page_id", "allowed")



# ---- results ---------------------------------------------------------------------------------------------------------


def linked_rows(spark, sf_dir) -> DataFrame:
    """Result rows whose social links only some articles of an author have."""
    rows = result_rows(spark, sf_dir)
    n = F.col("ord")
    return rows.withColumn("social_links", F.when(n % 3 == 0, F.array(F.struct(F.lit("github").alias("platform"), F.concat(F.lit("g"), n.cast("string")).alias("url")))).when(n % 3 == 1, F.array().cast("array<struct<platform string, url string>>")))


@query(RESULTS + "SELECT 'https://press.org/a/' || c_custkey AS author_key, 'github: g' || min(ord) FILTER (WHERE ord % 3 = 0) AS social FROM r GROUP BY c_custkey")
def a4_j3_w1_merged_links(spark, sf_dir):
    merged = R.dedupe(linked_rows(spark, sf_dir))
    return merged.select("author_key", F.when(F.size("social_links") > 0, R.social_string(F.col("social_links"))).alias("social"))


@query(RESULTS + "SELECT ord, CASE WHEN ord % 4 = 0 THEN name ELSE 'Page ' || ord END AS name, CASE WHEN ord % 2 = 0 THEN 'p' || ord || '@p.org' ELSE email END AS email FROM r")
def p2_result_merge(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    n = F.col("ord").cast("string")
    page = rows.select("ord", F.concat(F.lit("Page "), n).alias("name"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("p"), n, F.lit("@p.org"))).otherwise("").alias("email"))
    return R.merged(rows.select("ord", "name", "email"), page, "ord")


@query("""SELECT '{"results":[' || string_agg('{"nation":"' || n_name || '","region":' || n_regionkey || '}', ',' ORDER BY n_nationkey) || ']}' AS json FROM nation""")
def k1_json(spark, sf_dir):
    return sinks.to_json(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region")))


@query("""SELECT '{"name":"' || n_name || '"}' AS json FROM nation WHERE n_nationkey = 3""")
def k1_one_result(spark, sf_dir):
    return sinks.to_json(read(spark, sf_dir, "nation").where("n_nationkey = 3").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name")))


@query(RESULTS + ", k AS (SELECT count(*) AS before, count(DISTINCT c_custkey) AS after FROM r) SELECT before, after FROM k")
def a13_dedupe_counts(spark, sf_dir):
    return R.dedupe_counts(result_rows(spark, sf_dir))


@query(RESULTS + "SELECT lower(name) AS name, ord, article_url FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY ord) AS n FROM r WHERE name IS NOT NULL) WHERE n = 1")
def a10_first_of_names(spark, sf_dir):
    rows = result_rows(spark, sf_dir).where("name is not null").withColumn("name", F.lower("name"))
    return R.first_per_key(rows, ["name"], "ord").select("name", "ord", "article_url")


def entries(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("result"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus <> 'O') AS done, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus <> 'O') / count(*) AS percent FROM orders")
def a12_progress(spark, sf_dir):
    return R.progress(entries(spark, sf_dir))


@query("SELECT o_orderkey, 'pending' AS kind FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'completed' FROM orders WHERE o_orderstatus = 'F'")
def f20_f21_entry_filters(spark, sf_dir):
    e = entries(spark, sf_dir)
    return R.pending(e).select("o_orderkey", F.lit("pending").alias("kind")).unionByName(R.completed(e).select("o_orderkey", F.lit("completed").alias("kind")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def j10_without_chosen(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return R.without(c.select("c_custkey", "c_name"), c.where("c_mktsegment = 'BUILDING'"), "c_custkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY CAST(p_size AS VARCHAR), p_partkey) AS place FROM part")
def o7_sorted_as_text(spark, sf_dir):
    """Sorted as text: 10 before 9. The place is read off the sorted rows; ties are told by the key."""
    from pyspark.sql import Window

    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    groups = R.sort_by(p.groupBy("p_size").agg(F.count(F.lit(1)).alias("n")), "p_size")
    before = groups.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each size
    return p.join(before, "p_size").select("p_partkey", (F.col("before") + F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))).alias("place"))


# ---- jobs ------------------------------------------------------------------------------------------------------------


def job_table(spark, sf_dir) -> DataFrame:
    """A job for each user, as its last event leaves it: views are open jobs."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "view", jobs.OPEN).otherwise("completed").alias("status"), "ts", "event_id")
    return jobs.latest(e)


JOBS = "WITH j AS (SELECT user_id AS job_id, CASE WHEN arg_max(event_type, {'t': ts, 'e': event_id}) = 'view' THEN 'processing' ELSE 'completed' END AS status, max(ts) AS ts FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM j) "


@query(JOBS + "SELECT job_id, CASE WHEN status = 'processing' AND epoch_us(now) - epoch_us(ts) > 120000000 THEN 'timeout' ELSE status END AS status, CASE WHEN status = 'processing' AND epoch_us(now) - epoch_us(ts) > 120000000 THEN 'Crawl exceeded maximum time of 120 seconds' END AS error FROM j, n")
def t4_time_limits(spark, sf_dir):
    return jobs.timed_out(job_table(spark, sf_dir)).select("job_id", "status", "error")


@query(JOBS + "SELECT job_id, status, CASE WHEN status = 'processing' THEN round((epoch_us(now) - epoch_us(ts)) / 1e6, 1) ELSE 1.25 END AS elapsed_seconds FROM j, n WHERE job_id IN (1, 2, 3, 5, 8, 13, -1)")
def k4_j5_polled(spark, sf_dir):
    rows = job_table(spark, sf_dir).withColumn("elapsed_seconds", F.when(F.col("status") != jobs.OPEN, 1.25))
    return jobs.polled(rows, [1, 2, 3, 5, 8, 13, -1])


@query("SELECT user_id AS job_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS status, max(ts) AS ts FROM events GROUP BY 1")
def k5_t1_upserts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", "event_id")
    half = lambda odd: jobs.latest(e.where(F.col("event_id") % 2 == odd)).select("job_id", "status", "ts")
    return jobs.upserted(half(0), half(1))


@query(
    "SELECT o_orderkey AS job_id, 'u' || o_orderkey AS url, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'completed' ELSE 'timeout' END AS status, CASE WHEN o_orderkey % 5 NOT IN (0, 1) THEN 'Polling timed out' END AS error FROM orders"
)
def t5_batch_outcomes(spark, sf_dir):
    """Jobs finish after 0, 300, 301 ... seconds; some never."""
    o = read(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    later = F.timestamp_seconds(F.unix_seconds(at) + F.when(F.col("o_orderkey") % 5 == 0, 0).when(F.col("o_orderkey") % 5 == 1, 300).otherwise(301))
    submitted = o.select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"), F.timestamp_seconds(F.unix_seconds(at)).alias("ts"))
    finished = o.where("o_orderkey % 5 <> 4").select(F.col("o_orderkey").alias("job_id"), F.lit("completed").alias("status"), later.alias("ts"))
    return jobs.batch_outcome(submitted, finished)


@query("SELECT c_custkey, replace(replace(replace('<i>' || c_name || '</i>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM customer")
def f53_escaped_names(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.html_escape(F.concat(F.lit("<i>"), "c_name", F.lit("</i>"))).alias("html"))
