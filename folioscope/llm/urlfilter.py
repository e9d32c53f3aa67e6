"""URL filters: host-suffix and path-prefix expressions matched by hash prefix, confirmed by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: A URL is hot if it has 1/HOT of all rows: so many are, at most. Null is a URL here.
HOT = 1024


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", widths: list[int] | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to pages(url, ...).

    rules(host, path, verdict): a rule fits its host and subdomains if the URL's path starts with its path. A URL's
    expressions are its host's suffixes by label, each with its path's prefixes of the lengths that rules have.
    Expressions meet rules on the first 4 bytes of their SHA-256, then by the whole digest. The longest rule wins (host and
    path together), among those the longest host, then block before allow. Without a rule, the verdict is default.

    Distinct URLs are judged, so a hot URL is one row; its verdict is broadcast to its rows, which stay where they are or are
    dealt at random, while all others meet their verdicts by URL. Null urls, and those without `://`, have an empty host and
    path, which no rule fits. Rules with null fields are ignored; of equal rules one counts. Empty tables give none.
    Input columns that have the names of the added ones are replaced. The join to the rules is broadcast by
    Spark if they are under its threshold, else shuffled.
    """
    rules = rules.select("host", "path", "verdict").dropna().dropDuplicates()
    widths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect()) if widths is None else widths
    expression = lambda h, p: F.sha2(F.concat_ws("\x00", h, p).cast("binary"), 256)
    known = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), expression(lower_ascii(F.col("host")), F.col("path")).alias("digest")).withColumn("short", F.substring("digest", 1, 8))

    scratch = Scratch(pages.sparkSession, "urls")
    counted = scratch.save(pages.groupBy(F.col("url").alias("u")).agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    judged = counted.select("u", host(F.col("u")).alias("h"), path(F.col("u")).alias("p"))
    labels = F.split("h", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(w) for w in widths]).cast("array<int>"), lambda w: w <= F.length("p"))
    spread = judged.where("h <> ''").withColumn("suffix", F.explode(suffixes)).withColumn("width", F.explode(lengths)).select("u", expression(F.col("suffix"), F.expr("substring(p, 1, width)")).alias("e"))
    met = spread.withColumn("short", F.substring("e", 1, 8)).join(known, "short").where(F.col("e") == F.col("digest"))
    rank = F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host"), F.col("r_verdict") == "block")
    best = scratch.save(met.groupBy("u").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("best")))
    hot = counted.where(F.col("n") * HOT >= total).select("u").join(best, "u", "left").select(F.col("u").alias("hot_u"), F.lit(True).alias("hot"), F.col("best").alias("hot_best"))
    kept = [F.col(f"p.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("p"))
    rows = rows.join(F.broadcast(hot), F.col("p.url").eqNullSafe(F.col("hot_u")), "left")
    # A hot row has no URL to join on, and a key of its own that spreads it.
    rows = rows.withColumn("key", F.when(F.col("hot").isNull(), F.col("p.url"))).withColumn("deal", F.xxhash64(F.when(F.col("hot").isNull(), F.col("p.url")).otherwise(F.monotonically_increasing_id().cast("string"))))
    met = rows.join(best.withColumn("dealt", F.xxhash64("u")), (F.col("key") == F.col("u")) & (F.col("deal") == F.col("dealt")), "left")
    found = F.coalesce("hot_best", "best")
    return met.select(*kept, host(F.col("p.url")).alias("host"), path(F.col("p.url")).alias("path"), found["rule"].alias("rule"), F.coalesce(found["verdict"], F.lit(default)).alias("verdict"))
