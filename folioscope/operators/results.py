"""Crawl results: merging, flattening, counting. Order is a column, never a row's place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import elapsed
from ..functions.urls import author_key

FILLED = lists.AUTHOR_FIELDS


def dedupe(results: DataFrame, ord_column: str = "ord") -> DataFrame:
    """One row per author: the first, with empty fields from later rows in order, and article_urls, distinct in order.

    Rows without a key stay apart."""
    key = F.coalesce(author_key(F.col("profile_url"), F.col("email"), F.col("name")), F.concat(F.lit("\x00"), F.col(ord_column)))
    kinds = dict(results.dtypes)
    filled = lambda c: F.size(c) > 0 if kinds[c].startswith("array") else F.col(c) != ""
    fields = [c for c in FILLED if c in results.columns]
    first = {"_status": F.struct(ord_column, "status"), "_url": F.struct(ord_column, "article_url")} | {f"_{c}_": F.when(filled(c), F.struct(ord_column, c)) for c in fields}
    # Repeats of an article go before an author's articles come together, so that a list holds distinct ones only.
    articles = results.groupBy(key.alias("author_key"), F.col("article_url").alias("_article")).agg(F.min(ord_column).alias(ord_column), *[F.min(c).alias(n) for n, c in first.items()])
    urls = F.array_sort(F.collect_list(F.struct(ord_column, F.col("_article").alias("url"))))
    return articles.groupBy("author_key").agg(
        F.min(ord_column).alias(ord_column), F.min("_url")["article_url"].alias("article_url"), F.min("_status")["status"].alias("status"), *[F.min(f"_{c}_")[c].alias(c) for c in fields],
        F.transform(urls, lambda s: s["url"]).alias("article_urls"),
    )


def joined(rows: DataFrame, by: list[str], columns: list[str], ord_column: str = "ord") -> DataFrame:
    """Each column's non-empty values by group, in order, joined by "; ", duplicates kept."""
    def one(c: str) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct(F.col(ord_column), F.col(c).alias("v")))))
        return F.array_join(F.transform(kept, lambda s: s["v"]), "; ").alias(c)

    return rows.groupBy(*by).agg(*[one(c) for c in columns])


def first_per_key(rows: DataFrame, keys: list[str], ord_column: str, most: int = 1) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(ord_column))).where(F.col("_r") <= most).drop("_r")


def status_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(~F.col("status").eqNullSafe("success")).alias("failed"))


def not_loaded(new: DataFrame, loaded: DataFrame) -> DataFrame:
    return new.join(loaded.select("url"), "url", "left_anti")


def social_string(links: Column) -> Column:
    return F.array_join(F.transform(links, lambda s: F.concat(s["platform"], F.lit(": "), s["url"])), "; ")


def merged(found: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """Article-page records with what their profile pages add: non-empty fields of the page, but for the name, where the article's stands."""
    fields = [f for f in lists.AUTHOR_FIELDS if f in page.columns and f in found.columns]
    kinds = dict(found.dtypes)
    full = lambda f: F.when(F.size(f"p.{f}") > 0, F.col(f"p.{f}")) if kinds[f].startswith("array") else F.when(F.col(f"p.{f}") != "", F.col(f"p.{f}"))
    pick = lambda f: F.coalesce(F.when(F.col("a.name") != "", F.col("a.name")), full(f)) if f == "name" else F.coalesce(full(f), F.col(f"a.{f}"))
    others = [F.col(f"a.{c}") for c in found.columns if c not in fields]
    return found.alias("a").join(page.alias("p"), F.col(f"a.{key}") == F.col(f"p.{key}"), "left").select(*others, *[pick(f).alias(f) for f in fields])


def api_shape(results: DataFrame) -> DataFrame:
    """job_id and one result as the service gives it: article_url, author, authors, status, error and elapsed seconds to hundredths."""
    author = F.struct(*[F.col(f) for f in lists.AUTHOR_FIELDS if f in results.columns]).alias("author")
    several = F.col("authors") if "authors" in results.columns else F.array()
    return results.select("job_id", F.struct("article_url", author, F.coalesce(several, F.array().cast(results.schema["authors"].dataType) if "authors" in results.columns else F.array()).alias("authors"), "status", "error", elapsed(F.col("elapsed_seconds"), F.lit(False)).alias("elapsed_seconds")).alias("result"))


def progress(entries: DataFrame) -> DataFrame:
    """done, total and percent of entries(status); pending ones aren't done."""
    done = F.count_if(F.col("status") != "pending")
    return entries.agg(done.alias("done"), F.count(F.lit(1)).alias("total"), F.when(F.count(F.lit(1)) > 0, 100.0 * done / F.count(F.lit(1))).otherwise(0.0).alias("percent"))


def pending(entries: DataFrame) -> DataFrame:
    return entries.where("status = 'pending'")


def completed(entries: DataFrame) -> DataFrame:
    """Entries that have a result."""
    return entries.where("result is not null")


def dedupe_counts(results: DataFrame, ord_column: str = "ord") -> DataFrame:
    """Rows before and after dedupe, in one pass: rows without a key stay apart."""
    key = author_key(F.col("profile_url"), F.col("email"), F.col("name"))
    return results.agg(F.count(F.lit(1)).alias("before"), (F.count_distinct(key) + F.count_if(key.isNull())).alias("after"))


def without(entries: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Entries minus the chosen ones."""
    return entries.join(chosen.select(key), key, "left_anti")


def sort_by(entries: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Ordered by a column as text, empty ones first."""
    c = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return entries.orderBy(c.asc() if ascending else c.desc())
