"""URL lists from arguments, text files, sheets (CSV and XLSX) and request bodies."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import lists
from ..functions.urls import valid_http
from . import shared

CELLS = "row long, cells array<string>"
REQUEST = "url string, urls array<string>, timeout double, delay double, use_playwright boolean"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def from_args(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(urls)), "ord long, url string")


def url_lines(lines: DataFrame) -> DataFrame:
    """lines(ord, value): trimmed lines that start with http."""
    return lines.select("ord", trimmed(F.col("value")).alias("url")).where(F.col("url").startswith("http"))


def in_order(rows: DataFrame, *columns: Column) -> DataFrame:
    """Rows of files as read, as `ord` and the columns: numbered from 0 in order of file and line, however the files are split and dealt.

    Two passes: one counts the rows of each split, which follow each other in the row ids that Spark gives; the other adds the rows before
    the split to a row's place in it. Only the splits, of 128 MiB each as a rule, are put in order at once."""
    split = ["_file", "_start"]
    read = rows.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    sizes = read.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = read.join(sizes.withColumn("_before", before).drop("_n"), split)
    return out.select((F.col("_before") + F.col("_id") - F.col("_first")).alias("ord"), *[c for c in read.columns if not c.startswith("_")])


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the lines of text files."""
    return in_order(spark.read.text(path), F.col("value"))


def from_text(spark: SparkSession, path: str) -> DataFrame:
    return url_lines(numbered(spark, path))


def url_cells(sheet: DataFrame) -> DataFrame:
    """sheet(row, cells): the column that the least row's header names, else the first; that row never counts. Cells that start with http."""
    head = sheet.agg(F.min("row").alias("head"), F.min_by("cells", "row").alias("names"))
    known = F.transform("names", lambda c: F.array_contains(F.array(*map(F.lit, lists.SHEET_HEADERS)), F.lower(F.trim(F.coalesce(c, F.lit(""))))))
    at = F.greatest(F.array_position(known, True), F.lit(1)).cast("int")
    rows = sheet.crossJoin(F.broadcast(head.select("head", at.alias("at")))).where("row > head")  # one row
    return rows.select(F.col("row").alias("ord"), trimmed(F.try_element_at("cells", F.col("at"))).alias("url")).where(F.col("url").startswith("http"))


def from_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet's URL column; .xlsx workbooks by their first sheet, all else as CSV."""
    if path.lower().endswith(".xlsx"):
        return url_cells(read_xlsx(spark, path))
    sheet = spark.read.option("header", False).csv(path)
    return url_cells(in_order(sheet, F.array(*sheet.columns).alias("cells")).withColumnRenamed("ord", "row"))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(row, cells) of a workbook's first sheet: texts, shared and inline, and numbers as written."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_workbooks, CELLS)


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part of the sheet that the workbook lists first, found by its relation; without a list, the sheet part of the least number."""
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    parts = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= parts:
        listed = [e.get(relation) for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}sheet")]
        targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter("{http://schemas.openxmlformats.org/package/2006/relationships}Relationship")}
        for target in (targets.get(i, "") for i in listed):
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in parts:
                return part
    return min((n for n in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def _workbooks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
    for frame in frames:
        for content in frame.content:
            book = zipfile.ZipFile(io.BytesIO(content))
            shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")] if "xl/sharedStrings.xml" in book.namelist() else []
            rows = []
            for place, row in enumerate(ElementTree.fromstring(book.read(_first_sheet(book))).iter(f"{space}row")):
                cells: list[str | None] = []
                for cell in row.iter(f"{space}c"):
                    at = 0
                    for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    cells += [None] * (at - 1 - len(cells))
                    value = cell.find(f"{space}v")
                    cells.append(text(cell) if cell.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text)
                rows.append((int(row.get("r", place + 1)), cells))
            yield pd.DataFrame(rows, columns=["row", "cells"])


def web_lines(lines: DataFrame, most: int = 50) -> DataFrame:
    """lines(ord, value): blank ones dropped, a header as the first line skipped, one outer comma on either side removed, valid URLs,
    the first so many. Spark keeps only so many rows of each partition."""
    kept = lines.select("ord", trimmed(F.col("value")).alias("value")).where("value <> ''")
    first = kept.orderBy("ord").limit(1).select(F.col("ord").alias("first"))
    header = F.lower("value").isin("url", "urls") & F.col("ord").eqNullSafe(F.col("first"))
    rows = kept.join(F.broadcast(first), F.col("ord") == F.col("first"), "left").where(~header)  # one row
    return rows.select("ord", trimmed(F.regexp_replace("value", "^,|,$", "")).alias("url")).where(valid_http(F.col("url"))).orderBy("ord").limit(most)


def from_web_csv(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    return web_lines(numbered(spark, path), most)


def added(loaded: DataFrame, new: DataFrame) -> DataFrame:
    """loaded(ord, url) with new(url) typed in: trimmed, not blank, not there yet; they follow in order of their text.

    The new ones are sorted by ranges into a table of their own, and the ranges' sizes place each of them."""
    fresh = new.select(trimmed(F.col("url")).alias("url")).where("url <> ''").distinct().join(loaded.select("url"), "url", "left_anti")
    last = loaded.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    return loaded.select("ord", "url").unionByName(_ranked(fresh, "url").crossJoin(F.broadcast(last)).select((F.col("last") + 1 + F.col("place")).alias("ord"), "url"))  # one row


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """Rows with `place`, their rank from 0 by a column of distinct values."""
    spark, path = rows.sparkSession, shared.folder(rows.sparkSession, "ranked")
    rows.repartitionByRange(column).sortWithinPartitions(column).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    run = spark.read.schema(StructType([*rows.schema.fields, StructField("_id", LongType())])).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = run.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = run.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return out.select(*rows.columns, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("place"))


def appended(args: DataFrame, file: DataFrame) -> DataFrame:
    """URLs of the arguments, then those of the file, repeats kept: (source, ord, url)."""
    return args.select(F.lit(0).alias("source"), "ord", "url").unionByName(file.select(F.lit(1).alias("source"), "ord", "url"))


def requests(bodies: DataFrame, most: int = 50, timeout: float = 20.0, delay: float = 1.5) -> DataFrame:
    """bodies(request, value): request bodies with url or urls to (request, place, url, timeout, delay, rendered, error), a row for
    each URL. A batch of more than `most` is rejected as one row; so are bodies that aren't JSON or have an invalid URL."""
    read = bodies.select("request", F.from_json("value", REQUEST).alias("b"))
    every = F.coalesce(F.col("b.urls"), F.array("b.url"))
    wrong = F.exists(every, lambda u: ~valid_http(u))
    error = F.when(F.col("b").isNull() | (F.col("b.url").isNull() & F.col("b.urls").isNull()), "invalid body").when(F.size(every) > most, F.lit(f"Maximum {most} URLs per batch")).when(wrong, "invalid url")
    rows = read.withColumn("error", error).withColumn("all", F.when(F.col("error").isNull(), every).otherwise(F.array(F.lit(None).cast("string"))))
    return rows.select("request", F.posexplode("all").alias("place", "url"), F.coalesce("b.timeout", F.lit(timeout)).alias("timeout"), F.coalesce("b.delay", F.lit(delay)).alias("delay"), F.coalesce("b.use_playwright", F.lit(True)).alias("rendered"), "error")
