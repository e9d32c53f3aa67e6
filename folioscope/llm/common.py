"""Shared plumbing: table access, scratch tables in the cluster's shared folder, row keys, components."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only in local mode with nothing set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return "/tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Written tables that cut lineage and survive lost executors. Tables still read by a returned
    DataFrame go when the session's process ends; the others by drop()."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}", 0
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        gc.collect()  # shuffle files go once nothing refers to their plan, neither here nor in the JVM
        self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._remove(df._scratch_path)

    def _remove(self, path: str) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM is gone already
            return


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs that name a row by its content; equal rows share them. Null ids and texts count as values."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("k_id"), F.xxhash64(doc_id.isNull(), text.isNull(), doc_id, text).alias("k_text")]


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges(u, v): (node, root), root one of the component's nodes, the same for all of it.

    Randomised contraction: in each round every node goes to the one of the smallest hash, salted by the round, among itself
    and its neighbours, and edges are contracted, until none is left. The expected share of nodes that remain in a round is
    below one in any graph, chains in order of node value included, so rounds follow the logarithm of the number of nodes.
    The maps are then chained. Nothing is collected. Empty edges give an empty table; self-links are ignored.
    """
    left = scratch.save(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    first = left
    maps: list[DataFrame] = []
    while not left.isEmpty():
        drawn = lambda c, salt=len(maps): F.xxhash64(F.lit(salt), c)
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min_by("v", drawn("v")).alias("m"))
        step = scratch.save(near.select(F.col("u").alias("node"), F.when(drawn("m") < drawn("u"), F.col("m")).otherwise(F.col("u")).alias("root")))
        maps.append(step)
        a, b = step.select(F.col("node").alias("u"), F.col("root").alias("ru")), step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = left.join(a, "u").join(b, "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).where("u < v").distinct()
        following = scratch.save(moved)
        if left is not first:
            scratch.drop(left)
        left = following
    if not maps:
        return first.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[0]
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return out
