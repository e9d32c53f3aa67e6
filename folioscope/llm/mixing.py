"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: The weights of sources in order of name, repeating.
WEIGHTS = [5, 2, 1]
#: Slices of a source's shuffled order: a source's running sum is its slices' sums plus a sum inside the slice, so no task holds a source.
#: More where all rows are more than SLICES * ROWS.
SLICES = 512
#: Rows for which there is a slice, and packets' rows for which there is a partition.
ROWS = 200_000
#: The four hex digits by which rows are sliced tell no more apart.
MOST_SLICES = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Words to take of each source: (source, rank, source_size, target).

    The share of all words is dealt by weight; a source stops at most times its own size and what it leaves goes to
    the others by weight, until none is above. In order of (limit / weight), the sources at their limit are a prefix:
    the level L of the others is (all - limits of the prefix) / (weights of the rest).
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(ordered)).withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
        .withColumn("level", level)
        .withColumn("turn", F.row_number().over(by_limit))
        .withColumn("open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("turn", "level"))).over(every))  # the first that isn't above
        .select("source", "rank", "source_size", F.least("limit", F.coalesce("open.level", F.lit(0.0)) * F.col("weight")).alias("target"))
    )


def mix_sources(docs: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Adds size, source_size, target and taken to documents(doc_id, text, source, ...).

    Each source is a queue of its documents in shuffled order (md5 of seed, doc_id and the text's md5), run through again until most
    times its size. A document copy's virtual finish time is the queue's words so far over the source's target. A copy
    that straddles time 1, when the source has its target, is two packets. Packets are range-sorted over all sources
    by finish time and the mix is cut at the total budget, in the middle of a packet if need be.

    Null or empty text: size and taken 0. Null source: a source, last in order. Null ids shuffle by their texts, as do
    rows of one repeated id. Equal rows each take part, and are told apart by nothing. An empty table gives none. Columns of the input that have the
    names of the four are replaced.
    """
    weights = weights or WEIGHTS
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    copies = -int(-most // 1)
    added = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in added]
    doc = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc")
    rows = docs.select(doc).withColumn("size", word_count(F.col("doc.text"))).withColumn("source", F.col("doc.source"))
    slim = [c for c in kept if c != "text"]
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("doc.text", F.lit("")).cast("binary"))).cast("binary"))
    # The text isn't moved: rows are numbered without it and carry their other columns.
    plain = scratch.save(rows.select(F.struct(*[F.col(f"doc.`{c}`") for c in slim]).alias("doc"), "source", "size", order.alias("key")))
    count = plain.count()
    slices = min(max(SLICES, count // ROWS), MOST_SLICES)
    base = plain.withColumn("slice", F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % slices)
    goal = scratch.save(targets(base, weights, share, most))

    sliced = base.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    by_slice = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.withColumn("offset", F.coalesce(F.sum("words").over(by_slice), F.lit(0))).join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "slice", "offset", "rank", "source_size", "target")
    inside = Window.partitionBy("source", "slice").orderBy("key", "size")
    numbered = base.withColumn("row", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    right = offsets.withColumnRenamed("source", "s").withColumnRenamed("slice", "b")
    queued = scratch.save(
        numbered.join(right, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("b")))
        .select("doc", "size", "source_size", "target", "rank", "slice", "row", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))
    )

    copy = queued.where("size > 0").select("rank", "slice", "row", "size", "target", F.explode(F.array(*[F.lit(i) for i in range(copies)])).alias("copy"), (F.col("start") + F.col("copy") * F.col("source_size")).alias("from"))
    head = F.least(F.greatest(F.floor("target") - F.col("from"), F.lit(0)), F.col("size"))
    packets = (
        copy.withColumn("head", head)
        .select("rank", "slice", "row", F.explode(F.array(F.struct(F.col("head").alias("words"), (F.col("from") + F.col("head")).alias("done")), F.struct((F.col("size") - F.col("head")).alias("words"), (F.col("from") + F.col("size")).alias("done")))).alias("p"), "target")
        .select("rank", "slice", "row", "p.words", (F.col("p.done") / F.col("target")).alias("finish"), "p.done").where("words > 0")
    )
    ranged = scratch.save(packets.repartitionByRange(max(64, copies * count // ROWS), "finish", "rank", "done").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("words").alias("words"))
    whole = totals.withColumn("earlier", F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "earlier")
    budget = goal.agg(F.coalesce(F.round(F.sum("target")), F.lit(0)).cast("long").alias("budget"))
    running = Window.partitionBy("part").orderBy("finish", "rank", "done").rowsBetween(Window.unboundedPreceding, -1)
    served = (
        ranged.withColumn("ahead", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .join(F.broadcast(whole), "part").crossJoin(F.broadcast(budget))  # rows by partition, and one row
        .withColumn("taken", F.least(F.greatest(F.col("budget") - F.col("earlier") - F.col("ahead"), F.lit(0)), F.col("words")))
        .groupBy("rank", "slice", "row").agg(F.sum("taken").alias("taken"))
    )
    done = queued.join(served, ["rank", "slice", "row"], "left").select("doc", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return done.select("doc.*", *added)
