"""Sharding by minimax contiguous partition of atomic groups of equal texts."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A group of 1/LARGE of all bytes or more is placed by size, before the rest; there are LARGE of them at most.
LARGE = 4096
#: Hex digits by which the order's resolution grows in a pass: so many figures come to the driver for each open place.
DIGITS = 3


def fill(capacity: int, sums: list[int], shards: int) -> tuple[list[int], bool]:
    """Greedy check: knots at which to cut so that no shard exceeds capacity, and whether shards are enough. sums: running
    sums at the knots, from 0."""
    cuts, at = [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity, at) - 1
        cuts.append(at)
        if at == len(sums) - 1:
            return cuts, True
    return cuts, False


def smallest_capacity(sums: list[int], shards: int) -> int:
    low, high = max(-(-sums[-1] // shards), max((b - a for a, b in zip(sums, sums[1:])), default=0)), sums[-1]
    while low < high:
        mid = (low + high) // 2
        if fill(mid, sums, shards)[1]:
            high = mid
        else:
            low = mid + 1
    return low


def text_digest(text: Column) -> Column:
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null"))


def place_cuts(groups: DataFrame, shards: int) -> tuple[dict[str, int], list[str]]:
    """(shards of the large groups by digest, keys at which later shards begin).

    groups(digest, bytes) in the order: large ones by falling size, then all others by digest. The running sums at a
    set of knots are known exactly; a knot interval that holds a cut is opened by further hex digits until it
    is one group. In each pass the binary search and its greedy check run over the knots known so far, an unopened
    interval counting as one atomic group; the search ends when the intervals next to all cuts are single groups, and so
    are those next to the cuts of the check that fails at one byte less: it then fails over all groups, too.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    if not total:
        return {}, []
    large = sorted(((r.bytes, r.digest) for r in groups.where(F.col("bytes") * LARGE >= total).collect()), reverse=True)
    rest = groups.where(F.col("bytes") * LARGE < total)

    def opened(prefixes: list[str], width: int) -> dict[str, tuple[int, int]]:
        inner = rest.withColumn("k", F.substring("digest", 1, width + DIGITS))
        inner = inner.where(F.substring("k", 1, width).isin(prefixes)) if width else inner
        return {r.k: (r.b, r.n) for r in inner.groupBy("k").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()}

    knots = opened([], 0)
    while True:
        keys = sorted(knots)
        sums = [0]
        for b in [b for b, _ in large] + [knots[k][0] for k in keys]:
            sums.append(sums[-1] + b)
        capacity = smallest_capacity(sums, shards)
        cuts, _ = fill(capacity, sums, shards)
        less = fill(capacity - 1, sums, shards)[0] if capacity * shards >= sums[-1] + shards else []
        near = {keys[c + d - len(large)] for c in cuts + less for d in (-1, 0) if 0 <= c + d - len(large) < len(keys)}
        coarse = [k for k in near if knots[k][1] > 1]
        if not coarse:
            break
        width = min(map(len, coarse))
        coarse = [k for k in coarse if len(k) == width]
        finer = opened(coarse, width)
        for k in coarse:
            del knots[k]
        knots |= finer
    of_large = {d: sum(i >= c for c in cuts[:-1]) for i, (_, d) in enumerate(large)}
    return of_large, [keys[c - len(large)] if c - len(large) < len(keys) else "~" for c in (max(c, len(large)) for c in cuts[:-1])]


def shard_documents(docs: DataFrame, shards: int = 16, slices: int = 256) -> DataFrame:
    """Adds size, text_crc32, law ("bytes"), shard, slot and grown_shard (null) to documents(doc_id, text, ...).

    Size is the UTF-8 bytes plus 1. Rows of equal text are one atomic group (null texts too: apart from empty ones).
    Groups lie in one order; shards are contiguous in it and their largest is as small as the order allows, so sizes
    are equal but for a group, and a shard is above the mean only where one group is. Slots count each shard's rows
    from 0, in an order mixed by (doc_id, text), not by group, so that a hot group is spread over the slices.

    Null ids are values like others; repeated rows are each placed; an empty table gives none; input columns that
    have the names of the added ones are replaced.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c not in added]
    doc = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc")
    text = F.col("doc.text")
    rows = docs.select(doc).select(
        "doc", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_digest(text).alias("digest")
    )
    scratch = Scratch(docs.sparkSession, "shards")
    groups = scratch.save(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    of_large, starts = place_cuts(groups, shards)
    scratch.drop(groups)
    by_order = sum((F.when(F.col("digest") >= s, 1).otherwise(0) for s in starts), F.lit(0)) if starts else F.lit(0)
    if of_large:
        found = F.create_map(*[F.lit(x) for pair in of_large.items() for x in pair])  # LARGE entries at most
        by_order = F.coalesce(F.try_element_at(found, F.col("digest")), by_order)
    placed = rows.withColumn("shard", by_order.cast("int")).withColumn("slice", F.pmod(F.xxhash64("doc.doc_id", "digest"), F.lit(slices)).cast("int"))
    counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "slice", "before")
    inside = Window.partitionBy("shard", "slice").orderBy("doc.doc_id", "digest")
    return (
        placed.withColumn("row", F.row_number().over(inside))
        .join(F.broadcast(before), ["shard", "slice"])  # shards x slices rows
        .select("doc.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("row") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, rows: int = 100_000) -> None:
    """The placed documents as Parquet, a folder for each shard. A shard's slots lie in runs of so many rows, each in one
    file and in order, so that no task holds a shard."""
    shard_documents(docs, shards).repartition("shard", F.floor(F.col("slot") / rows)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
