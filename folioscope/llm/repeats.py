"""Removal of repeated byte strings by prefix doubling.

Positions are sampled by content, so that copies of a string are sampled at the same places. Spark sorts the pairs of a position's
rank and the name of the bytes at a growing offset, gives the sorted pairs new ranks and drops the unique ones, until the ranks
tell strings as long as every repeat must have. The edges of repeats are then resolved byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACED, U64, byte_values, chunks, mix, prefix, raw, sha_hex, spans_hash
from .common import Scratch, row_key

VALUES = byte_values(53, fold=False)
#: Bytes of a string whose hash decides which positions are sampled.
SEED_BYTES = 8
#: The kind of a span whose strings of both thresholds are repeated; those of one have kind 0 or 1.
BOTH = 2
#: Surroundings of a core that one task compares; a core with more is cut into blocks that meet by their strings' names.
BLOCK = 16_384


class Lengths:
    """Of two thresholds, the lower one first met: any repeated string of `least` bytes has a sampled position among its first
    `gap`, after which `core` bytes of the string follow. Ranks are of `first` bytes, then of twice as many up to the core."""

    def __init__(self, threshold: int, least: int):
        self.threshold, self.least = threshold, min(least, threshold)
        self.core = 1 << (self.least // 2).bit_length() - 1
        self.gap = self.least - self.core + 1
        if self.core < 2 * SEED_BYTES:
            raise ValueError("the thresholds must be 32 bytes or more")
        self.first = max(SEED_BYTES, self.core // 2)
        self.offsets = []
        while (done := self.first << len(self.offsets)) < self.core:
            self.offsets.append(done)


def window_extreme(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each size consecutive values, from their first."""
    op, out, have = np.minimum if least else np.maximum, values, 1
    while have < size:
        step = min(have, size - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def sampled(body: np.ndarray, gap: int) -> np.ndarray:
    """Positions whose next bytes hash least among gap consecutive positions, in some such window. That depends on the
    window's bytes alone, and each window has one."""
    if len(body) < SEED_BYTES + gap:
        return np.zeros(0, np.int64)
    n = len(body) - SEED_BYTES + 1
    grams = np.empty(n, np.uint64)
    for r in range(SEED_BYTES):
        part = np.frombuffer(body[r : r + (len(body) - r) // SEED_BYTES * SEED_BYTES].tobytes(), "<u8")
        grams[r::SEED_BYTES] = part[: len(grams[r::SEED_BYTES])]
    order = (mix(grams) >> U64(32)).astype(np.uint32)
    lowest = window_extreme(order, gap, True)
    # position i is lowest in some window iff the largest minimum of the windows that hold it is its own value
    edge = np.zeros(gap - 1, np.uint32)
    held = window_extreme(np.concatenate([edge, lowest, edge]), gap, False)
    return np.flatnonzero(held == order)


def anchors(column: pa.Array, size: Lengths) -> tuple:
    """(row, offset, names of the first bytes and of those at each doubling's offset, name of all bytes that any repeated
    string around the position could have) of the sampled positions that core bytes of their row follow."""
    body, at = raw(column)
    spots = sampled(body, size.gap)
    row = np.searchsorted(at, spots, "right") - 1
    ok = spots + size.core <= at[row + 1]
    spots, row = spots[ok], row[ok]
    c = prefix(body, VALUES)
    left = np.minimum(spots - at[row], size.gap - 1)
    right = np.minimum(at[row + 1] - spots, size.threshold)
    around = mix(spans_hash(c, spots - left, spots + right) + left.astype(U64) * U64(1009) + right.astype(U64) * U64(1_000_003))
    names = [spans_hash(c, spots, spots + size.first), *[spans_hash(c, spots + k, spots + 2 * k) for k in size.offsets]]
    return row, spots - at[row], names, around


def long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def reranked(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """The rows whose pair of rank and name another row has, with the pair's place among all such sorted pairs as rank.

    Pairs are counted before they move and only repeated ones are sorted: equal rows meet as one pair."""
    pair = ["rank", name] if "rank" in rows.columns else [name]
    repeated = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("seen")).where("seen > 1").select(*pair)
    ranks = scratch.save(repeated.repartitionByRange(*pair).sortWithinPartitions(*pair).withColumn("new", F.monotonically_increasing_id()))
    out = scratch.save(rows.join(ranks, pair).drop(*pair).withColumnRenamed("new", "rank"))
    scratch.drop(ranks)
    return out


def grown(data: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first 0, 1 ... most bytes from the core outwards, and how many there are."""
    have = np.diff(at)
    h, x = np.zeros((len(have), most + 1), U64), np.zeros(len(have), U64)
    for k in range(most):
        there = have > k
        x = x * U64(0x100000001B3)
        x[there] += VALUES[data[(at[:-1] + k)[there]]]
        h[:, k + 1] = x
    return h, have


def settle(table: pa.Table, size: Lengths) -> pa.Table:
    """Of entries (one for each different surrounding of a core): the distances before the position at which strings of
    either threshold are another's too, as spans; and, of cores in blocks, the names of strings that other blocks may have.

    A string of the threshold (kind 0) is repeated if it is seen twice; one of the least length (kind 1) if other documents
    have it. A span has first and last distances low, high. A name has kind 2 or 3, and the distance as low."""
    n, gap = table.num_rows, size.gap
    core, seen, first, last, blocks, reach_left, reach_right = (table.column(c).to_numpy() for c in ("rank", "seen", "first", "last", "blocks", "reach_left", "reach_right"))
    before, b_at = raw(table.column("before"))
    after, a_at = raw(table.column("after"))
    left, have_left = grown(before, b_at, gap - 1)
    right, have_right = grown(after, a_at, size.threshold - size.core)
    cut, sums = blocks > 1, []
    out: list[list[np.ndarray]] = [[] for _ in range(8)]  # entry, kind, low, high, name, count, first, last
    for kind, length in enumerate((size.threshold, size.least)):
        if kind and size.least == size.threshold:
            break
        shared = np.zeros((n, gap), bool)
        for k in range(gap):
            rest = length - size.core - k
            can = np.flatnonzero((have_left >= k) & (have_right >= rest) & (reach_left > k) & (reach_right > rest)) if rest >= 0 else np.zeros(0, np.int64)
            if not len(can):
                continue
            name = mix(core[can].view(U64) + mix(left[can, k] + mix(right[can, rest])))
            order = np.argsort(name, kind="stable")
            name, who = name[order], can[order]
            opens = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            many = np.diff(np.append(opens, len(who)))
            total, low, high = np.add.reduceat(seen[who], opens), np.minimum.reduceat(first[who], opens), np.maximum.reduceat(last[who], opens)
            told = low != high if kind else total > 1
            shared[who, k] = np.repeat(told, many)
            sums = [np.repeat(x, many) for x in (total, low, high)]
            # Of a name that this block settles, one entry tells the others; of one that it doesn't, each needs the answer.
            lead = np.zeros(len(who), bool)
            lead[opens] = True
            ask = cut[who] & (lead | ~np.repeat(told, many))
            if ask.any():
                w = who[ask]
                for column, value in zip(out, (w, np.full(len(w), kind + 2), np.full(len(w), k), np.repeat(told, many)[ask], name[ask].view(np.int64), np.where(lead[ask], sums[0][ask], 0), sums[1][ask], sums[2][ask])):
                    column.append(value.astype(np.int64))
        shared[(first != last) if kind else (seen > 1)] = False  # equal surroundings have told already
        edge = np.diff(np.pad(shared.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        entry, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        none = np.zeros(len(entry), np.int64)
        for column, value in zip(out, (entry, none + kind, low, high, none, none, none, none)):
            column.append(value)
    entry, *made = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    rows = pa.array(entry)
    named = {c: table.column(c).take(rows) for c in ("k_id", "k_text", "at", "rank", "around", "seen")}
    return pa.table(named | {c: pa.array(v.astype(np.int64)) for c, v in zip(("kind", "low", "high", "name", "count", "first", "last"), made)})


def common_bytes(rows: DataFrame, column: str, most: int) -> DataFrame:
    """(rank, around, reach) of entries(rank, around, bytes in a column): they may share fewer than reach bytes with another
    entry of their rank, and no more. In sorted order a neighbour shares most; at a partition's ends it isn't known."""

    def over(batches):
        last, opened = None, False  # the row before, and whether it has a row before it
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            data, at = raw(batch.column(column))
            rank, have = batch.column("rank").to_numpy(), np.diff(at)
            place = np.minimum(at[:-1][:, None] + np.arange(most), max(len(data) - 1, 0))
            held = np.where(np.arange(most) < have[:, None], data[place].astype(np.int16) if len(data) else -1, -1)
            same = (held[1:] == held[:-1]) & (held[1:] >= 0) & (rank[1:] == rank[:-1])[:, None]
            shared = np.where(same.all(axis=1), most, np.argmin(same, axis=1)) if most else np.zeros(len(same), np.int64)
            before = np.concatenate([[earlier if opened else most], shared])
            yield told(batch.slice(0, len(rank) - 1), np.maximum(before[:-1], shared))
            last, earlier, opened = batch.slice(len(rank) - 1), before[-1], True
        if last is not None:
            yield told(last, np.array([most]))

    def told(batch, shared):
        return pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("around"), pa.array(shared + 1, pa.int64())], names=["rank", "around", "reach"])

    ordered = ["rank", column, "around"]
    return rows.select(*ordered).repartitionByRange(*ordered).sortWithinPartitions(*ordered).mapInArrow(over, "rank long, around long, reach long")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    opens = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[opens], reach[np.append(np.flatnonzero(opens)[1:] - 1, len(start) - 1)]


def word_counts(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words of each run of bytes, cut ones too."""
    inside = SPACED[text]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    c = np.concatenate([[0], np.cumsum(opens)])
    return c[end] - c[start] + (inside[start] & ~opens[start])


def remove_repeats(docs: DataFrame, threshold: int = 400, texts: bool = True, passage: int = 256, passage_words: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages), with texts also removed (starts and ends) and kept_text.

    Each byte of documents(doc_id, text) goes that lies in a string of threshold bytes which also starts anywhere
    else, in the same document too. kept_text has undecodable remains of characters replaced. n_passages tells of shorter
    repeats, which stay: maximal runs of strings of `passage` bytes that other documents have too, of more than passage_words words.

    1. Positions sampled by content are named by their first bytes. 2. Prefix doubling: pairs of rank and name at the offset
    are sorted and ranked anew, unique ones drop out, the offset doubles, up to the bytes that follow a sampled position in any repeat.
    3. Where all bytes around equal ranks are equal, every string around them is repeated. 4. Where they differ, strings
    are compared at each distance; a rank with many surroundings is compared in blocks, and these by the names of strings as far as
    the sorted surroundings next to one share its bytes. 5. Intervals go back to their documents.

    Rows are told apart by content, so repeated rows are documents of their own that repeat each other; for n_passages they
    are one. Null texts are empty; texts under the threshold keep all. Null ids are values. An empty table gives none.
    """
    size = Lengths(threshold, passage)
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    keyed = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    names = [f"n{i}" for i in range(1 + len(size.offsets))]

    def mark(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                row, offset, named, around = anchors(part.column("text"), size)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("k_id").take(rows), part.column("k_text").take(rows), pa.array(offset, pa.int32()), long(around), *map(long, named)], names=["k_id", "k_text", "at", "around", *names])

    left = scratch.save(keyed.select("k_id", "k_text", "text").mapInArrow(mark, "k_id long, k_text long, at int, around long, " + ", ".join(f"{n} long" for n in names)))
    for name in names:  # of the first bytes, then at offsets that double
        before, left = left, reranked(scratch, left, name)
        scratch.drop(before)
    doc = F.xxhash64("k_id", "k_text")
    groups = left.groupBy("rank", "around").agg(F.count(F.lit(1)).alias("seen"), F.min(F.struct("k_id", "k_text", "at")).alias("one"), F.min(doc).alias("first"), F.max(doc).alias("last"))
    groups = scratch.save(groups)
    # Surroundings seen twice: all strings around the position are repeated; in other documents if there are such.
    twice = groups.where("seen > 1").select("rank", "around", F.when(F.col("first") != F.col("last"), BOTH).otherwise(0).alias("kind"))
    spans = ["k_id", "k_text", "kind", "at", "low", "high"]
    whole = left.join(twice, ["rank", "around"]).select("k_id", "k_text", "kind", "at", F.lit(0).alias("low"), F.lit(size.gap - 1).alias("high"))
    # Surroundings that differ: one of each goes back to its text for its bytes.
    cores = groups.groupBy("rank").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("rank", F.ceil(F.col("kinds") / BLOCK).cast("int").alias("blocks"))
    unsure = scratch.save(groups.join(cores, "rank").select("rank", "around", "seen", "first", "last", "blocks", "one.k_id", "one.k_text", "one.at"))
    mark_columns = ["rank", "around", "seen", "first", "last", "blocks", "at"]
    places = unsure.groupBy("k_id", "k_text").agg(F.collect_list(F.struct(*mark_columns)).alias("marks"))
    needed = keyed.select("k_id", "k_text", "text").join(unsure.select("k_id", "k_text").distinct(), ["k_id", "k_text"], "left_semi").dropDuplicates(["k_id", "k_text"])

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                body, at = raw(part.column("text"))
                marks = part.column("marks").flatten()
                row = np.repeat(np.arange(part.num_rows), part.column("marks").value_lengths().to_numpy())
                p = marks.field("at").to_numpy().astype(np.int64) + at[row]
                low, high = np.maximum(at[row], p - size.gap + 1), np.minimum(at[row + 1], p + size.threshold)
                take = lambda a, b, way: pa.array([body[x:y][::way].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary())
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("k_id").take(rows), part.column("k_text").take(rows), *[marks.field(c) for c in mark_columns], take(low, p, -1), take(p + size.core, high, 1)], names=["k_id", "k_text", *mark_columns, "before", "after"])

    around = needed.join(places, ["k_id", "k_text"]).select("k_id", "k_text", "text", "marks").mapInArrow(cut, "k_id long, k_text long, rank long, around long, seen long, first long, last long, blocks int, at int, before binary, after binary")
    around = scratch.save(around)
    far = {"reach_left": F.lit(size.gap).cast("long"), "reach_right": F.lit(threshold).cast("long")}
    met = around.where("blocks = 1").withColumns(far)
    hot = around.where("blocks > 1")
    if not hot.isEmpty():
        reaches = [scratch.save(common_bytes(hot, c, most)).withColumnRenamed("reach", r) for c, most, r in (("before", size.gap - 1, "reach_left"), ("after", threshold - size.core, "reach_right"))]
        met = met.unionByName(hot.join(reaches[0], ["rank", "around"]).join(reaches[1], ["rank", "around"]))
    slots = max(8, unsure.count() // 10_000 + 1)
    # A core's entries share a slot, or each of its blocks' do.
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("around"), F.col("blocks"))).otherwise(0)
    slot = F.pmod(F.xxhash64("rank", block), F.lit(slots)).cast("int")
    met = met.withColumn("slot", slot).groupBy("slot").applyInArrow(
        lambda key, t: settle(t, size), "k_id long, k_text long, at int, rank long, around long, seen long, kind long, low long, high long, name long, count long, first long, last long"
    )
    met = scratch.save(met)
    told = met.where("kind < 2")
    # Names of blocks meet: a name whose own block couldn't tell (high = 0) is told by all blocks together.
    asked = met.where("kind > 1")
    known = asked.groupBy("kind", "low", "name").agg(F.sum("count").alias("n"), F.min("first").alias("f"), F.max("last").alias("l"))
    known = known.where(((F.col("kind") == 2) & (F.col("n") > 1)) | ((F.col("kind") == 3) & (F.col("f") != F.col("l")))).select("kind", "low", "name")
    answered = asked.where("high = 0").join(known, ["kind", "low", "name"]).select(*[c for c in told.columns if c not in ("kind", "high")], (F.col("kind") - 2).alias("kind"), F.col("low").alias("high"))
    edges = told.unionByName(answered)
    # An entry that stands for several places of one document: its other places have the same strings.
    others = left.withColumnRenamed("at", "spot").join(edges.where("seen > 1").select("rank", "around", "kind", "low", "high").distinct(), ["rank", "around"]).select("k_id", "k_text", "kind", F.col("spot").alias("at"), "low", "high")
    found = [x.select("k_id", "k_text", *[F.col(c).cast("int").alias(c) for c in spans[2:]]) for x in (whole, edges, others)]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    by_doc = scratch.save(every.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("kind", "at", "low", "high")).alias("spans")))
    scratch.drop(left, groups, unsure, around, met)

    def finish(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            spans = batch.column("spans")
            flat, n = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            kind, at, low, high = (flat.field(f).to_numpy().astype(np.int64) for f in ("kind", "at", "low", "high"))
            cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            body, rows = raw(batch.column("text"))
            for i in range(batch.num_rows):
                text = body[rows[i] : rows[i + 1]]
                runs = []
                for k, length in enumerate((threshold, size.least)):
                    here = np.arange(cuts[i], cuts[i + 1])[np.isin(kind[cuts[i] : cuts[i + 1]], (k, BOTH))]
                    start, end = np.maximum(0, at[here] - high[here]), np.minimum(len(text), at[here] - low[here] + length)
                    ok = end - start >= length
                    runs.append(merged(start[ok], end[ok]))
                (start, end), (p, q) = runs
                keep = np.ones(len(text), bool)
                for x, y in zip(start.tolist(), end.tolist()):
                    keep[x:y] = False
                rest = text[keep].tobytes()
                passages = int((word_counts(text, p, q) > passage_words).sum()) if len(p) else 0
                for column, value in zip(out, (len(text), int((end - start).sum()), len(start), sha_hex(rest), passages, np.stack([start, end], axis=1).ravel().tolist() if texts else None, rest.decode("utf-8", "replace") if texts else None)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "removed", "kept_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = keyed.join(by_doc, ["k_id", "k_text"], "left").select("doc_id", "text", "spans").mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, removed array<long>, kept_text string")
    return done if texts else done.drop("removed", "kept_text")
