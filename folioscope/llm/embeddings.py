"""Near-duplicate embeddings by spherical-cap filters with structured product codes."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Scratch, components

#: Filters that a vector passes on average, and at least; vectors that a filter has on average, of one label.
CAPS, CAPS_LEAST, HELD = 24, 12, 32
#: Blocks of a direction; each takes one of a block's codes.
BLOCKS = 3
#: Rows of a cell, which is a run of neighbouring filters; one with more is cut into parts that meet in pairs.
PART = 4096
#: Memberships that a cell has on average, at most, and rows of a slot.
CELL, SLOT = 32768, 8192
#: Vectors, and names of filters, that are held against each other at once.
TILE = 2048
#: Vectors that are list-decoded at once.
DECODED = 1024
#: Crowded cells that are broadcast at most (32 bytes each); beyond, they are joined by a shuffle.
CROWDED = 10_000


class Caps:
    """Random directions, each a product of block codes, after a random rotation; and the cap's threshold."""

    def __init__(self, dim: int, vectors: int):
        rng = np.random.default_rng(dim)
        self.blocks = min(BLOCKS, dim)
        self.codes = max(4, int(np.ceil((CAPS * max(vectors, 1) / HELD) ** (1 / self.blocks))))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.book = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = rng.standard_normal((self.codes, b - a))
            self.book.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt((b - a) / dim))
        share = min(0.5, CAPS / self.codes**self.blocks)
        self.threshold = NormalDist().inv_cdf(1 - share) / np.sqrt(dim)
        # filters of a cell: those that share as many leading codes as its size allows, so that most of a vector's filters lie in few cells
        fair = max(1, CELL * self.codes**self.blocks // (CAPS * max(vectors, 1)))
        whole = max(self.codes**k for k in range(self.blocks + 1) if self.codes**k <= max(fair, 1))
        self.width = min(fair // whole * whole, self.codes ** max(self.blocks - 1, 0))

    def passed(self, unit: np.ndarray) -> list[np.ndarray]:
        """Each vector's filters, ascending: all directions beyond the threshold, by list decoding; if those are under
        CAPS_LEAST, the nearest ones by a lower threshold. Blocks are taken one by one for many vectors at once: a start of codes
        stays as long as the later blocks can make up for what it lacks."""
        x = unit @ self.rotation
        scores = [x[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.book)]
        best = [s.max(axis=1) for s in scores]
        rest = [sum(best[k + 1 :], np.zeros(len(x))) for k in range(len(scores))]  # what later blocks can add at most
        least, threshold = min(CAPS_LEAST, self.codes**self.blocks), np.full(len(x), self.threshold)
        out: list = [None] * len(x)
        for tile in np.array_split(np.arange(len(x)), max(1, -(-len(x) // DECODED))):
            while len(tile):
                row, codes, total = tile, np.zeros(len(tile), np.int64), np.zeros(len(tile))
                for s, more in zip(scores, rest):
                    grown = total[:, None] + s[row]
                    near = grown + more[row][:, None] >= threshold[row][:, None]
                    at, code = np.nonzero(near)
                    row, codes, total = row[at], codes[at] * self.codes + code, grown[near]
                order = np.lexsort((codes, row))
                row, codes = row[order], codes[order]
                ends = np.searchsorted(row, tile, "right")
                starts = np.searchsorted(row, tile, "left")
                enough = ends - starts >= least
                for v, lo, hi in zip(tile[enough].tolist(), starts[enough].tolist(), ends[enough].tolist()):
                    out[v] = codes[lo:hi]
                tile = tile[~enough]
                threshold[tile] -= 0.1 * np.abs(threshold[tile]) + 0.01
        return out


def usable(column: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda v: v != 0), F.lit(False))


def cosines(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of unit vectors link. Products depend on a block's shape in the last bits, so close calls are made pair by pair."""
    found = a @ b.T
    linked = found >= least
    p, q = np.nonzero(np.abs(found - least) < 1e-9)
    linked[p, q] = (a[p] * b[q]).sum(axis=1) >= least
    return linked


def share_lower(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether pairs share a name of their lists."""
    names = np.intersect1d(np.concatenate(a), np.concatenate(b))
    shared = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(names), TILE):
        some = names[k : k + TILE]
        has = []
        for side in (a, b):
            m = np.zeros((len(side), len(some)), np.float32)
            flat, row = np.concatenate(side), np.repeat(np.arange(len(side)), [len(c) for c in side])
            at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            here = some[at] == flat
            m[row[here], at[here]] = 1
            has.append(m)
        shared |= has[0] @ has[1].T > 0
    return shared


def smallest_reached(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of the links, the smallest node that it reaches over them."""
    most = np.iinfo(np.int64).max
    while True:
        to_a = np.minimum(a, np.where(linked, b[None, :], most).min(axis=1))
        to_b = np.minimum(b, np.where(linked, to_a[:, None], most).min(axis=0))
        if (to_a == a).all() and (to_b == b).all():
            return a, b
        a, b = to_a, to_b


def join_slot(table: pa.Table, least: float) -> pa.Table:
    """Within each filter of a slot's cells: each vector's links that no lower filter has too, and the smallest vector that
    it reaches there, so that the filter's links and what they connect are kept without its pairs."""
    label, cell, width, i, j, node, copies, own = (table.column(n).to_numpy() for n in ("label", "cell", "width", "i", "j", "node", "copies", "own"))
    vectors, caps = table.column("x").combine_chunks(), table.column("caps").combine_chunks()
    at, c_at = vectors.offsets.to_numpy(), caps.offsets.to_numpy()
    dims, start = np.diff(at), at[:-1] - at[0]
    flat = vectors.flatten().to_numpy().astype(np.float64)
    flat /= np.repeat(np.maximum.reduceat(np.abs(flat), start), dims)
    flat /= np.repeat(np.sqrt(np.add.reduceat(flat * flat, start)), dims)
    passed, c_at = caps.flatten().to_numpy(), c_at - c_at[0]
    row = np.repeat(np.arange(len(node)), np.diff(c_at))
    here = passed >= (cell * width)[row]  # the lower ones only tell which pairs were met before
    row, cap = row[here], passed[here]
    order = np.lexsort((row, j[row], i[row], cap, label[row], dims[row]))
    row, cap = row[order], cap[order]
    keys = np.stack([dims[row], label[row], cap, i[row], j[row]])
    cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
    out = [[], [], []]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo < 2:
            continue
        rows, name = row[lo:hi], cap[lo]
        tiles = [rows[k : k + TILE] for k in range(0, len(rows), TILE)]
        units = [flat[start[t][:, None] + np.arange(dims[t[0]])] for t in tiles]
        for p in range(len(tiles)):
            for q in range(p, len(tiles)):
                linked = cosines(units[p], units[q], least)
                a, b = tiles[p], tiles[q]
                if p == q:
                    np.fill_diagonal(linked, False)
                if i[a[0]] != j[a[0]]:  # two parts of a cell: pairs of one part are met elsewhere
                    linked &= own[a][:, None] != own[b][None, :]
                if not linked.any():
                    continue
                in_a, in_b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                linked, a, b = linked[np.ix_(in_a, in_b)], a[in_a], b[in_b]
                lower = [[c[c < name] for c in (passed[c_at[r] : c_at[r + 1]] for r in side)] for side in (a, b)]
                first = linked & ~share_lower(*lower)
                least_a, least_b = smallest_reached(linked, node[a], node[b])
                out[0].append(node[a])
                out[1].append(first @ copies[b])
                out[2].append(least_a)
                if p != q:
                    out[0].append(node[b])
                    out[1].append(first.T @ copies[a])
                    out[2].append(least_b)
    made = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.table({n: pa.array(c.astype(np.int64), pa.int64()) for n, c in zip(("u", "links", "v"), made)})


def link_embeddings(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding, label): a row for each input row.

    Vectors of one label and dimension link when their cosine, in double precision, is at least `least`. Each passes
    the filters whose directions lie within a cap around it; vectors of a filter are compared with each other, and a pair is
    counted in the lowest filter that both pass. Filters grow in number with the largest label, so that each
    holds about as many vectors at any size. A vector travels once to each cell, a run of filters with the same leading codes,
    in its own element type; cells are dealt to slots, as many as all rows need. Whether all close pairs share a filter is likely, not certain; the recall
    is measured against brute force in the tests. No pair below the threshold is linked.

    Equal vectors are one node, and link. Vectors that are null, zero, or hold a null or a component that isn't finite, and those
    without a label, link with nothing and are their own component. A null vec_id takes part, but isn't a component's id;
    such a row isn't kept. Repeated rows are vectors of their own. An empty table gives none.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind = "float" if single else "double"
    rows = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("x")).withColumn("node", F.when(usable(F.col("x")) & F.col("label").isNotNull(), F.xxhash64("label", "x")))
    rows = scratch.save(rows)
    nodes = scratch.save(rows.where("node is not null").groupBy("node").agg(F.first("label").cast("long").alias("label"), F.first("x").alias("x"), F.count(F.lit(1)).alias("copies")))
    most = nodes.groupBy("label", F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1

    def decode(batches):
        books = {}
        for batch in batches:
            column = batch.column("x")
            flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            passed, widths = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            dims = np.diff(at)
            for d in np.unique(dims):
                which = np.flatnonzero(dims == d)
                x = flat[at[which][:, None] + np.arange(d)].astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                book = books.setdefault(int(d), Caps(int(d), most))
                widths[which] = book.width
                for k, c in zip(which, book.passed(x)):
                    passed[k] = c
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("node", "label", "copies", "x")), pa.array(passed, pa.list_(pa.int64())), pa.array(widths)], names=["node", "label", "copies", "x", "caps", "width"])

    decoded = scratch.save(nodes.select("node", "label", "copies", "x").mapInArrow(decode, f"node long, label long, copies long, x array<{kind}>, caps array<long>, width long"))
    cells = F.array_distinct(F.transform("caps", lambda c: F.floor(c / F.col("width"))))
    key = ["label", "d", "cell"]
    counted = scratch.save(decoded.select("label", F.size("x").alias("d"), F.explode(cells).alias("cell")).groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    crowded = scratch.save(counted.where(F.col("n") > PART).select(*key, F.ceil(F.col("n") / PART).alias("parts")))
    total, many = counted.agg(F.sum("n")).first()[0] or 0, crowded.count()
    spread = decoded.select("*", F.size("x").alias("d"), F.explode(cells).alias("cell"))
    spread = spread.withColumn("caps", F.filter("caps", lambda c: c < (F.col("cell") + 1) * F.col("width")))
    if many:
        spread = spread.join(F.broadcast(crowded) if many <= CROWDED else crowded, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        total += crowded.agg(F.sum((F.col("parts") - 1) * PART * F.col("parts"))).first()[0]
    else:
        spread = spread.withColumn("parts", F.lit(1))
    met = (
        spread.withColumn("own", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    )
    slots = max(8, -(-total // SLOT))
    placed = met.select("label", "cell", "width", "i", "j", "own", "node", "copies", "x", "caps", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(slots)).alias("slot"))
    placed = placed.repartition(max(slots // 4, min(slots, 16)), "slot")
    found = scratch.save(placed.groupBy("slot").applyInArrow(lambda t: join_slot(t, least), "u long, links long, v long"))

    links = scratch.save(found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node"))
    roots = scratch.save(components(scratch, found.select("u", "v")))
    own_copies = nodes.select("node", "copies").join(links, "node", "left").join(roots, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("root"))
    own_copies = scratch.save(own_copies)
    joined = scratch.save(rows.select("vec_id", "node").join(own_copies, "node", "left"))
    smallest = scratch.save(joined.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id")))
    return joined.join(smallest, "root", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce(F.col("component_id"), F.col("vec_id")).cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept")
    )
