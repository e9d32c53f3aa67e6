"""Exact Jaccard join of documents on word shingles, by signature trees over rare-token prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import SPACED, U64, bounds, byte_values, chunks, mix, prefix, raw, runs, spans_hash
from .common import Scratch, components

SHINGLE = 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 80
VALUES = byte_values(41, fold=True)
#: A token is frequent if it has this share of all shingles, and FREQUENT_LEAST of them at least: so a million are, at most.
FREQUENT_SHARE, FREQUENT_LEAST = 1e-6, 100
#: Entries of a tree's top node; longer lists are several, which meet in pairs if their sizes allow it.
BLOCK = 256
#: Entries of the lowest inner node of a tree.
LEAF = 16
#: A list of so many entries is compared leaf by leaf at once.
SHORT = 24
#: Shorter lists have at most three pairs an entry: they take part in the first and the last pass only.
MIDDLE = 8
#: Spanning forests taken from each tree.
FORESTS = 3
#: Links estimated to fall short of the limit by no more than this are tried in forests, too.
MARGIN = 0.02
#: Listed prefix tokens by which the first pass, which only seeks the likeliest links, brings documents together.
FIRST = 8


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending. With fewer words than a shingle has, the sequence is one."""
    body, at = raw(column)
    starts, ends, row_word = bounds(body, at, SPACED)
    if not len(starts):
        return [np.zeros(0, U64)] * (len(at) - 1)
    words = spans_hash(prefix(body, VALUES), starts, ends)
    full, out = runs(words, row_word, SHINGLE), []
    for a, b in zip(row_word[:-1].tolist(), row_word[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        else:
            out.append(mix(runs(words[a:b], row_word, b - a) + U64(b - a)) if b > a else np.zeros(0, U64))
    return out


def set_name(tokens: np.ndarray) -> int:
    """A set's 64-bit name, the same for equal sets."""
    both = np.array([tokens.sum(dtype=U64)], U64) * U64(3) + np.array([mix(tokens).sum(dtype=U64)], U64)
    return int(mix(both).view(np.int64)[0])


def prefix_length(n: int) -> int:
    """Any two sets that link share one of their first so many tokens, in whatever order all sets have."""
    return n - -(-PERCENT * n // 100) + 1


def bitmap_bits(n: int) -> int:
    return max(1024, 1 << int(2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bits(len(tokens)), np.uint8)
    bits[((tokens >> U64(20)) & U64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Hashes of the shingles that many documents have; each task counts three million at a time and tells of those seen twice."""

    def told(sets):
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts > 1
        columns = np.append(tokens[often].view(np.int64), 0), np.append(counts[often], 0), np.append(np.zeros(often.sum(), np.int64), sum(map(len, sets)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "seen", "shingles"])

    def over(batches):
        held = []
        for batch in batches:
            for part in chunks(batch, "text"):
                held += shingle_sets(part.column("text"))
                if sum(map(len, held)) > 3_000_000:
                    yield told(held)
                    held = []
        if held:
            yield told(held)

    counted = docs.select("text").mapInArrow(over, "token long, seen long, shingles long")
    sums = Scratch(docs.sparkSession, "frequent")
    saved = sums.save(counted.groupBy("token").agg(F.sum("seen").alias("seen"), F.sum("shingles").alias("shingles")).where((F.col("seen") >= FREQUENT_LEAST) | (F.col("shingles") > 0)))
    total = saved.agg(F.sum("shingles")).first()[0] or 0
    rows = saved.where(F.col("seen") >= max(FREQUENT_LEAST, int(total * FREQUENT_SHARE))).select("token").toArrow()
    sums.drop(saved)
    return np.sort(rows.column("token").to_numpy().astype(np.int64).view(U64))


def describe(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """docs(doc_id, text, k) as (doc_id, k, n, node, prefix, bits): node names the set; its prefix holds its first tokens,
    frequent ones after all others, and with its bitmap is given once in a batch."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)

    def over(batches):
        common = shipped.value
        for batch in batches:
            seen = set()
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column("text"))
                nodes, heads, bits = [], [], []
                for tokens in sets:
                    node = set_name(tokens) if len(tokens) else None
                    nodes.append(node)
                    if node is None or node in seen:
                        heads.append(None)
                        bits.append(None)
                        continue
                    seen.add(node)
                    need = prefix_length(len(tokens))
                    if len(common):
                        often = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
                        tokens_in_order = np.concatenate([tokens[~often], tokens[often]])
                    else:
                        tokens_in_order = tokens
                    heads.append(tokens_in_order[:need].view(np.int64))
                    bits.append(bitmap(tokens))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("k"), pa.array([len(s) for s in sets], pa.int32()), pa.array(nodes, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=["doc_id", "k", "n", "node", "prefix", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "k", "text").mapInArrow(over, "doc_id long, k long, n int, node long, prefix array<long>, bits binary")


# ---- signature trees -------------------------------------------------------------------------------------------------


class Entries:
    """Flat arrays of the entries of many lists."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        self.at = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.n = flat.field("n").to_numpy().astype(np.int64)
        self.pos = flat.field("pos").to_numpy().astype(np.int64)
        self.node = flat.field("node").to_numpy()
        self.part = flat.field("part").to_numpy()
        self.data, self.offset = raw(flat.field("bits"))
        self.width = np.diff(self.offset)

    def rows(self, which: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps as 64-bit words, folded to a width in bytes."""
        own = self.width[which]
        out = np.zeros((len(which), width), np.uint8)
        for w in np.unique(own):
            at = np.flatnonzero(own == w)
            full = self.data[self.offset[which[at]][:, None] + np.arange(w)]
            out[at] = np.bitwise_or.reduce(full.reshape(len(at), w // width, width), axis=1)
        return out.view(U64)


def can_link(n: np.ndarray, pos: np.ndarray, m: np.ndarray, qos: np.ndarray) -> np.ndarray:
    """Whether sizes allow a link whose first shared token stands at these places."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    need = PERCENT * (n + m)  # of (100 + PERCENT) * intersection
    return (100 * small >= PERCENT * large) & ((100 + PERCENT) * np.minimum(n - pos, m - qos) >= need)


def overlap_bound(a: Entries, i: np.ndarray, b: Entries, j: np.ndarray) -> np.ndarray:
    """At most so many tokens are shared: each bit that only one side has is a token, at least, that only it has."""
    out = np.zeros(len(i), np.int64)
    width = np.minimum(a.width[i], b.width[j])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for part in np.array_split(at, max(1, len(at) * int(w) >> 24)):
            x, y = a.rows(i[part], int(w)), b.rows(j[part], int(w))
            alone = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
            other = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            out[part] = np.minimum(a.n[i[part]] - alone, b.n[j[part]] - other)
    return out


def likeness(a: Entries, i: np.ndarray, b: Entries, j: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: tokens that one side has alone, by the bits that it has alone, as some fall on the other's."""
    out = np.zeros(len(i))
    width = np.minimum(a.width[i], b.width[j])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for part in np.array_split(at, max(1, len(at) * int(w) >> 24)):
            x, y = a.rows(i[part], int(w)), b.rows(j[part], int(w))
            n, m, bits = a.n[i[part]], b.n[j[part]], 8.0 * w
            count = lambda z: np.bitwise_count(z).sum(axis=1, dtype=np.int64)
            alone, other = count(x & ~y) / (1 - np.minimum(count(y), bits - 1) / bits), count(y & ~x) / (1 - np.minimum(count(x), bits - 1) / bits)
            both = np.clip((n - alone + m - other) / 2, 0, np.minimum(n, m))
            out[part] = both / (n + m - both)
    return out


def tree(e: Entries, which: np.ndarray, width: int) -> list[dict]:
    """Levels from the leaves' parents to the root: size ranges, OR-combined bitmaps and the most tokens beyond an entry's bits."""
    bits = e.rows(which, width)
    low, high = e.n[which], e.n[which]
    excess = e.n[which] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    step, levels = LEAF, []
    while True:
        cut = np.arange(0, len(low), step)
        low, high, excess = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(excess, cut)
        bits = np.bitwise_or.reduceat(bits, cut, axis=0)
        levels.append((low, high, excess, bits, step))
        if len(low) == 1:
            return levels
        step = 2


def traverse(a: Entries, wa: np.ndarray, b: Entries, wb: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entry pairs of two trees left by pruning node pairs, from the roots down."""
    width = int(min(a.width[wa].min(), b.width[wb].min()))
    ta, tb = tree(a, wa, width), tree(b, wb, width)
    depth = max(len(ta), len(tb))
    ta, tb = ta + ta[-1:] * (depth - len(ta)), tb + tb[-1:] * (depth - len(tb))
    x = y = np.zeros(1, np.int64)
    for d in range(depth - 1, -1, -1):
        (la, ha, ea, ba, _), (lb, hb, eb, bb, _) = ta[d], tb[d]
        ok = (100 * ha[x] >= PERCENT * lb[y]) & (100 * hb[y] >= PERCENT * la[x])
        shared = np.bitwise_count(ba[x] & bb[y]).sum(axis=1, dtype=np.int64)
        # |A & B| <= shared bits + tokens beyond bits of either
        ok &= (100 + PERCENT) * (shared + np.minimum(ea[x], eb[y])) >= PERCENT * (la[x] + lb[y])
        if same:
            ok &= x <= y
        x, y = x[ok], y[ok]
        if d:
            grow = lambda t, v: [v] if len(t[d - 1][0]) == len(t[d][0]) else [2 * v, 2 * v + 1]
            pairs = [(p, q) for p in grow(ta, x) for q in grow(tb, y)]
            x, y = np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])
            ok = (x < len(ta[d - 1][0])) & (y < len(tb[d - 1][0]))
            x, y = x[ok], y[ok]
    i, j = (x[:, None] * LEAF + np.arange(LEAF)).repeat(LEAF, axis=1).ravel(), np.tile(y[:, None] * LEAF + np.arange(LEAF), LEAF).ravel()
    ok = (i < len(wa)) & (j < len(wb))
    i, j = i[ok], j[ok]
    return (wa[i[i < j]], wb[j[i < j]]) if same else (wa[i], wb[j])


def survivors(a: Entries, i: np.ndarray, b: Entries, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entry pairs, those of different parts that may link."""
    ok = (a.part[i] != b.part[j]) & (a.node[i] != b.node[j]) & can_link(a.n[i], a.pos[i], b.n[j], b.pos[j])
    i, j = i[ok], j[ok]
    bound = overlap_bound(a, i, b, j)
    ok = (100 + PERCENT) * bound >= PERCENT * (a.n[i] + b.n[j])
    return i[ok], j[ok]


def forest(p: np.ndarray, q: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Places of the pairs of spanning forests of the parts p and q, the likeliest links first, of those likely to hold. They
    share no pair, so that parts stay together when some links don't hold."""
    order = np.argsort(-alike, kind="stable")
    order = order[alike[order] >= PERCENT / 100 - MARGIN]
    lefts, rights = p.tolist(), q.tolist()
    kept: list[int] = []
    for _ in range(FORESTS):
        above: dict[int, int] = {}

        def root(x: int, above: dict[int, int] = above) -> int:
            while (p := above.get(x, x)) != x:
                above[x] = above.get(p, p)
                x = p
            return x

        left = []
        for k in order.tolist():
            x, y = root(lefts[k]), root(rights[k])
            if x != y:
                above[x] = y
                kept.append(k)
            else:
                left.append(k)
        order = np.array(left, np.int64)
    return np.array(kept, np.int64)


def compare(batches, only_forest: bool):
    """Rows of (left, right) entries, right null for a list with itself, to pairs of nodes to verify."""
    for batch in batches:
        a = Entries(batch.column("left"))
        two = batch.column("right").is_valid().to_numpy(zero_copy_only=False)
        b = Entries(batch.column("right")) if two.any() else None
        size = np.diff(a.at)
        found: list[tuple[Entries, np.ndarray, Entries, np.ndarray]] = []
        short = np.flatnonzero(~two & (size <= SHORT))
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in np.unique(size[short]):
            p, q = np.triu_indices(int(n), 1)
            at = a.at[short[size[short] == n]][:, None]
            i.append((at + p).ravel())
            j.append((at + q).ravel())
        x, y = survivors(a, np.concatenate(i), a, np.concatenate(j))
        found.append((a, x, a, y))
        for r in np.flatnonzero(two | (size > SHORT)):
            left = np.arange(a.at[r], a.at[r + 1])
            other, right = (b, np.arange(b.at[r], b.at[r + 1])) if two[r] else (a, left)
            if len(left) and len(right):
                x, y = meet_trees(a, left, other, right, not two[r])
                if only_forest and len(x):
                    keep = forest(a.part[x], other.part[y], likeness(a, x, other, y))
                    x, y = x[keep], y[keep]
                found.append((a, x, other, y))
        out = [(e.node[x], f.node[y]) for e, x, f, y in found]
        if only_forest:
            # Lists share documents, so one more over all of them lists each part a few times.
            sides = [np.concatenate(w) for w in ([e.part[x] for e, x, _, _ in found], [f.part[y] for _, _, f, y in found], [likeness(e, x, f, y) for e, x, f, y in found])]
            keep = forest(*sides)
            out = [tuple(np.concatenate([o[k] for o in out])[keep] for k in range(2))]
        u, v = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1) if len(u) else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["u", "v"])


def meet_trees(a: Entries, left: np.ndarray, b: Entries, right: np.ndarray, same: bool):
    """Dual traversals of the trees of each bitmap width with those of the same and the next, which sizes that can link have."""
    found = []
    for w in np.unique(a.width[left]):
        for v in np.unique(b.width[right]):
            if max(w, v) > 2 * min(w, v) or same and v < w:
                continue
            wa, wb = left[a.width[left] == w], right[b.width[right] == v]
            i, j = traverse(a, wa, b, wb, same and v == w)
            for part in np.array_split(np.arange(len(i)), max(1, len(i) >> 16)):
                found.append(survivors(a, i[part], b, j[part]))
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(2))


# ---- the join --------------------------------------------------------------------------------------------------------


def sized_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root, size): components of the links and their numbers of nodes."""
    parts = scratch.save(components(scratch, links))
    sizes = parts.groupBy("root").agg(F.count("*").alias("size"))
    return scratch.save(parts.join(sizes, "root").select("node", "root", "size"))


def candidates(scratch: Scratch, lists: DataFrame, parts: DataFrame | None, bits: DataFrame, only_forest: bool) -> DataFrame:
    """Pairs of nodes of different parts that some list's trees leave, once each.

    Without parts each node is its own, and only neighbouring blocks of a list meet. With parts, the largest of a list comes last in
    it, and blocks wholly of one part don't meet: a list of one large part and few others takes work in proportion to its length."""
    rows = lists
    if parts is None:
        rows, order = rows.withColumn("part", F.col("node")), ["n", "node"]
    else:
        rows = rows.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node")).withColumn("size", F.coalesce("size", F.lit(1)))
        mixed = rows.groupBy("token").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.min("part").alias("least"), F.max("part").alias("greatest"))
        rows = rows.join(mixed.where("least <> greatest").select("token", "main"), "token")
        order = [F.col("part") == F.col("main"), "n", "node"]
    placed = Window.partitionBy("token").orderBy(*order)
    rows = scratch.save(rows.select("token", "node", "n", "pos", "part", F.floor((F.row_number().over(placed) - 1) / BLOCK).alias("block")))

    def packed(r: DataFrame) -> DataFrame:
        # Dealt by token first: partly built blocks would be several times as large to shuffle.
        entry = F.struct("n", "pos", "node", "part", "bits")
        ranges = [F.min("n").alias("low"), F.max("n").alias("high"), F.min("part").alias("least"), F.max("part").alias("greatest")]
        return r.join(bits, "node").repartition("token").groupBy("token", "block").agg(F.collect_list(entry).alias("left"), *ranges)

    blocks = packed(rows)
    alone = blocks.where("least <> greatest").select("left", F.lit(None).cast(blocks.schema["left"].dataType).alias("right"))
    several = rows.where("block > 0").select("token").distinct()
    long = packed(rows.join(several, "token", "left_semi"))
    a, b = long.alias("a"), long.alias("b")
    near = F.col("a.block") + 1 == F.col("b.block") if parts is None else F.col("a.block") < F.col("b.block")
    sizes = (100 * F.col("a.high") >= PERCENT * F.col("b.low")) & (100 * F.col("b.high") >= PERCENT * F.col("a.low"))
    differ = F.least("a.least", "b.least") != F.greatest("a.greatest", "b.greatest")
    meet = a.join(b, (F.col("a.token") == F.col("b.token")) & near & sizes & differ).select(F.col("a.left").alias("left"), F.col("b.left").alias("right"))
    # As many tasks as the cluster's shuffles have: block pairs grow with the rows.
    meet = meet.repartition(max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = alone.unionByName(meet).mapInArrow(lambda batches: compare(batches, only_forest), "u long, v long")
    out = scratch.save(found.distinct())
    scratch.drop(rows)
    return out


def verify(scratch: Scratch, pairs: DataFrame, names: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs(u, v) that link, by their whole texts. names(node, k): a text of each set, by key."""
    n = pairs.count()
    if not n:
        return pairs
    slots = max(8, n // 2000 + 1)
    slot = F.pmod(F.xxhash64("u"), F.lit(slots)).cast("int")
    placed = pairs.withColumn("slot", slot)
    wanted = placed.select("slot", F.col("u").alias("node")).unionByName(placed.select("slot", F.col("v").alias("node"))).distinct()
    keyed = scratch.save(wanted.join(names, "node"))
    texts = docs.select("k", "text").join(keyed.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    rows = keyed.join(texts, "k").select("slot", "node", "text")

    def check(key, left, right):
        sets = {}
        for batch in right.to_batches():
            for part in chunks(batch, "text"):
                sets |= zip(part.column("node").to_pylist(), shingle_sets(part.column("text")))
        u, v = [], []
        for x, y in zip(left.column("u").to_pylist(), left.column("v").to_pylist()):
            p, q = sets[x], sets[y]
            shared = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * shared >= PERCENT * (len(p) + len(q) - shared):
                u.append(x)
                v.append(y)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    out = scratch.save(placed.groupBy("slot").cogroup(rows.groupBy("slot")).applyInArrow(check, "u long, v long"))
    scratch.drop(keyed)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, k, n_shingles, component_id) of documents(doc_id, text, ...): a row for each input row.

    Documents link when 100 * |A & B| >= 80 * |A | B| for their sets of 5-word shingles, words lower-cased (A-Z).
    k is the hash of the text. Equal sets are one node. Nodes meet in the lists of their prefix tokens; each list is a
    signature tree of OR-combined bitmaps and size ranges, cut in blocks when it is long. A first pass over the lists of a
    few tokens verifies the likeliest links of each tree (a spanning forest), and a second does so between the components left in
    long lists, so that large groups of copies become one component early; the third verifies every pair of
    different components that pruning leaves and that wasn't verified before. No link between components is missed, and pairs within one are never listed.

    Null and empty texts, and texts without words, have an empty set and link with nothing; they are their own component. A
    null doc_id takes part, but component_id is the smallest id that isn't null. Repeated rows are in one component.
    An empty table gives none. Sets are told apart by 64-bit names and shingles by 64-bit hashes.

    component_id doesn't name a component: those without any id have null, and those that share a smallest id its number.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rooted = linked(scratch, docs)
    smallest = scratch.save(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rooted.join(smallest, "root", "left").select("doc_id", "k", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def linked(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc_id, k, n, root) of documents(doc_id, text, ...): root names the component; null where there are no words."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("k"))
    described = scratch.save(describe(docs, frequent_tokens(docs)))
    postings = described.where("prefix is not null").select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    listed = Window.partitionBy("token").orderBy("n", "node")
    # Largest partner that a document can have when the token is its first shared one.
    reach = F.expr(f"(100 + {PERCENT}) * (n - pos) / {PERCENT}.0 - n")
    shared = (
        postings.withColumn("before", F.lag(F.struct("n", "node")).over(listed)).withColumn("after", F.lead("n").over(listed))
        .withColumn("several", F.min("node").over(Window.partitionBy("token")) != F.max("node").over(Window.partitionBy("token")))
        .where("several").where("before.node is null or before.node <> node")
        .where((100 * F.col("before.n") >= PERCENT * F.col("n")) | (100 * F.col("n") >= PERCENT * F.col("after")))
        .where(reach * 100 >= PERCENT * F.col("n"))
        .select("token", "node", "n", "pos")
    )
    lists = scratch.save(shared)
    wide, described = described, scratch.save(described.drop("prefix"))
    scratch.drop(wide)
    bits = described.where("bits is not null").select("node", "bits").dropDuplicates(["node"])
    names = described.where("node is not null").groupBy("node").agg(F.min("k").alias("k"))

    first = lists.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("pos"))).where(F.col("r") <= FIRST).drop("r")
    tested = candidates(scratch, first, None, bits, True)
    links = verify(scratch, tested, names, docs)
    long = lists.groupBy("token").count().where(F.col("count") >= MIDDLE).select("token")
    for some, only_forest in ((lists.join(long, "token", "left_semi"), True), (lists, False)):
        pairs = candidates(scratch, some, sized_components(scratch, links), bits, only_forest)
        pairs = scratch.save(pairs.join(tested, ["u", "v"], "left_anti"))
        links = links.unionByName(verify(scratch, pairs, names, docs))
        tested = tested.unionByName(pairs)
    parts = scratch.save(components(scratch, links))

    return scratch.save(described.select("doc_id", "k", "n", "node").join(parts, "node", "left").select("doc_id", "k", "n", F.coalesce("root", "node").alias("root")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates of a smaller id: one of each component, and those without words.
    Of repeated rows of one id and text one stays."""
    found = linked(Scratch(docs.sparkSession, "neardup"), docs)
    stay = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("s")).select(F.col("s.doc_id").alias("s_id"), F.col("s.k").alias("s_k"))
    # The columns travel as one, so that none can clash with these.
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("k"), F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)).alias("worded"))
    kept = named.where("worded").join(stay, F.col("i").eqNullSafe(F.col("s_id")) & (F.col("k") == F.col("s_k")), "left_semi").dropDuplicates(["i", "k"])
    return kept.unionByName(named.where("not worded")).select("doc.*")
