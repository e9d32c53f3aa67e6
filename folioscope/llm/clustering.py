"""Centroid clustering by exponion search: integer k-means whose vectors look only at centroids in a ball around their own."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Scratch

#: Components beyond this count as it, so that every distance and sum fits in 64 bits.
LIMIT = 1 << 27
#: The lower part of a distance.
LOW = (1 << 31) - 1
#: Vectors that are held against centroids at once.
TILE = 8192
#: Bounds are kept wider than computed by this share, so that rounding never hides a nearer or an equal centroid.
SLACK = 1e-9
STATE = "v binary, cluster int, upper double, lower double"
SUMS = "sums array<struct<cluster int, dim int, value long>>"


class Ball:
    """Centroids, and for each one the others by distance."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        k = len(centroids)
        far = np.zeros((k, k))
        for i in range(k):
            far[i] = np.sqrt(((centroids - centroids[i]) ** 2).sum(axis=1).astype(np.float64))
        self.order = np.argsort(far, axis=1, kind="stable")
        self.order[np.arange(k), :] = [np.concatenate([[i], o[o != i]]) for i, o in enumerate(self.order)]
        self.reach = np.take_along_axis(far, self.order, axis=1)
        #: Half the distance to the nearest other centroid: whoever is nearer to its own than that has no nearer one.
        self.half = self.reach[:, 1] / 2 if k > 1 else np.full(1, np.inf)

    def exact(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.c[cluster]) ** 2).sum(axis=1)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower, distances computed) after a search with valid bounds: upper on the distance to the own
        centroid, lower on that to every other. The nearest is found, of equals the one of the smallest number."""
        cluster, upper, lower, looked = cluster.copy(), upper.copy(), lower.copy(), 0
        least = np.maximum(lower, self.half[cluster] * (1 - SLACK))
        open_ = np.flatnonzero(upper >= least)
        upper[open_] = np.sqrt(self.exact(x[open_], cluster[open_]).astype(np.float64)) * (1 + SLACK)
        looked += len(open_)
        open_ = open_[upper[open_] >= least[open_]]
        for own in np.unique(cluster[open_]):
            mine = open_[cluster[open_] == own]
            # Both the nearest centroid and the second lie in this ball; a tie lies on its surface, so the surface belongs to it.
            ball = (2 * upper[mine] + 2 * self.half[own]) * (1 + SLACK)
            inside = np.searchsorted(self.reach[own], ball, side="right")
            # Rings that double in size, so that a few calls serve all vectors of a cluster.
            ring = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64), len(self.c))
            for size in np.unique(ring):
                near, some = np.sort(self.order[own, :size]), mine[ring == size]
                for part in np.array_split(some, -(-len(some) * size // TILE)):
                    d = ((x[part][:, None, :] - self.c[near][None, :, :]) ** 2).sum(axis=2)
                    best = d.argmin(axis=1)  # the first of equals, of ascending numbers
                    cluster[part] = near[best]
                    upper[part] = np.sqrt(d[np.arange(len(part)), best].astype(np.float64)) * (1 + SLACK)
                    d[np.arange(len(part)), best] = np.iinfo(np.int64).max
                    lower[part] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK) if size > 1 else np.inf
                    looked += d.size
        return cluster, upper, lower, looked


def scaled(embedding: Column, scale: int) -> Column:
    """Components as integers, as far as LIMIT."""
    return F.transform(embedding, lambda v: F.least(F.greatest(F.floor(v.cast("double") * scale), F.lit(-LIMIT).cast("long")), F.lit(LIMIT).cast("long")).cast("int"))


def whole(embedding: Column, dims: int) -> Column:
    """Whether a vector has that many components, none of them null, NaN or infinite."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(embedding) == dims) & finite, F.lit(False))


def _shifted(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid went, and how far the farthest of the others did."""
    moved = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
    others = np.array([np.delete(moved, i).max(initial=0.0) for i in range(len(moved))])
    return moved, others


def _pass(kept: list[str], at: np.ndarray, before: np.ndarray | None, dims: int):
    """A round over a partition: every vector's cluster and bounds, and at the end one row with the partition's sums.

    Value at place `dims` counts a cluster's vectors; those after it sum the upper and lower parts of their distances, as whole ones could pass 64 bits."""
    moves = None if before is None else _shifted(before, at)

    def over(batches):
        ball, k = Ball(at), len(at)
        sums, names = np.zeros((k, dims + 3), np.int64), [*kept, "v", "cluster", "upper", "lower", "distance", "sums"]
        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in kept]
            told = batch.column("v").is_valid()
            batch = batch.filter(told)
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
            if moves is None:
                cluster, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
            else:
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                upper = (batch.column("upper").to_numpy(zero_copy_only=False) + moves[0][cluster]) * (1 + SLACK)
                lower = np.maximum(batch.column("lower").to_numpy(zero_copy_only=False) - moves[1][cluster], 0) * (1 - SLACK)
            cluster, upper, lower, _ = ball.assign(x, cluster, upper, lower)
            distance = ball.exact(x, cluster)
            for c in np.unique(cluster):
                mine = cluster == c
                sums[c, :dims] += x[mine].sum(axis=0)
                sums[c, dims] += mine.sum()
                sums[c, dims + 1] += (distance[mine] >> 31).sum()
                sums[c, dims + 2] += (distance[mine] & LOW).sum()
            none = pa.nulls(len(x), pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("value", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance), none], names=names)
        if kinds and sums[:, dims].any():
            row = [[{"cluster": int(c), "dim": int(d), "value": int(sums[c, d])} for c, d in zip(*np.nonzero(sums))]]
            kind = pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("value", pa.int64())]))
            empty = [pa.nulls(1, t) for t in (*kinds, pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(row, kind)], names=names)

    return over


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """(all columns but embedding, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors(vec_id, embedding, ...): a row for each kept one.

    Lloyd's rounds in whole numbers. Components become floor(scale * x), x in double precision; those beyond +-2^27 count as that. Centroids
    start as the k vectors of the smallest sha256 of seed and vec_id, in that order; a null vec_id has no digits, and of equal
    digests the smaller vector comes first. A round assigns every vector to the nearest centroid, ties to the smaller
    number, then moves each centroid that has any to the floor of its vectors' mean; one without stays. After the rounds all are assigned once more.

    Exponion search: each vector carries an upper bound on its distance to its centroid and a lower one on that to any other. Both follow
    the centroids' moves; only where they don't decide are centroids looked at, and of them those in the ball around its own one that must hold
    the two nearest. The bounds allow for rounding, and distances are whole numbers, so the result is that of a full search.

    Vectors stay where they are: a round is one pass over files that the round before wrote, without a shuffle; a task adds a row
    with its sums, and k * (dims + 3) added-up numbers come to the driver. A lost executor costs the tasks it ran. Many copies of one vector are rows as others.

    Not kept: vectors that are null, of another length, or hold a null or a component that isn't finite. Fewer than k kept
    vectors make fewer centroids; none, or an empty table, give no rows. Repeated rows are vectors of their own. Columns named as the results are replaced.
    Sums of distances that pass 2^63 - 1 count as that.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "clusters")
    added = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    kept = [c for c in vectors.columns if c != "embedding" and c not in added]
    carried = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")  # as one, so that none can clash
    rows = vectors.where(whole(F.col("embedding"), dims)).select(carried, scaled(F.col("embedding"), scale).alias("x"))
    first = rows.select(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("row.vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x").orderBy("h", "x").limit(k)
    at = np.array([r.x for r in first.collect()], np.int64).reshape(-1, dims)
    row = StructField("row", rows.schema["row"].dataType)
    if not len(at):
        return spark.createDataFrame([], StructType([*row.dataType.fields, *StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").fields]))
    schema = StructType([row, *StructType.fromDDL(f"{STATE}, distance long, {SUMS}").fields])

    def packed(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            wide = flat.reshape(-1, dims)
            nulls = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([v.tobytes() for v in wide], pa.binary()), *nulls], names=["row", "v", "cluster", "upper", "lower"])

    state, before, moved = rows.mapInArrow(packed, StructType([row, *StructType.fromDDL(STATE).fields])), None, None
    for n in range(rounds + 1):
        done = scratch.save(state.mapInArrow(_pass(["row"], at, before, dims), schema))
        if moved is not None:
            scratch.drop(moved)
        totals = done.where("sums is not null").select(F.explode("sums").alias("s")).groupBy("s.cluster", "s.dim").agg(F.sum("s.value").alias("value"))
        sums = np.zeros((len(at), dims + 3), np.int64)
        for r in totals.collect():
            sums[r.cluster, r.dim] = r.value
        if n == rounds:
            break
        before, some = at, sums[:, dims] > 0
        at = at.copy()
        at[some] = sums[some, :dims] // sums[some, dims : dims + 1]
        moved, state = done, done.where("sums is null").select("row", "v", "cluster", "upper", "lower")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    parts = [(int(a) << 31) + int(b) for a, b in sums[:, dims + 1 :]]
    fits = lambda n: F.lit(min(n, (1 << 63) - 1)).cast("long")
    own = F.array(*[F.struct(fits(s).alias("inertia"), F.lit(d).alias("digest")) for s, d in zip(parts, digests)])
    of = F.element_at(own, F.col("cluster") + 1)
    return done.where("sums is null").select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], "cluster", "distance", of["inertia"].alias("cluster_inertia"), fits(sum(parts)).alias("inertia"), of["digest"].alias("centroid_sha256")
    )
