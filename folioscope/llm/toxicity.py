"""Toxicity by multiple-instance learning: a document is as toxic as noisy-or of its sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, U64, bounds, byte_values, chunks, mix, prefix, raw, spans_hash

#: Bits of a feature's index: the model is a table of 4 bytes for each, whatever the input.
BITS = 21
#: A word's features: itself and its first bytes.
HEADS = (4, 5, 6)
#: A feature counts if toxic and other documents have it at rates so many standard errors apart: of two million, hardly one by chance.
CERTAIN = 5.0
VALUES = byte_values(11, fold=True)
STOPS = np.zeros(256, np.int64)
STOPS[[ord(c) for c in ".!?\n"]] = 1


def sentences(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices (a row for each word), each sentence's first word, each row's first sentence, and word bounds.

    A sentence ends at `.`, `!`, `?`, a line's end or the row's end."""
    starts, ends, row_word = bounds(body, at, ALNUM)
    if not len(starts):
        return np.zeros((0, 1 + len(HEADS)), np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64), starts, ends
    c = prefix(body, VALUES)
    tag = lambda h, k: (mix(h + U64(k)) >> U64(64 - BITS)).astype(np.int64)
    features = np.stack([tag(spans_hash(c, starts, ends), 0), *[tag(spans_hash(c, starts, np.minimum(starts + n, ends)), n) for n in HEADS]], axis=1)
    stops = np.cumsum(STOPS[body])
    opens = np.ones(len(starts), bool)
    opens[1:] = stops[starts[1:]] > stops[starts[:-1]]
    inner = row_word[:-1]
    opens[inner[inner < len(starts)]] = True
    first = np.flatnonzero(opens)
    return features, first, np.searchsorted(first, row_word), starts, ends


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values from each of first to the next; first ends with len(values). Each is of its own values alone, so that a
    document's score doesn't depend on its neighbours."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(np.asarray(values, np.float64), first[:-1][some])
    return out


def train(texts: list[str], toxic: list[int], features: int = 20_000, rounds: int = 200, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Feature weights and bias. A sentence's probability is logistic in its words' weights, a document's is noisy-or
    of its sentences'; Adam lowers the documents' cross-entropy. Only the features that tell the labels apart best by
    document frequency get a weight."""
    y = np.array(toxic, float)
    table = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        return table, -20.0 if not len(y) or y.max() == 0 else 20.0
    here, there = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for text, label in zip(texts, toxic):
        (here if label else there)[np.unique(sentences(*raw(pa.array([text], pa.large_string())))[0])] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    pool = (here + there) / len(y)
    spread = np.abs(here / n1 - there / n0) / np.sqrt(np.maximum(pool * (1 - pool) * (1 / n1 + 1 / n0), 1e-12))
    able = np.flatnonzero((spread > CERTAIN) & (here + there >= 3))
    chosen = able[np.argsort(-spread[able], kind="stable")[:features]]
    slot = np.full(1 << BITS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    del here, there, pool, spread

    # Words are read again, not held: only the chosen features of a document stay.
    flat, sentence, docs, opened = [], [], [], 0
    for text in texts:
        f, first, _, _, _ = sentences(*raw(pa.array([text], pa.large_string())))
        of = np.repeat(np.arange(len(first), dtype=np.int32) + opened, np.diff(np.append(first, len(f))))
        at = slot[f]
        used = at >= 0
        flat.append(at[used])
        sentence.append(np.repeat(of[:, None], f.shape[1], axis=1)[used])
        docs.append(len(first))
        opened += len(first)
    flat, sentence = np.concatenate(flat), np.concatenate(sentence)
    document = np.repeat(np.arange(len(docs)), docs)
    w, b, n = np.zeros(len(chosen)), -4.0, opened
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    weight = np.full(len(y), 1 / len(y))
    for t in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[flat], n)
        ps = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        safe = np.bincount(document, np.logaddexp(0, z), len(docs))  # -log of the chance that no sentence is toxic
        # d loss / d safe: 1 for clean documents, -exp(-safe) / (1 - exp(-safe)) for toxic ones
        slope = weight * np.where(y == 1, -1 / np.expm1(np.clip(safe, 1e-9, 500)), 1.0)
        gz = slope[document] * ps
        g = np.append(np.bincount(flat, gz[sentence], len(chosen)) + decay * w, gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    table[chosen] = w
    return table, float(b)


def sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[list[str], list[int]]:
    """At most so many labelled documents, a third of them toxic if there are as many, by hash of id. Ids whose crc32 is
    divisible by 5 are held out; rows without a label or an id are left out; of a repeated id one row counts."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out("doc_id")).withColumn("order", F.xxhash64("doc_id"))
    pick = lambda label, n: known.where(F.col("toxic") == label).orderBy("order", "doc_id").limit(n)
    chosen = pick(1, most // 3).unionByName(pick(0, most - most // 3)).select(F.col("doc_id").alias("id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text or "" for r in rows], [int(r.toxic) for r in rows]


def held_out(name: str):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_batch(column: pa.Array, table: np.ndarray, bias: float) -> tuple[np.ndarray, list[list[list[int]]]]:
    """Scores, and for each row the byte bounds of its toxic sentences."""
    body, at = raw(column)
    f, first, row_first, starts, ends = sentences(body, at)
    closing = np.append(first, len(f))
    z = bias + sums(table[f].sum(axis=1, dtype=np.float64), closing)
    score = -np.expm1(-sums(np.logaddexp(0, z), row_first)) if len(z) else np.zeros(len(at) - 1)
    worst = []
    for i in range(len(at) - 1):
        a, b = row_first[i], row_first[i + 1]
        found = a + np.flatnonzero(z[a:b] > 0)
        if not len(found) and score[i] >= 0.5:
            found = [a + int(np.argmax(z[a:b]))]
        worst.append([[int(starts[first[k]] - at[i]), int(ends[closing[k + 1] - 1] - at[i])] for k in found])
    return np.clip(score, 0.0, 1.0), worst


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 6000) -> DataFrame:
    """Adds held_out, score, predicted and worst to documents(doc_id, text, ...), every whole text.

    The model is fitted on a bounded sample, `most` labelled documents (6,000 unless said otherwise), on the driver;
    it is a table of fixed size. worst: byte start and end of each sentence that is over a half by itself; if
    there is none, of the likeliest one where the document is predicted toxic, else empty. Labels, language, source and id are no inputs of a score.

    Null and empty texts score 0. A null id isn't held out. Without labels of both sorts the score is constant.
    Repeated rows each get the same score; an empty table gives none; input columns with added names are replaced.
    """
    table, bias = train(*sample(docs, labels, most))
    shipped = docs.sparkSession.sparkContext.broadcast((table, bias))
    added = ["held_out", "score", "predicted", "worst"]
    kept = [c for c in docs.columns if c not in added]
    source = docs.select(*[f"`{c}`" for c in kept], held_out("doc_id").alias("held_out"))

    def over(batches):
        table, bias = shipped.value
        for batch in batches:
            for part in chunks(batch, "text"):
                score, worst = score_batch(part.column("text"), table, bias)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(worst, pa.list_(pa.list_(pa.int32())))], names=[*kept, *added]
                )

    from pyspark.sql.types import StructType

    return source.mapInArrow(over, StructType(source.schema.fields + StructType.fromDDL("score double, predicted int, worst array<array<int>>").fields))
