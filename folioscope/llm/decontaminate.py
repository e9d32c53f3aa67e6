"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .bytewords import ALNUM, U64, bounds, byte_values, chunks, prefix, raw, runs, sha_hex, spans_hash
from .common import LOWER, UPPER, Scratch

FOLD = str.maketrans(UPPER, LOWER)
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
VALUES = byte_values(29, fold=True)
#: Words of the runs by which places worth a look are found first; fewer if an item is shorter.
GRAM = 4


def item_words(text: str) -> list[str]:
    return WORD.findall(text.translate(FOLD))


class Automaton:
    """Suffix automaton of several word sequences, with the items that have each window."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[str, int] = {}
        self.items: dict[tuple[int, int], list[int]] = {}
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self.extend(last, w)
        self.sizes = sorted({min(window, len(words)) for _, words in coded})
        self.top = max(self.sizes, default=0)
        for item, words in coded:
            size, state, matched = min(window, len(words)), 0, 0
            for w in words:
                state, matched = self.cut(*self.step(state, matched, w))
                if matched >= size:
                    found = self.items.setdefault((self.holding(state, size), size), [])
                    if not found or found[-1] != item:
                        found.append(item)
        self.gram = min([GRAM, *self.sizes]) if coded else GRAM
        grams = [self.grams([words for _, words in items if len(words) >= self.gram])] if coded else []
        self.known = np.unique(np.concatenate(grams)) if grams else np.zeros(0, U64)

    def grams(self, items: list[list[str]]) -> np.ndarray:
        body, at = raw(pa.array([" ".join(words) for words in items], pa.large_string()))
        starts, ends, row_word = bounds(body, at, ALNUM)
        return inside(runs(spans_hash(prefix(body, VALUES), starts, ends), row_word, self.gram), row_word, self.gram)[0]

    def add(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def extend(self, last: int, w: int) -> int:
        """The state of the sequence of last followed by w."""
        if (there := self.next[last].get(w)) is not None:
            return there if self.length[there] == self.length[last] + 1 else self.split(last, w, there)
        new, p = self.add(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, w, q)
        return new

    def split(self, p: int, w: int, q: int) -> int:
        copy = self.add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """The state and length of the longest match that ends with w."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], matched + 1
        return 0, 0

    def cut(self, state: int, matched: int) -> tuple[int, int]:
        """The match, cut to its last words if it is longer than the largest window. Each word adds one link at most to the way
        back that a state has, and a cut goes back along it, so that a text of n words takes n steps, however it repeats."""
        if matched > self.top:
            matched = self.top
            while self.length[self.link[state]] >= self.top:
                state = self.link[state]
        return state, matched

    def holding(self, state: int, size: int) -> int:
        """The state of the last size words of a match that is cut."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def hits(self, words: list[str]) -> tuple[np.ndarray, set[int]]:
        """Which words any window covers, and the items that have those windows."""
        cover, found, state, matched = np.zeros(len(words), bool), set(), 0, 0
        for i, word in enumerate(words):
            w = self.ids.get(word, -1)
            state, matched = self.cut(*self.step(state, matched, w)) if w >= 0 else (0, 0)
            for size in self.sizes:
                if size > matched:
                    break
                if items := self.items.get((self.holding(state, size), size)):
                    cover[i + 1 - size : i + 1] = True
                    found.update(items)
        return cover, found


def inside(grams: np.ndarray, row_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Those runs of size words that lie in one row, and their first words."""
    at = np.arange(len(grams))
    ok = row_word[np.searchsorted(row_word, at, "right")] >= at + size if len(grams) else np.zeros(0, bool)
    return grams[ok], at[ok]


def scan(column: pa.Array, a: Automaton | None) -> tuple[np.ndarray, list[np.ndarray], list[set[int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's first word, covered words, items found; word bounds, bytes and row offsets."""
    body, at = raw(column)
    starts, ends, row_word = bounds(body, at, ALNUM)
    words = spans_hash(prefix(body, VALUES), starts, ends) if len(starts) else np.zeros(0, U64)
    cover, found = np.zeros(len(starts), bool), [set() for _ in range(len(at) - 1)]
    if a is None or not len(a.known):
        return row_word, cover, found, starts, ends, body, at
    grams, first = inside(runs(words, row_word, a.gram), row_word, a.gram)
    seen = np.zeros(1 << 20, bool)
    seen[(a.known >> U64(44)).astype(np.int64)] = True
    likely = np.flatnonzero(seen[(grams >> U64(44)).astype(np.int64)])
    likely = likely[a.known[np.minimum(np.searchsorted(a.known, grams[likely]), len(a.known) - 1)] == grams[likely]]
    hit = first[likely]
    row = np.searchsorted(row_word, hit, "right") - 1
    cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(row) > 0))
    for i, j in zip(np.append(0, cut + 1), np.append(cut, len(hit) - 1)) if len(hit) else ():
        lo, hi = hit[i], hit[j] + a.gram
        if hi - lo >= a.sizes[0]:
            c, items = a.hits([body[starts[k] : ends[k]].tobytes().decode("utf-8", "replace").translate(FOLD) for k in range(lo, hi)])
            cover[lo:hi] |= c
            found[row[i]] |= items
    return row_word, cover, found, starts, ends, body, at


def without(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, cover: np.ndarray) -> str:
    """The row's text without its covered runs of words."""
    edge = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
    keep = np.ones(len(body), bool)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        keep[starts[a] : ends[b - 1]] = False
    return body[keep].tobytes().decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_words: int = 0, most_share: float = 0.5, clean: bool = True, block_words: int = 200_000) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated, and with clean also clean_text and rejected, to
    documents(text, ...).

    benchmark(item_id, text): each item's windows are its runs of `window` words, or all of it if it has fewer, but not
    none. The automaton's longest match at each word tells the windows that end there. clean_text is the text without
    the covered spans longer than most_words words; rejected: more than most_share of the words are covered.

    Only places where runs of up to four words are known from an item are streamed through the automaton; any window
    consists of such runs. The benchmark is a test set, not a corpus: it comes to the driver, block by block of block_words words. Each block makes an
    automaton that is broadcast, passed over by all documents and dropped before the next; between two, the documents are written with what was covered so far,
    and the last pass tells it. So a benchmark of any size is held one automaton at a time, and one of a single block takes a single pass.

    Null and empty texts have no words and aren't contaminated; items without words are no items; an item with a null
    id counts in n_items but isn't listed; rows with the same id are items of their own; repeated documents each get a
    row; empty tables work; input columns with added names are replaced.
    """
    spark = docs.sparkSession
    added = StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", clean_text string, rejected boolean" * clean)
    kept = [c for c in docs.columns if c not in added.names]
    carried = []
    for name, kind in (("covered", "binary"), ("found", "array<int>")):
        while name in kept:
            name += "_"
        carried.append((name, kind))
    source = docs.select(*[f"`{c}`" for c in kept])
    rows, named, scratch = source, [], Scratch(spark, "decontaminated")

    def blocks():
        held, size = [], 0
        for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
            if words := item_words(r.text or ""):
                held.append((len(named), words))
                named.append(None if r.item_id is None else str(r.item_id))
                size += len(words)
            if size >= block_words:
                yield held
                held, size = [], 0
        yield held

    def passed(index, names, later: bool):
        """One pass. names: of all items, in the last pass. later: a pass before has left what it covered and found."""

        def over(batches):
            automaton = pickle.loads(index.value)
            for part in (p for batch in batches for p in chunks(batch, "text")):
                row_word, cover, found, starts, ends, body, at = scan(part.column("text"), automaton)
                n = np.diff(row_word)
                if later:
                    for i, (bits, items) in enumerate(zip(part.column(carried[0][0]).to_pylist(), part.column(carried[1][0]).to_pylist())):
                        if items:
                            cover[row_word[i] : row_word[i + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n[i]).astype(bool)
                            found[i].update(items)
                own = [part.column(c) for c in kept]
                if names is None:
                    bits = [np.packbits(cover[a:b]).tobytes() if f else b"" for f, a, b in zip(found, row_word[:-1], row_word[1:])]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(bits, pa.binary()), pa.array([sorted(f) for f in found], pa.list_(pa.int32()))], names=[*kept, *(c for c, _ in carried)])
                    continue
                c = np.concatenate([[0], np.cumsum(cover)])
                hit = c[row_word[1:]] - c[row_word[:-1]]
                told = names.value
                listed = [sha_hex(",".join(sorted(told[i] for i in f if told[i] is not None)).encode()) for f in found]
                columns = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(listed), pa.array(hit > 0)]
                if clean:
                    texts = part.column("text").to_pylist()
                    for i in np.flatnonzero(hit):
                        a, b = row_word[i], row_word[i + 1]
                        texts[i] = without(body[at[i] : at[i + 1]], starts[a:b] - at[i], ends[a:b] - at[i], longer(cover[a:b], most_words))
                    columns += [pa.array(texts, pa.string()), pa.array(hit > most_share * n)]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=[*kept, *added.names])

        return over

    parts, before = blocks(), None
    block = next(parts)
    while True:
        following = next(parts, None)
        index = spark.sparkContext.broadcast(cloudpickle.dumps(Automaton(block, window)))
        if not following:
            return rows.mapInArrow(passed(index, spark.sparkContext.broadcast(named), before is not None), StructType(source.schema.fields + added.fields))
        between = StructType(source.schema.fields + StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in carried)).fields)
        rows = scratch.save(rows.mapInArrow(passed(index, None, before is not None), between))
        index.destroy()
        if before is not None:
            scratch.drop(before)
        before, block = rows, following


def longer(cover: np.ndarray, words: int) -> np.ndarray:
    """The covered runs of more than so many words."""
    edge = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
    out = np.zeros(len(cover), bool)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        if b - a > words:
            out[a:b] = True
    return out
