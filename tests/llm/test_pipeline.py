"""The pipeline's stages and run() against brute force on a small folder of tables, with nulls, repeated rows and clashing columns."""

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as pipeline  # noqa: E402

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(2000)]
CLASHING = ["h", "i", "k", "_k", "_times", "_row", "row", "doc", "times", "of", "id", "size", "score", "rejected", "n_hit"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose(14)
    clean = [prose(60) + ". " + prose(30) for _ in range(150)]
    toxic = [prose(40) + ". " + prose(5) + " vileword foulword " + prose(5) + ". " + prose(20) for _ in range(90)]
    near = [clean[0] + " tail", clean[1], clean[1]]
    leaks = [prose(50) + " " + item + " " + prose(40), item.upper()]
    texts = [*clean, *toxic, *near, *leaks, None, "", " \n", "word"]
    rows = [(i, t, "en", ["s1", None, "s0"][i % 3], None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, clean[4], None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(150 <= i < 240)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item, rows


def read(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def clashing(docs):
    return docs.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(CLASHING)])


def plain(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


@pytest.mark.parametrize("name,stage", pipeline.STAGES[:-1])
def test_columns_and_empty_tables(spark, folder, name, stage):
    docs = clashing(read(spark, folder[0]))
    found = stage(spark, docs, folder[0])
    assert found.columns == docs.columns
    assert {tuple(r[c] for c in CLASHING) for r in found.collect()} == {tuple(range(len(CLASHING)))}
    assert stage(spark, docs.where("false"), folder[0]).count() == 0


def test_toxicity(spark, folder):
    path, _, rows = folder
    want = Counter((r[0], r[1], r[3]) for r in rows if "vileword" not in (r[1] or ""))
    assert plain(pipeline.toxicity(spark, read(spark, path), path)) == want


def test_near_duplicates(spark, folder):
    path, _, rows = folder
    kept = plain(pipeline.near_duplicates(spark, read(spark, path), path))
    sets = []
    for r in rows:
        w = re.findall(r"\S+", (r[1] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    groups = []
    for i, s in enumerate(sets):
        mine = [g for g in groups if any(s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]) for j in g)]
        groups = [g for g in groups if g not in mine] + [sum(mine, [i])]
    for g in groups:
        assert sum(kept[(rows[i][0], rows[i][1], rows[i][3])] for i in {min(j for j in g if rows[j][:4] == rows[i][:4]) for i in g}) == 1 or not sets[g[0]]
    assert sum(kept.values()) == len(groups)


def test_decontamination(spark, folder):
    path, item, rows = folder
    words = item.split()
    windows = {" ".join(words[i : i + 10]) for i in range(len(words) - 9)}
    want = Counter((r[0], r[1], r[3]) for r in rows if not any(w in (r[1] or "").lower() for w in windows))
    assert sum(want.values()) == len(rows) - 2
    assert plain(pipeline.decontamination(spark, read(spark, path), path)) == want


def test_mixing(spark, folder):
    """Copies of a row are two at most; each source's words come near its target, by whole documents."""
    path, _, rows = folder
    taken = plain(pipeline.mixing(spark, read(spark, path), path))
    size = lambda t: len(re.findall(r"\S+", t or ""))
    given = Counter((r[0], r[1], r[3]) for r in rows)
    assert all(n <= 2 * given[k] and size(k[1]) for k, n in taken.items())
    of = lambda c: {s: sum(n * size(k[1]) for k, n in c.items() if k[2] == s) for s in ("s0", "s1", None)}
    have, goal = of(given), {}
    weights, left, most = {"s0": 5, "s1": 2, None: 1}, 1.5 * sum(of(given).values()), 2.0
    while weights:
        level = left / sum(weights.values())
        full = [s for s in weights if level * weights[s] > most * have[s]]
        for s in full or list(weights):
            goal[s] = most * have[s] if full else level * weights[s]
            left -= goal[s]
            del weights[s]
    longest = max(size(r[1]) for r in rows)
    for s, n in of(taken).items():
        assert abs(n - goal[s]) <= 4 * longest + 0.05 * goal[s], (s, n, goal)


def test_run(spark, folder):
    path, item, rows = folder
    got = pipeline.run(spark, path)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    out = got.collect()
    assert out and not any("vileword" in r.text or item in r.text.lower() for r in out)
    assert {(r.doc_id, r.text) for r in out} <= {(r[0], r[1]) for r in rows}
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert all(len({r.shard for r in out if r.text == t}) == 1 for t in {r.text for r in out})
