"""Whole rows of the operators that SQL can't express, against plain readings of what they say."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from folioscope.llm import mixing, secrets, toxicity
from folioscope.llm.bytewords import raw
from folioscope.llm.secrets import scan_secrets
from folioscope.llm.toxicity import score_batch, sentences, train

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(23)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_secrets(spark):
    """Counts, digests, spans, verdicts: given documents with secrets of one owner, of few and of many, of one repository and of many."""
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    shared, own = "AKIA" + "Q7" * 10, [f"hunter-{i}-zebra" for i in range(40)]
    out = []
    for i, (doc, text, source) in enumerate(rows):
        extra = f"\npassword = '{own[i % 40]}'" * (i % 3 == 0) + f" key {shared} and" * (i % 7 == 0) + f" {'deadbeef' * 4}" * (i % 50 == 0) + f" TOKEN:{'x' * (i % 9)}" + " ghp_" + "Ab1" * 12 * (i % 11 == 0)
        out.append((doc, text + extra, source))
    out += [out[3], (None, out[0][1], None), (9001, None, "s"), (9002, "", None), (9003, "secret=abcdef secret=abcdef " + shared.lower(), None)]
    base = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6, lambda m: m[2]),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20, lambda m: m[0]), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24, lambda m: m[0]),
    }
    told, owners, repositories = [], defaultdict(set), defaultdict(set)
    for doc, text, source in out:
        found = [((m.start(), m.end(), kind), secret(m)) for kind, (pattern, ok, secret) in base.items() for m in pattern.finditer(text or "") if ok(m)]
        found += [((m.start(), m.end(), "token"), m[0]) for m in re.finditer("ghp_[A-Za-z0-9]{36,}", text or "")]
        found.sort(key=lambda f: (f[0][0], secrets.KINDS.index(f[0][2])))
        for _, x in found:
            if doc is not None:
                repositories[x].add((source, doc))  # a document of several owners is one repository of each
            if source is not None:
                owners[x].add(source)
        told.append((doc, source, found))
    copied = lambda x: len(owners[x]) >= 3 or len(repositories[x]) >= 20
    name = lambda s: f"{s[2]}:{s[0]}:{s[1]}"
    want = []
    for doc, source, found in told:
        spans = [s for s, _ in found if s[2] in base]
        kinds = [sum(s[2] == k for s in spans) for k in base]
        distinct = {x for _, x in found}
        want.append((doc, source, *kinds, sha(",".join(map(name, spans))), ",".join(name(s) for s, _ in found), sum(not copied(x) for x in distinct), sum(map(copied, distinct)), ",".join(f"{name(s)}:{'copied' if copied(x) else 'live'}" for s, x in found)))
    got = scan_secrets(spark.createDataFrame(out, "doc_id long, text string, source string"))
    columns = ["doc_id", "source", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied", "verdicts"]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert any(w[7] for w in want) and any(w[8] for w in want)


def plain_sentences(text):
    """Words by sentence: a sentence without words counts for nothing."""
    out = [[]]
    for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+|[.!?\n]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
        if m[0] in ".!?\n":
            out.append([])
        else:
            out[-1].append(m[0])
    return [s for s in out if s]


FEATURES = {}


def features(word):
    """A word's places in the table: those it has when it stands alone."""
    if word not in FEATURES:
        FEATURES[word] = sentences(*raw(pa.array([word], pa.large_string())))[0][0].tolist()
    return FEATURES[word]


def made(n):
    words = ["".join(RNG.choice(list("abcdeé"), RNG.integers(1, 9))) for _ in range(300)]
    out = []
    for i in range(n):
        text = "".join(str(RNG.choice(words)) + str(RNG.choice([" ", ". ", "! ", ", ", "\n"], p=[0.7, 0.1, 0.05, 0.1, 0.05])) for _ in range(RNG.integers(0, 60)))
        out.append(text + (" Grumpf zork. " if i % 3 == 0 else "") + (" zork" if i % 17 == 1 else ""))
    return out, [int(i % 3 == 0) for i in range(n)]


def test_toxicity_scores_and_training():
    """Weights by a plain descent over dictionaries, scores by a plain noisy-or, on 200 documents."""
    texts, labels = made(200)
    table, bias = train(texts, labels, rounds=40)
    docs = [[[f for w in s for f in features(w)] for s in plain_sentences(t)] for t in texts]
    sets = [{f for s in d for f in s} for d in docs]
    n1, n0 = sum(labels), len(labels) - sum(labels)
    chosen = {}
    for f in set().union(*sets):
        here, there = sum(f in s and y for s, y in zip(sets, labels)), sum(f in s and not y for s, y in zip(sets, labels))
        pool = (here + there) / len(labels)
        spread = abs(here / n1 - there / n0) / math.sqrt(max(pool * (1 - pool) * (1 / n1 + 1 / n0), 1e-12))
        if spread > toxicity.CERTAIN and here + there >= 3:
            chosen[f] = 0.0
    assert chosen and set(np.flatnonzero(table)) <= set(chosen)
    w, b, m, v = dict(chosen), -4.0, defaultdict(float), defaultdict(float)
    for t in range(1, 41):
        g = {f: 2e-4 * x for f, x in w.items()} | {"b": 0.0}
        for d, y in zip(docs, labels):
            z = [b + sum(w.get(f, 0.0) for f in s) for s in d]
            safe = sum(math.log1p(math.exp(x)) for x in z)
            slope = (1.0 if not y else -1 / math.expm1(min(max(safe, 1e-9), 500))) / len(labels)
            for s, x in zip(d, z):
                p = slope / (1 + math.exp(-x))
                g["b"] += p
                for f in s:
                    if f in w:
                        g[f] += p
        for f, x in g.items():
            m[f], v[f] = 0.9 * m[f] + 0.1 * x, 0.999 * v[f] + 0.001 * x * x
            step = 0.1 * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.999**t)) + 1e-10)
            if f == "b":
                b -= step
            else:
                w[f] -= step
    assert math.isclose(b, bias, rel_tol=1e-6) and all(math.isclose(w[f], table[f], rel_tol=1e-4, abs_tol=1e-6) for f in w)
    more = [*texts, "", None, "...", "zork", "x " * 30_000 + "Grumpf zork."]
    got, worst = score_batch(pa.array(more), table, bias)
    for text, score, places in zip(more, got, worst):
        z = [bias + sum(float(table[f]) for word in s for f in features(word)) for s in plain_sentences(text or "")]
        assert math.isclose(score, 1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z), rel_tol=1e-6, abs_tol=1e-9)
        assert len(places) == (sum(x > 0 for x in z) or (1 if score >= 0.5 else 0))


def test_mix_keeps_its_contract(spark):
    """Not how, but what: sizes, targets by sharing out, words taken near the targets, no document over twice, reruns and other partitions agree."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, "a b c", None), (None, "a b c", None), (7000, None, "zz"), (7001, "one two", "zz"), (7002, " ", "zz"), (7003, "x", "ü")], docs.schema)
    docs = docs.unionByName(odd)
    runs = [sorted(map(tuple, mixing.mix_sources(d).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=repr) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r[0], r[2]) for r in runs[0] if r[0] is not None) == sorted((r.doc_id, size(r.text)) for r in docs.collect() if r.doc_id is not None)
    sizes = defaultdict(int)
    for _, source, n, *_ in runs[0]:
        sizes[source] += n
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, total = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values())
    full, target = set(), {}
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = left / sum(weight[s] for s in names if s not in full) if len(full) < len(names) else 0
        over = {s for s in names if s not in full and weight[s] * share > 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * sizes[s] if s in full else weight[s] * share for s in names}
    taken = defaultdict(int)
    for _, source, n, source_size, goal, words in runs[0]:
        assert source_size == sizes[source] and math.isclose(goal, target[source], rel_tol=1e-9) and 0 <= words <= 2 * n
        taken[source] += words
    largest = max(r[2] for r in runs[0])
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in names)
