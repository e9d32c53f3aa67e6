"""The corpus operators against brute force on small cases, odd inputs included."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import embeddings, pii, repeats, secrets
from folioscope.llm.bytewords import raw
from folioscope.llm.common import Scratch, components
from folioscope.llm.decontaminate import Automaton, decontaminate
from folioscope.llm.embeddings import link_embeddings
from folioscope.llm.mixing import mix_sources
from folioscope.llm.neardup import keep_one, near_duplicates
from folioscope.llm.repeats import remove_repeats
from folioscope.llm.secrets import scan_secrets
from folioscope.llm.sharding import LARGE, place_cuts, shard_documents, write_shards
from folioscope.llm.toxicity import BITS, score_batch, score_toxicity, sentences
from folioscope.llm.urlfilter import RULES, filter_urls, rule_table

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(3000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard long, k_id long, node string"


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def edited(text, share):
    words = text.split(" ")
    for i in RNG.choice(len(words), int(len(words) * share), replace=False):
        words[i] = "Z" + words[i]
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    base = [prose(150) for _ in range(6)]
    texts = [*base, *[edited(b, s) for b in base for s in (0.005, 0.01, 0.02, 0.05)], base[0], base[0], None, None, "", " \n", "one two", "One  two", "x", prose(4000), "ab" * 600, "é" * 500, base[1] + " tail"]
    rows = [(i, t, "en", ["s1", None, "s0"][i % 3], None, 7, 8, 9, "n") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base[2], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def covered(texts, size, told):
    """Bytes of each text in strings of the size that the test of their places tells."""
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - size + 1):
            seen.setdefault(t[k : k + size], []).append(i)
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - size + 1):
            if told(seen[t[k : k + size]]):
                gone[k : k + size] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("block", [repeats.BLOCK, 5])
def test_repeats(spark, corpus, monkeypatch, block):
    """All columns, also where cores' surroundings are cut into blocks of five."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    shared = [prose(55), prose(80), prose(45)]
    more = [(100 + i, " ".join([prose(12), shared[i % 3], prose(9 + i), *[shared[1]] * (i % 5 == 0)]), *[None] * 7) for i in range(14)]
    corpus = [*corpus, *more, (200, prose(60) + "." + prose(5), *[None] * 7)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in remove_repeats(spark.createDataFrame(corpus, SCHEMA)).collect()), key=repr)
    texts = [(r[1] or "").encode() for r in corpus]
    names = [(r[0], t) for r, t in zip(corpus, texts)]
    runs = lambda gone: [(int(a), int(b)) for a, b in zip(np.flatnonzero(np.diff(np.pad(gone.astype(int), 1)) == 1), np.flatnonzero(np.diff(np.pad(gone.astype(int), 1)) == -1))]
    want = []
    for row, t, gone, short in zip(corpus, texts, covered(texts, 400, lambda x: len(x) > 1), covered(texts, 256, lambda x: len({names[i] for i in x}) > 1)):
        passages = sum(len(re.findall(rb"[^\x20\x09-\x0D]+", t[a:b])) > 50 for a, b in runs(short))
        want.append((row[0], len(t), int(gone.sum()), len(runs(gone)), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest(), passages))
    assert sum(w[-1] > 0 for w in want) > 12
    assert got == sorted(want, key=repr)
    assert remove_repeats(empty(spark)).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_near_duplicates(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    sets = [shingles(r[1]) for r in corpus]
    of = list(range(len(corpus)))
    for _ in corpus:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    of[i] = of[j] = min(of[i], of[j])
    least = {}
    for i, r in enumerate(corpus):
        if r[0] is not None:
            least[of[i]] = min(least.get(of[i], r[0]), r[0])
    want = sorted(((r[0], len(sets[i]), least.get(of[i]) if sets[i] else r[0]) for i, r in enumerate(corpus)), key=repr)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=repr)
    assert got == want
    kept = keep_one(docs.selectExpr("*", "1 AS h", "2 AS i", "3 AS _k", "4 AS doc", "5 AS worded", "6 AS s_k"))
    assert kept.columns == [*docs.columns, "h", "i", "_k", "doc", "worded", "s_k"]
    assert kept.count() == len({of[i] for i, s in enumerate(sets) if s}) + sum(not s for s in sets)
    assert near_duplicates(empty(spark)).count() == 0


def test_keep_one_of_each_component(spark):
    """Texts that don't link stay, though component_id is null or the same for them."""
    a, b, c, d = (prose(100) for _ in range(4))
    rows = [(None, a), (None, a), (None, edited(a, 0.01)), (None, b), (7, c), (8, edited(c, 0.01)), (7, d), (9, edited(d, 0.01)), (None, ""), (None, None)]
    kept = [(r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 6
    assert {(None, b), (7, c), (7, d), (None, ""), (None, None)} < set(kept)
    assert sum(r in kept for r in rows[1:3]) == 1


def test_mixing(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    got = mix_sources(docs).collect()
    assert len(got) == len(corpus)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in got)
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows) and rows[0].target <= 2 * rows[0].source_size
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mix_sources(docs.repartition(3)).collect()))
    assert mix_sources(empty(spark)).count() == 0


def base_pii(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_base_spans():
    parts = ["a@b.c", "@", "+", "1.2.3.4", ".", "255", "4111 1111 1111 1111", "-", " ", "+1 (212) 555-0199", "x", "é", "0", "a@b@c.de", "1.2.3.4.5.6.7.8", "%"]
    for _ in range(3000):
        text = "".join(RNG.choice(parts, RNG.integers(0, 12)))
        assert sorted(s for s in pii.find(text) if s[2] in pii.BASE) == base_pii(text), text


def test_secrets_base_spans():
    parts = ["token", "=", ": ", "abcdef12", "AKIA", "ABCDEFGH12345678", "password", '"', "deadbeefdeadbeefdeadbeef", " ", "api_key", "xyz", "SECRET"]
    patterns = {"assign": (secrets.ASSIGN.pattern, re.A | re.I, lambda m: len(m[1]) >= 6), "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24)}
    for _ in range(2000):
        text = "".join(RNG.choice(parts, RNG.integers(0, 12)))
        want = sorted((m.start(), m.end(), k) for k, (p, flags, ok) in patterns.items() for m in re.finditer(p, text, flags) if ok(m))
        assert sorted(s for s, _ in secrets.find(text) if s[2] in secrets.BASE) == want, text


def test_secret_owners(spark):
    rows = [(i, "password=hunter2222", f"s{i}") for i in range(5)] + [(9, "token: mine123456", "s1"), (9, "token: mine123456", "s1"), (None, None, None), (8, "", "s2")]
    got = {(r.doc_id, r.n_live, r.n_copied) for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {(i, 0, 1) for i in range(5)} | {(9, 1, 0), (None, 0, 0), (8, 0, 0)}


BODY = "".join(RNG.choice(list("ABCDwxyz0189+/"), 1600))


def pem(body, kind="RSA ", gap="\n"):
    return f"-----BEGIN {kind}PRIVATE KEY-----{gap}" + gap.join(body[i : i + 64] for i in range(0, len(body), 64)) + f"{gap}-----END {kind}PRIVATE KEY-----"


def test_secret_keys():
    found = lambda t: [(t[a:b], x) for (a, b, k), x in secrets.find(t) if k == "key"]
    short, long = pem(BODY[:64], ""), pem(BODY)
    assert found(f"a {short} b\n{long}\nc") == [(short, BODY[:64]), (long, BODY)]
    for gap in ("\r\n", " ", "\\n", "\n    "):
        assert found(f'x "{pem(BODY, gap=gap)}" y') == [(pem(BODY, gap=gap), BODY)]
    cut = long[: long.index("-----END") - 30]
    whole = "".join(cut.split("\n")[1:])
    assert found(cut + "\n") == found(cut) == [(cut, whole)]
    assert found(cut[: cut.rindex("\n")] + "\nThen the story goes on.")[0][0] == cut[: cut.rindex("\n")]
    assert found(f"{cut}\n{short} {long}") == [(cut, whole), (short, BODY[:64]), (long, BODY)]
    assert found("It opens with -----BEGIN PRIVATE KEY----- as a rule") == found("") == []


def test_secret_key_owners(spark):
    """Copies of a key are one secret whatever follows; keys that begin alike are several."""
    rows = [(i, f"{pem(BODY[:64], '')}\n{prose(9)}", f"s{i}") for i in range(4)] + [(10 + i, pem(BODY[:400] + BODY[500 + 90 * i : 590 + 90 * i]), f"s{i}") for i in range(4)]
    got = {(r.doc_id, r.n_live, r.n_copied) for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {(i, 0, 1) for i in range(4)} | {(10 + i, 1, 0) for i in range(4)}


def test_pii_rows(spark, corpus):
    """Counts, digest and joined spans of every row; base spans are those of the patterns."""
    rows = [*corpus, (300, "a@b.org, +1 212 555 0199; 1.2.3.4 é card 4111 1111 1111 1111", *[None] * 7)]
    got = pii.find_pii(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter()
    for r in rows:
        base = sorted(base_pii(r[1] or ""), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        want[(r[0], *[sum(s[2] == k for s in base) for k in pii.BASE], digest)] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert {r.spans for r in got if r.doc_id == 300} == {"email:0:7,phone:9:24,ip:26:33,card:41:60"}
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_identifiers():
    found = lambda t: [(t[a:b], k) for a, b, k in sorted(pii.find(t)) if k not in pii.BASE]
    assert found("account no. 12345678, then") == [("12345678", "account")]
    assert found("Acct no: DE89370400440532013000.") == [("DE89370400440532013000", "account")]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 BIC: COBADEFFXXX") == [("DE89 3704 0044 0532 0130 00", "account"), ("COBADEFFXXX", "account")]
    assert found("IBAN DE88370400440532013000; routing number 021000021, routing 021000022") == [("021000021", "account")]
    assert found("SSN 123-45-6789, ssn: 000-45-6789; my Passport is C01X00T47") == [("123-45-6789", "identity"), ("C01X00T47", "identity")]
    assert found("mailto:ann@b.org?x tel:+1-212-555-0199 https://u:p@host.org/x http://a.org:80/ sms:12") == [("ann@b.org", "address"), ("+1-212-555-0199", "address"), ("u:p@host.org", "address")]
    assert found("myaccount 12345678 accounts 12345678 account holder") == []


@pytest.mark.parametrize("unit", ["mailto:", "://", "tel:1", "IBAN ", "account no ", "+1", "a@", "1.", "http://a:b"])
def test_pii_long_texts(unit):
    """Work follows the length: a text of a megabyte takes some seconds at most, however its anchors crowd."""
    import time

    begun = time.time()
    pii.find(unit * (1_000_000 // len(unit)))
    assert time.time() - begun < 8


def test_pii_without_the_package(tmp_path):
    """Executors need not have this package installed."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from pyspark.sql import SparkSession
from folioscope.llm.pii import find_pii
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("EMAILS", find_pii(spark.createDataFrame([(1, "a@b.org")], "doc_id long, text string")).first().n_email)
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "EMAILS 1" in out.stdout, out.stderr[-2000:]


def test_secret_verdicts(spark):
    rows = [(i, "password=hunter2222", f"s{i}") for i in range(3)] + [(9, "token: mine123456 password=hunter2222", "s1"), (8, None, "s2")]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[9].verdicts == "assign:0:17:live,assign:18:37:copied"
    assert (got[0].verdicts, got[8].verdicts) == ("assign:0:19:copied", "")
    assert got[9].base_sha256 == hashlib.sha256(b"assign:0:17,assign:18:37").hexdigest()
    assert secrets.find("eyJ-" * 250_000) == []


def test_scores_of_documents_alone():
    """A score doesn't depend on the texts beside it."""
    table = RNG.standard_normal(1 << BITS).astype(np.float32)
    texts = [". ".join(prose(int(n)) for n in RNG.integers(1, 30, 8)) for _ in range(60)] + ["", "one"]
    together, _ = score_batch(pa.array(texts, pa.string()), table, -3.0)
    alone = [score_batch(pa.array([t], pa.string()), table, -3.0)[0][0] for t in texts]
    assert together.tolist() == alone


def test_smallest_largest_shard(spark, monkeypatch):
    """With thousands of small groups, the largest shard is the least that the order of groups allows."""
    from folioscope.llm import sharding

    monkeypatch.setattr(sharding, "LARGE", 64)
    sizes = np.maximum(1, (RNG.pareto(1.1, 3000) * 20).astype(int))
    groups = [(hashlib.sha256(str(i).encode()).hexdigest(), int(n)) for i, n in enumerate(sizes)]
    of_large, starts = place_cuts(spark.createDataFrame(groups, "digest string, bytes long"), 16)
    total = sum(n for _, n in groups)
    large = sorted(((n, d) for d, n in groups if n * 64 >= total), reverse=True)
    order = [n for n, _ in large] + [n for d, n in sorted(groups) if n * 64 < total]
    assert set(of_large) == {d for _, d in large}
    shards = Counter()
    for d, n in groups:
        shards[of_large[d] if d in of_large else sum(d >= s for s in starts)] += n

    def feasible(capacity):
        used, at = 1, 0
        for n in order:
            if n > capacity:
                return False
            used, at = (used + 1, n) if at + n > capacity else (used, at + n)
        return used <= 16

    assert feasible(max(shards.values())) and not feasible(max(shards.values()) - 1)


def test_embeddings(spark):
    x = RNG.standard_normal((40, 16))
    x = np.concatenate([x, x[:20] + 0.05 * RNG.standard_normal((20, 16)), x[:5] * 3, x[:3]])
    rows = [(i, v.astype(np.float32).tolist(), int(i % 2)) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 0), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (None, rows[0][1], 0), rows[1]]
    every = rows + odd
    got = link_embeddings(spark.createDataFrame(every, "vec_id long, embedding array<float>, label int")).collect()
    ok = [(i, v) for i, v in enumerate(every) if v[1] and v[2] is not None and all(c is not None and np.isfinite(c) for c in v[1]) and any(v[1])]

    def cos(a, b):
        a, b = np.array(a, float), np.array(b, float)
        return len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93

    usable = {i for i, _ in ok}
    want = Counter((v[0], sum(j != i and w[2] == v[2] and cos(v[1], w[1]) for j, w in ok) if i in usable else 0) for i, v in enumerate(every))
    assert Counter((r.vec_id, r.n_links) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    of = {i: i for i in usable}
    for _ in ok:
        for i, v in ok:
            for j, w in ok:
                if w[2] == v[2] and cos(v[1], w[1]):
                    of[i] = of[j] = min(of[i], of[j])
    least = {}
    for i, v in ok:
        if v[0] is not None:
            least[of[i]] = min(least.get(of[i], v[0]), v[0])
    assert Counter((r.vec_id, r.component_id) for r in got) == Counter((v[0], least.get(of[i]) if i in usable else v[0]) for i, v in enumerate(every))
    assert link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def linked_by_brute_force(x, least=0.93):
    """Each vector's links and the smallest place in its component."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
        if (lower == root).all():
            return linked.sum(axis=1), root
        root = lower


@pytest.mark.parametrize("part, tile, crowded", [(4096, 2048, 10_000), (150, 64, 10_000), (150, 64, 0)])
def test_embedding_clusters(spark, monkeypatch, part, tile, crowded):
    """Planted pairs close to the threshold, a dense cluster, chains whose ends don't link; cells in parts, filters in tiles."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(embeddings, "PART", part)
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "CROWDED", crowded)
    base = rng.standard_normal((300, 64))
    close = base[:150] + 0.33 * rng.standard_normal((150, 64))
    cluster = rng.standard_normal(64) + 0.15 * rng.standard_normal((400, 64))
    turns = np.radians(20) * np.arange(12)
    planes = [np.linalg.qr(rng.standard_normal((64, 2)))[0] for _ in range(20)]
    chains = [np.cos(t) * p[:, 0] + np.sin(t) * p[:, 1] for p in planes for t in turns]
    x = np.concatenate([base, close, cluster, chains]).astype(np.float32)
    got = link_embeddings(spark.createDataFrame([(i, v.tolist(), 3, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, node int")).collect()
    links, roots = linked_by_brute_force(x.astype(float))
    assert len(got) == len(x) and links[:300].any() and links[450:850].min() > 100 and links[850:].min() > 0
    by = {r.vec_id: r for r in got}
    assert sum(by[i].n_links for i in range(len(x))) >= 0.99 * links.sum()
    assert all(by[i].n_links <= links[i] for i in range(len(x)))
    assert np.mean([by[i].component_id == roots[i] for i in range(len(x))]) >= 0.99


def test_smallest_reached():
    """A chain 1-10-5-2, in which no vector's smallest neighbour tells of the link between 5 and 10."""
    nodes = np.array([1, 10, 5, 2])
    linked = np.zeros((4, 4), bool)
    for a, b in ((0, 1), (1, 2), (2, 3)):
        linked[a, b] = linked[b, a] = True
    assert all((side == 1).all() for side in embeddings.smallest_reached(linked, nodes, nodes))


def test_urls(spark):
    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")

    cases = ["http://a.example.net/en/x", "http://EXAMPLE.net/", "https://example.net/en", "http://net/", "http://x.org/fr/1?q", "http://x.com/de/", "http://b.example.com/de/#t", "http://org", "none", "", None, "http://u:p@h.net:80/x", "a://b://c.net/", "http://example.net/en/x", "http://example.net/en/x", "http://x\n.net/y"]
    rows = [(i, u, "c", "d") for i, u in enumerate(cases)]
    out = filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, html string"), rule_table(spark, RULES))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {i: judge(u) for i, u in enumerate(cases)}


def test_hot_urls(spark):
    """A hot URL, with a rule or without, null or not, is judged like any other, in each of its rows."""
    of = lambda i: [None, "http://x.net/a", "none", f"http://h{i}.org/fr/{i}", "http://y.com/"][i % 5]
    docs = spark.createDataFrame([(i, of(i), "c") for i in range(6000)], "page_id long, url string, hot string").repartition(7)
    out = {r.page_id: r for r in filter_urls(docs, rule_table(spark, RULES)).collect()}
    assert len(out) == 6000 and all(r.url == of(i) and r.hot == "c" for i, r in out.items())
    rules = [(None, "allow"), ("net/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow")]
    assert all((r.rule, r.verdict) == rules[i % 5] for i, r in out.items())
    assert filter_urls(docs.limit(0), rule_table(spark, RULES)).count() == 0


def test_components(spark):
    """Chains whose values ascend are contracted in a few rounds; rings, stars, self-links and repeated links."""
    chain = [(i, i + 1) for i in range(400)]
    ring = [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)]
    star = [(2000, 2000 + i) for i in range(1, 60)]
    links = chain + ring + star + [(3000, 3000), (5000, 4000), (4000, 5000), (5000, 4000)]
    scratch = Scratch(spark, "components")
    found = components(scratch, spark.createDataFrame(links, "u long, v long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert len(found) == sum(map(len, groups.values()))
    assert sorted(map(sorted, groups.values())) == [list(range(401)), list(range(1000, 1050)), list(range(2000, 2060)), [4000, 5000]]
    assert all(root in nodes for root, nodes in groups.items())
    assert scratch.n < 2 * 20
    assert components(scratch, spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(40) + ". " + ("you grobnik fool " if bad else "") + prose(30) + ".", 3))
        labels.append((i, int(bad)))
    rows += [(None, None, 1), (1000, "", 1), (0, rows[0][1], 2)]
    out = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(r.score == 0 for r in out if not r.text)


def test_shards(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    got = shard_documents(docs, 4).collect()
    assert len(got) == len(corpus)
    where, slots = {}, {}
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert where.setdefault(r.text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(empty(spark)).count() == 0


def test_written_shards(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus, SCHEMA).drop("shard")
    write_shards(docs, str(tmp_path / "out"), 4, rows=3)
    want = {}
    for r in shard_documents(docs, 4).collect():
        want.setdefault(r.shard, []).append(r.slot)
    got = {}
    for f in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots)
        got.setdefault(int(f.parent.name[6:]), []).extend(slots)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("seed", range(4))
def test_shards_least_capacity(spark, seed):
    """The largest shard can't be a byte smaller in the order of groups."""
    sizes = (np.random.default_rng(seed).pareto(1.2, 60_000) * 100).astype(int) + 1
    groups = [(hashlib.sha256(f"{seed} {i}".encode()).hexdigest(), int(b)) for i, b in enumerate(sizes)]
    total = sum(b for _, b in groups)
    order = sorted(groups, key=lambda g: (0, -g[1], [-ord(c) for c in g[0]]) if g[1] * LARGE >= total else (1, g[0]))
    of_large, starts = place_cuts(spark.createDataFrame(groups, "digest string, bytes long"), 16)
    shards = [of_large.get(d, sum(d >= s for s in starts)) for d, _ in order]
    assert shards == sorted(shards) and shards[-1] < 16

    def enough(capacity):
        n, used = 1, 0
        for _, b in order:
            n, used = (n + 1, b) if used + b > capacity else (n, used + b)
        return n <= 16 and max(b for _, b in order) <= capacity

    largest = int(np.bincount(shards, [b for _, b in order]).max())
    assert enough(largest) and not enough(largest - 1)


def test_toxic_sentences():
    """Each sentence over a half is located, or the likeliest one if only several together make the document toxic."""
    table = np.zeros(1 << BITS, np.float32)
    for word, weight in (("vile", 6.0), ("mean", 3.5)):
        table[sentences(*raw(pa.array([word], pa.large_string())))[0][0]] = weight / 4
    texts = ["so vile. fine here! mean too? vile vile", "mean a. mean b. é mean c", "mean a", "fine", "", None]
    score, worst = score_batch(pa.array(texts, pa.large_string()), table, -4.0)
    assert (score >= 0.5).tolist() == [True, True, False, False, False, False]
    cut = [[(t or "").encode()[a:b].decode() for a, b in w] for t, w in zip(texts, worst)]
    assert cut[0] == ["so vile", "vile vile"] and len(cut[1]) == 1 and "mean" in cut[1][0]
    assert cut[2:] == [[], [], [], []]


@pytest.mark.parametrize("block_words", [200_000, 20, 1])
def test_decontamination(spark, block_words):
    """In one pass, and in passes over blocks of few words."""
    items = [(1, prose(30)), (2, "Five short words are here"), (10, "alpha"), (None, prose(12)), (3, None), (4, "..."), (5, prose(12))]
    texts = [prose(20) + " " + items[0][1].upper() + " " + prose(20), "so five, short; words are HERE!", "alpha beta", " ".join(items[0][1].split()[5:14]), " ".join(items[0][1].split()[5:15]), items[3][1], None, "", items[4][1] or "x", prose(500)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert len(got) == len(texts)
    for r in got:
        w, hit, found = fold(texts[r.doc_id]), set(), []
        for name, t in items:
            i = fold(t)
            size = min(10, len(i))
            there = {tuple(i[k : k + size]) for k in range(len(i) - size + 1)} if i else set()
            at = [k for k in range(len(w) - size + 1) if there and tuple(w[k : k + size]) in there]
            hit |= {k + d for k in at for d in range(size)}
            found += [name] if at else []
        ids = ",".join(sorted(str(n) for n in found if n is not None))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
        assert not fold(r.clean_text) or len(fold(r.clean_text)) == len(w) - len(hit)


def test_repeated_words_take_linear_time():
    """An item and a document of one word, 20,000 times; windows of several sizes among equal words."""
    start = time.time()
    automaton = Automaton([(0, ["a"] * 20_000), (1, ["a"] * 3), (2, ["b", *["a"] * 40])], 10)
    cover, found = automaton.hits(["a"] * 20_000)
    assert cover.all() and found == {0, 1, 2} and time.time() - start < 5
    assert Automaton([(0, ["a"] * 12)], 10).hits(["a"] * 9 + ["b"] + ["a"] * 10)[0].tolist() == [False] * 10 + [True] * 10
