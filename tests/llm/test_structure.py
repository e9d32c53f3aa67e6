"""Conversations, page extraction and clustering against brute force, odd inputs included."""

import hashlib
import math
import time
import zlib
from itertools import product

import numpy as np
import pytest

from folioscope.llm import extraction
from folioscope.llm.clustering import LIMIT, Ball, cluster_vectors
from folioscope.llm.extraction import ARTICLE, FURNITURE, MAIN, OPEN, STRAY, align, extract_pages, lines_of, main_text
from folioscope.llm.turns import damage, repair_conversations

RNG = np.random.default_rng(11)
TALKS = "conv_id long, turn long, role string, text string, gaps int, k string, seg long, seen string, audit string"
PAGES = "page_id long, url string, html string, text string, names string, host long, path int, place int, shared int"
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, row int, sums int, v string, x int"


# conversations


def plain(v):
    return " " if v is None else str(v)


def damaged(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = plain(role), plain(text)
        role, text = ("user" if kind == 4 else role), ("" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text)
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rs in out.items()}


def repaired(rows, faults):
    """Every sequence of edits, with at most two insertions in a place."""
    choices = []
    for (_, role, text), fault in zip(rows, faults):
        more = 3 if fault == "truncated" else 0
        keep = [] if fault in ("blank", "duplicate") else [(more, "K", [(role, text)]), (more + 3, "R", [("user", text)]), (more + 3, "R", [("assistant", text)])]
        choices.append([(4, "D", []), *keep])
    holes = [[(0, "", [])], [(3, "I", [("user", "")]), (3, "I", [("assistant", "")])], [(6, "II", [("user", ""), ("assistant", "")]), (6, "II", [("assistant", ""), ("user", "")])]]
    hole = [h for g in holes for h in g]
    paths = [(0, "", ())]
    for at in range(len(rows) + 1):
        for options in [hole] + ([choices[at]] if at < len(rows) else []):
            grown = [(c + d, a + b, (*t, *u)) for (c, a, t), (d, b, u) in product(paths, options)]
            paths = [p for p in grown if legal(p[2], whole=False)]
            best = {}  # of paths that a grammar can't tell apart any more
            for p in paths:
                end = p[2][-1][0][:1] if p[2] else ""
                if end not in best or p[:2] < best[end][:2]:
                    best[end] = p
            if len(rows) > 4:
                paths = list(best.values())
    cost, audit, told = min((p for p in paths if legal(p[2], whole=True)), key=lambda p: p[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()


def legal(told, whole):
    told = [r[:1] for r, _ in told]
    told = told[1:] if told[:1] == ["s"] else told if told or not whole else ["u", "a"]
    return all(r == "ua"[i % 2] for i, r in enumerate(told)) and (not whole or bool(told) and len(told) % 2 == 0)


def expected(talks):
    out = []
    for conv, rows in damaged(talks).items():
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *repaired(rows, faults)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    roles, texts = ["user", "assistant", "system", "tool", None, "", "umpire", "User"], ["Yes.", "No!", "why?", "cut off", "", " \n", None, "Yes. \t", "é…", "a:b\nuser:c."]
    rows = []
    for conv in range(120):
        n = int(RNG.integers(1, 8))
        for turn in RNG.permutation(n + 2)[:n]:
            rows.append((conv, int(turn), str(r) if (r := RNG.choice(roles[:3] if conv % 2 else roles)) is not None else None, (t if (t := RNG.choice(texts[:4] if conv % 3 else texts)) is None else str(t))))
    rows += [(500, None, "user", "Hi."), (500, None, "assistant", "Yo."), (None, 3, "user", "A?"), (None, None, "assistant", "B."), (None, 4, "assistant", "C"), (501, -7, "user", "x."), (501, 9000, "assistant", "y."), (502, 1, "user", "long. " * 20000)]
    rows += [rows[0], rows[0], (7, 3, "user", "same turn."), (7, 3, "assistant", "same turn.")]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [(*r, 9, "k", 5, "s", "a") for r in [*rows, (dropped, 0, "user", "gone.")]]


@pytest.mark.parametrize("span", [4096, 3, 1])
def test_conversations(spark, talks, span):
    """Conversations of one segment and those cut into segments of three numbers and of one."""
    got = repair_conversations(damage(spark.createDataFrame(talks, TALKS)), span)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(talks)


def test_long_conversation(spark):
    """Over several segments: alternating turns, a text that stands once in each of two of them, and a tail without an answer."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}." if i % 97 else "again.", 0, "", 0, "", "") for i in range(601)]
    whole, cut = (sorted(tuple(r) for r in repair_conversations(damage(spark.createDataFrame(rows, TALKS)), s).collect()) for s in (4096, 50))
    assert whole == cut and whole[0][3] > 0


def test_no_conversations(spark):
    assert repair_conversations(damage(spark.createDataFrame([], TALKS))).collect() == []


# main text


def longest(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


@pytest.mark.parametrize("held", [extraction.HELD, 8])
def test_alignment(monkeypatch, held):
    """As long as the table's, in order, of equal lines; also by halves."""
    monkeypatch.setattr(extraction, "HELD", held)
    for _ in range(300):
        a, b = (RNG.integers(0, RNG.integers(1, 9), RNG.integers(0, 14)).tolist() for _ in range(2))
        pairs = align(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))


def test_lines():
    at = lambda page: [(t, p) for t, p, _ in lines_of(page)]
    assert at("<p>a &amp; <b>b</b>c\n\n d<br>e&nbsp;f<p>g") == [("a & bc d", OPEN), ("e f", OPEN), ("g", OPEN)]
    assert at('<nav>m</nav><header>h</header><article><header>t</header>x<aside>s</aside><span class="share">s</span>y<form>f</form></article><footer>e') == [
        ("m", FURNITURE), ("h", FURNITURE), ("t", ARTICLE), ("x", ARTICLE), ("s", FURNITURE), ("y", ARTICLE), ("s", FURNITURE), ("f", FURNITURE), ("e", FURNITURE)]
    assert at('<main><p class="cookie-notice">c<p>x</main><div id="comments"><article>r</article></div><article class="comment">q</article><div class="entry-content">z</div>') == [
        ("c", FURNITURE), ("x", MAIN), ("r", FURNITURE), ("q", FURNITURE), ("z", ARTICLE)]
    assert at('<div class="page-with-sidebar"><p>w</p><article>x</article><div class=comments><article>r</article></div><div itemprop=articleBody>b</div><main>m</main></div>') == [
        ("w", FURNITURE), ("x", STRAY), ("r", FURNITURE), ("b", STRAY), ("m", MAIN)]
    assert at('<script>var a="<p>no</p>";</script><style>p{}</style><title>t</title><p title="a>b" data-x=\'<p>\'>x<!-- <p>no --><p title=it\'s>y</p><!----><!-->z') == [("x", OPEN), ("y", OPEN), ("z", OPEN)]
    assert at("a<b<c> d <3 &#xD800; &#0;<p") == [("a d <3 � �", OPEN)]
    assert at(None) == at("") == at("<!-- <p>x</p>") == at("<script>x") == []


@pytest.mark.parametrize("page", ["<p>x" * 100_000, "<div>" * 100_000 + "x", '<a b="' * 100_000, "<a '" * 100_000, "<!--" * 100_000, "<![foo x>" * 50_000, "<" * 200_000, "<script>" * 50_000, "x" * 2_000_000, "<li><p>" * 50_000, "</b>" * 100_000, "&" * 200_000])
def test_hostile_pages(page):
    start = time.time()
    lines_of(page)
    assert time.time() - start < 5


def soup(i, body):
    return f"<html><head><title>t</title></head><body><div><a href=/a>Home</a></div><div>Menu</div>{body}<div>Site of all</div><div>Best wishes</div></body></html>"


def test_pages(spark):
    """Pages without article elements lose what neighbours have too; over groups of 64, at a host's ends, alone, and where all are copies."""
    rows = [(i, f"http://A.org/x/{i:04d}", soup(i, f"<p>Text {i} of its own.</p><p>{i * 7} more.</p>")) for i in range(150)]
    rows += [(200, "http://alone.org/1", soup(0, "<p>Only.</p>")), (201, "http://two.org/1", soup(0, "<p>First of two.</p>" * 3)), (202, "http://two.org/2", soup(0, "<p>Second of two, which is longer.</p>"))]
    rows += [(300 + i, f"http://copy.org/{i}", soup(0, "<p>A text that every page of this site repeats.</p><p>And this.</p>")) for i in range(2)]
    rows += [(400, None, "<p>No host.</p>"), (401, "nohost", "<p>No host.</p>"), (402, "http://a.org/x/0003?q=1", soup(3, "<p>Another capture.</p>")), (403, "http://a.org/x/0004", None), (404, "http://a.org/y", ""), (405, "http://q.org/1", "<article><p>Quoted.</p></article><p>Also here</p>"), (406, "http://q.org/2", "<article><p>Quoted.</p><p>More.</p></article><p>Also here</p>"), (407, "http://q.org/3", "<article><p>Else.</p></article><p>Also here</p>")]
    rows += [rows[5], rows[5], (None, None, None)]
    got = {}
    for r in extract_pages(spark.createDataFrame([(*r, "t", "n", 1, 2, 3, 4) for r in rows], PAGES)).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_shared))
        assert r.n_chars == len(r.text)
    assert sum(map(len, got.values())) == len(rows) and len(got[5]) == 3
    for i in range(150):
        assert set(got[i]) == {(f"Text {i} of its own. {i * 7} more.", 4)}, i
    frame = "Home Menu {} Site of all Best wishes"
    assert got[200] == [(frame.format("Only."), 0)] and got[300] == got[301] == [(frame.format("A text that every page of this site repeats. And this."), 0)]
    assert got[201] == [("First of two. First of two. First of two.", 4)] and got[202] == [("Second of two, which is longer.", 4)]
    assert got[402] == [("Another capture.", 4)] and got[400] == got[401] == [("No host.", 0)] and got[403] == got[404] == got[None] == [("", 0)]
    assert [got[i][0][0] for i in (405, 406, 407)] == ["Quoted.", "Quoted. More.", "Else."]


def test_hot_path(spark, monkeypatch):
    """A path of many pages is dealt to several tasks and gives the same."""
    rows = [(i, "http://a.org/x" if i % 3 else f"http://a.org/{i}", soup(i, f"<p>Text {i % 3 and 1} here.</p>"), None, None, 0, 0, 0, 0) for i in range(90)]
    plain_ = sorted(tuple(r) for r in extract_pages(spark.createDataFrame(rows, PAGES)).collect())
    monkeypatch.setattr(extraction, "HOT", 7)
    assert sorted(tuple(r) for r in extract_pages(spark.createDataFrame(rows, PAGES)).collect()) == plain_


def test_no_pages(spark):
    assert extract_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_given_pages(spark):
    """The pages table's articles as a plain reading of them has it."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", body)]
        assert got[r.page_id] == " ".join(p for p in parts if p)


# clusters


def lloyd(rows, k, rounds):
    kept = [(r[0], [max(-LIMIT, min(LIMIT, math.floor(1024 * v))) if abs(v) < 1e300 else int(math.copysign(LIMIT, v)) for v in r[1]]) for r in rows if r[1] is not None and len(r[1]) == 4 and all(v is not None and math.isfinite(v) for v in r[1])]
    x = [v for _, v in kept]
    first = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"3:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), x[i]))[:k]
    at = [x[i] for i in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        to = [nearest(v)[1] for v in x]
        at = [[sum(v[d] for v, t in zip(x, to) if t == j) // to.count(j) for d in range(4)] if j in to else c for j, c in enumerate(at)]
    to = [nearest(v) for v in x]
    inertia = lambda j: min(2**63 - 1, sum(d for d, t in to if j in (None, t)))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, inertia(j), inertia(None), digest[j]) for (i, _), (d, j) in zip(kept, to)), key=repr)


@pytest.mark.parametrize("kind", ["clouds", "ties", "few", "far"])
def test_clusters(spark, kind):
    """As a full search in whole numbers has it: clouds, many equal distances and empty clusters, fewer vectors than centroids, components beyond the limit."""
    if kind == "clouds":
        made = [(RNG.normal(size=4) * 0.3 + RNG.integers(0, 5, 4)).tolist() for _ in range(400)]
    elif kind == "ties":
        made = [(RNG.integers(-2, 3, 4) / 1024).tolist() for _ in range(300)]
    elif kind == "few":
        made = [[0.5, 1.0, -2.0, 0.0], [0.5, 1.0, -2.0, 0.0], [9.0, 1.0, 1.0, 1.0]]
    else:
        made = [(RNG.choice([1e308, -1e308, 5e5, 1.0, -3.0], 4)).tolist() for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(made)]
    if kind != "few":
        rows += [(None, made[0]), (None, made[1]), (3, made[5]), (3, made[5]), (900, None), (901, []), (902, [1.0, None, 1.0, 1.0]), (903, [1.0, math.nan, 1.0, 1.0]), (904, [1.0, math.inf, 1.0, 1.0]), (905, [1.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "c", 2, 3, "v", 4) for r in rows], VECTORS).repartition(3)
    got = cluster_vectors(df, k=8, rounds=4, dims=4)
    assert "label" in got.columns and got.columns.count("cluster") == 1
    named = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r[c] for c in named) for r in got.collect()), key=repr) == lloyd(rows, 8, 4)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, "c", 2, 3, "v", 4)]):
        out = cluster_vectors(spark.createDataFrame(rows, VECTORS))
        assert out.collect() == [] and "centroid_sha256" in out.columns


def test_balls_skip():
    """In separate clouds a second search, its bounds known, computes a small share of all distances."""
    at = RNG.integers(-4000, 4000, (64, 16))
    x = at[RNG.integers(0, 64, 5000)] + RNG.integers(-50, 50, (5000, 16))
    cluster, upper, lower, _ = Ball(at).assign(x, np.zeros(5000, np.int64), np.full(5000, np.inf), np.zeros(5000))
    moved = at + RNG.integers(-30, 30, at.shape)
    far = np.sqrt(((moved - at) ** 2).sum(axis=1))
    again, *_, looked = Ball(moved).assign(x, cluster, upper + far[cluster], lower - far.max())
    assert (again == ((x[:, None] - moved[None]) ** 2).sum(axis=2).argmin(axis=1)).all() and looked < 5000 * 64 / 20


def test_stray_articles():
    """An article in a box named after a sidebar is the page's, unless another one stands outside."""
    text = lambda page: main_text(lines_of(page), [False] * 99)[0]
    box = '<div id="content-sidebar-wrap"><p>menu</p><article>inner</article></div>'
    assert text(box) == "inner" and text(box + "<article>outer</article>") == "outer" and text(box + "<main>m</main>") == "inner"


def test_lines_packed():
    """Lines come back as they were, whatever their places."""
    for lines in ([], [("a b", FURNITURE, True), ("c", FURNITURE, True), ("é", MAIN, False)], [("x", OPEN, False)]):
        assert extraction._unpacked(extraction._packed(lines)) == lines
