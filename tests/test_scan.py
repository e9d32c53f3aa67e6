"""The parse: hostile pages, selectors and intervals against plain readings, embedded JSON of any kind."""

import json
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from folioscope.functions import dom, jsonld, lists, scan
from folioscope.operators import linked_data
from folioscope.operators import pages as P
from folioscope.operators import results as R

RNG = random.Random(7)
HOSTILE = {
    "paragraphs": "<p>x" * 100_000, "links": "<a href=/x>y" * 50_000, "scopes": '<div class="author profile">x' * 30_000, "bylines": '<i class=byline><a href="/authors/x/">Ann' * 20_000, "marked": "<![foo x>y" * 50_000,
    "quotes": '<a b="' * 100_000, "comments": "<!--" * 100_000, "ends": "</div>" * 100_000, "scripts": "<script>" * 50_000, "templates": "<template>x" * 50_000, "drawings": "<svg>x" * 50_000, "open": "<" * 300_000, "items": "<li><p>x" * 50_000,
    "microdata": '<b itemprop=author itemscope><b itemprop=name>Ann' * 20_000, "authors": '<meta name=author content="Ann">' * 20_000, "text": "x " * 1_000_000, "names": "".join(f'<meta name=author content="A{i} B">' for i in range(20_000)), "addresses": "a@" * 300_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages(name):
    """Hundreds of thousands of marks pass in seconds, the facts included."""
    start = time.time()
    page = scan.Page(HOSTILE[name])
    P._facts(page, "https://p.org/")
    assert time.time() - start < 8


def test_time_grows_with_length():
    """Ten times the nodes take about ten times as long."""

    def took(n):
        start = time.time()
        P._facts(scan.Page('<div class=author><p>Some text here <a href="https://x.com/a">x</a><ul><li>y' * n), "https://p.org/")
        return time.time() - start

    took(2000)
    assert took(20_000) < 25 * max(took(2000), 0.02)


def test_odd_pages_through_spark(spark):
    """No page ends the job: marked sections, JSON 10,000 deep, lone surrogates, numbers beyond any type, unfinished tags."""
    deep = '{"a":[' * 10_000 + '{"@type":"Person","name":"Deep"}' + "]}" * 10_000
    ld = lambda s: f'<script type="application/ld+json">{s}</script>'
    rows = ["<![foo x><h1>Ann</h1>", ld(deep), ld('{"@type":"Person","name":"A\\ud83d","sameAs":["\\udc00"],"url":"\\ud800","author":"\\ud801"}'), ld('{"@type":"Person","email":1e999,"name":"N"}'), ld('{"@type":["Person",{"a":[]}],"email":["a@b.c"]}'), ld("[" * 10_000), "<h1>x</h1><p", "<!-- open", "&#xD800;<h1>&#xDFFF;A</h1>", ld('{"@type":"Person","email":' + "9" * 5000 + "}"), None, ""]
    df = spark.createDataFrame([(i, "https://p.org/a", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    page = P.candidates(P.author_fields(P.parsed(df)))
    got = {r.page_id: (r.name, r.email) for r in page.select("page_id", "name", "email", "found").collect()}
    assert len(got) == len(rows) and got[0][0] == "Ann" and got[1][0] == "Deep" and got[2][0] == "A?" and got[4][1] == "['a@b.c']" and got[8][0] == "�A"
    assert dom.with_dom(df).select(F.size("dom.nodes")).count() == len(rows)


def test_declared_accounts_may_be_relative(spark):
    ld = '<script type="application/ld+json">{"@type":"Person","name":"Ann","sameAs":["/@ann","https://github.com/ann"]}</script>'
    out = P.author_fields(P.parsed(spark.createDataFrame([("https://mas.to/about", ld)], "url string, html string")))
    assert out.select(R.social_string(F.col("social_links")).alias("s")).first().s == "github: https://github.com/ann; mastodon: https://mas.to/@ann"


def made(n):
    tags, classes = ["div", "p", "a", "li", "i", "header", "footer", "main", "article", "svg", "h1"], ["author", "bio", "my-author-x", "byline", "x", "role", "description", "person", "byline__name"]
    out = []
    for _ in range(n):
        kind = RNG.random()
        if kind < 0.55:
            given = "".join([f' class="{" ".join(RNG.sample(classes, RNG.randint(1, 2)))}"'] * (RNG.random() < 0.6) + [' href="/a/b"'] * (RNG.random() < 0.3) + [f" itemprop={RNG.choice(['author', 'name', 'url'])}"] * (RNG.random() < 0.2) + [' rel="author nofollow"'] * (RNG.random() < 0.1))
            out.append(f"<{RNG.choice(tags)}{given}>")
        elif kind < 0.8:
            out.append(f"</{RNG.choice(tags)}>")
        else:
            out.append(RNG.choice(["word ", " two  words", "a&amp;b", "<!-- c -->", "<br>", "<img>"]))
    return "".join(out)


class Tree(HTMLParser):
    """A tree with parents, in which an end tag closes the nearest open element of its name."""

    def __init__(self, html):
        super().__init__()
        self.nodes, self.open = [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, dict(attrs), list(self.open)))
        if tag not in scan.VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][0] == tag:
                del self.open[k:]
                return


def meets(step, node):
    import re

    tag, attrs, _ = node
    for name, klass, attr, op, value in re.findall(r"([a-z][a-z0-9]*)|\.([\w-]+)|\[([\w-]+)(?:([~*]?=)([^\]]+))?\]", step):
        given = attrs.get(attr)
        if name and name != tag or klass and klass not in (attrs.get("class") or "").split() or attr and given is None or op == "=" and given != value or op == "~=" and value not in given.split() or op == "*=" and value not in given:
            return False
    return True


def test_selectors_and_intervals():
    """All selectors at once, nearest ancestors, links' text, outermost and first boxes: each as a search of the whole tree has it."""
    for _ in range(150):
        html = made(RNG.randint(1, 60))
        tree, page = Tree(html), scan.Page(html)
        assert [t for t, _, _ in tree.nodes] == page.tags
        for selector in scan.SELECTORS:
            *outer, inner = selector.split()
            want = [i for i, n in enumerate(tree.nodes) if meets(inner, n) and (not outer or any(meets(outer[0], tree.nodes[a]) for a in n[2]))]
            assert page.found(selector) == want, selector
        near = lambda i, tag: next((a for a in reversed(tree.nodes[i][2]) if tree.nodes[a][0] == tag), -1)
        under = lambda i: [k for k, n in enumerate(tree.nodes) if i in n[2]]
        for i in range(len(tree.nodes)):
            assert (page.near_p[i], page.near_li[i]) == (near(i, "p"), near(i, "li")) and under(i) == list(range(i + 1, page.end[i] + 1))
            assert page.linked()[i] == sum(page.length(k) for k in under(i) if page.tags[k] == "a") and page.holds("header", "footer")[i] == sum(page.tags[k] in ("header", "footer") for k in under(i))
        boxes = RNG.sample(range(len(tree.nodes)), min(5, len(tree.nodes)))
        points = sorted(RNG.sample(range(len(tree.nodes)), min(9, len(tree.nodes))))
        assert page.first_box(points, boxes) == [next((k for k, b in enumerate(boxes) if b < i <= page.end[b]), -1) for i in points]
        assert page.outermost(boxes) == [b for b in sorted(boxes) if not any(o < b <= page.end[o] for o in boxes)]


def test_facts_and_expressions_agree(spark):
    """What the parse tells of a page is what expressions over its nodes say."""
    rows = [(i, "https://p.org/", made(80)) for i in range(40)]
    df = dom.with_dom(P.parsed(spark.createDataFrame(rows, "page_id long, url string, html string")))
    d = F.col("dom")
    out = df.select(
        (F.col("page.h1").eqNullSafe(dom.collapse(dom.text(d, dom.first(dom.by_tag(d, "h1")))))).alias("h1"), F.col("page.bio").eqNullSafe(dom.first_text("dom", lists.BIO_SELECTORS, 20)).alias("bio"),
        F.col("page.job").eqNullSafe(dom.first_text("dom", lists.JOB_SELECTORS)).alias("job"), F.col("page.content").eqNullSafe(d["content"]).alias("content"), (F.size("page.bylines") == F.size(dom.select("dom", *lists.BYLINE_SELECTORS))).alias("bylines"),
        (F.col("page.scoped") == (F.size(P.author_scopes()) > 0)).alias("scoped"),
    )
    assert all(all(r) for r in out.collect())


def test_nested_json():
    """The reader for deep JSON reads what the standard one reads, and refuses what it refuses."""

    def value(depth):
        kind = RNG.random()
        if depth and kind < 0.3:
            return {f"k{i}": value(depth - 1) for i in range(RNG.randint(0, 3))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(RNG.randint(0, 3))]
        return RNG.choice([1, -2.5, 'a"b\\n', True, None, "é😀", 1e9, 0])

    def read(f, s):
        try:
            return repr(f(s))
        except ValueError:
            return "refused"

    for _ in range(1500):
        s = json.dumps(value(4), ensure_ascii=RNG.random() < 0.5, indent=RNG.choice([None, 1]))
        assert read(jsonld.nested, s) == read(json.loads, s)
        chars = list(s)
        for _ in range(RNG.randint(1, 2)):
            i = RNG.randrange(len(chars) + 1)
            chars[i : i + RNG.randint(0, 1)] = RNG.choice('{}[],:"1 atrue')
        assert read(jsonld.nested, "".join(chars)) == read(json.loads, "".join(chars))


def test_linked_data_rows(spark):
    """Objects of any depth, lone surrogates, values that JSON has no word for, blocks that aren't JSON; any field by its name."""
    ld = lambda s: f'<script type="application/ld+json">{s}</script>'
    deep = '{"a":[' * 10_000 + '{"@type":"Person","name":"Deep","it\'s":1}' + "]}" * 10_000
    rows = [(1, ld(deep)), (2, ld('{"@type":"Person","name":"A\\ud83d","n":1e999,"x":[1,{"y":2},[3]],"z":{"@type":["Q","Person"],"name":3}}')), (3, ld("{broken") + ld('[{"a":1},{"b":"t"}]')), (4, None), (5, ld("7"))]
    found = linked_data.objects(spark.createDataFrame(rows, "page_id long, html string")).cache()
    assert {r.page_id: r.n for r in found.groupBy("page_id").agg(F.count("*").alias("n")).collect()} == {1: 10_001, 2: 3, 3: 2}
    last = found.where("page_id = 1 and depth = 10000").select(linked_data.field("name").alias("name"), linked_data.field("it's", "int").alias("n"), "parent").first()
    assert tuple(last) == ("Deep", 1, 9999)
    two = [tuple(r) for r in found.where("page_id = 2").orderBy("place").select("place", "parent", "key", "depth", F.to_json("object").alias("o")).collect()]
    assert [t[:4] for t in two] == [(0, None, None, 0), (1, 0, "x", 1), (2, 0, "z", 1)] and json.loads(two[0][4]) == {"@type": "Person", "name": "A?", "n": None, "x": [1]}
    assert [r.name for r in linked_data.people(spark.createDataFrame(rows, "page_id long, html string"), "page_id").orderBy("page_id", "place").collect()] == ["Deep", "A?", "3"]
    assert found.where("page_id = 3").select("block", linked_data.field("b").alias("b")).orderBy("place").collect()[1] == (1, "t")


def test_references_that_lack_their_semicolon():
    """Browsers read them; strictly they are text, as is what no reference is."""
    source = "<a title='x &amp; y&amp'>A &amp;&quot; B &amp;lt; &#233; &nosuch; &ampx; c&lt &amp</a>"
    loose, strict = scan.Page(source), scan.Page(source, loose=False)
    assert loose.text == 'A &" B &lt; é &nosuch; &x; c< &' and loose.attrs[0]["title"] == "x & y&"
    assert strict.text == 'A &" B &lt; é &nosuch; &ampx; c&lt &amp' and strict.attrs[0]["title"] == "x & y&amp"
