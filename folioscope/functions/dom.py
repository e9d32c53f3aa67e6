"""HTML as a nested-set array of nodes, from one parse; all else is expressions over it.

A node's descendants are the ids after it up to its `end`. Texts aren't stored per node: each has its place in the page's text, so
a page takes space in proportion to its length, however deep its elements nest. What a node lies in and holds (nearest paragraph and list item, links' text,
headers and footers) and what the library's selectors find comes from the same sweep.
"""

from __future__ import annotations

import re
from itertools import accumulate
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scan

NODE = "struct<id int, end int, parent int, depth int, p int, li int, links int, edges int, tag string, attrs map<string,string>, classes array<string>, t0 int, t1 int, r0 int, r1 int, own string, url string>"
PAGE = f"struct<nodes array<{NODE}>, hits array<array<int>>, title string, content int, text string, raw string>"


def _offsets(sizes) -> pa.Array:
    return pa.array([0, *accumulate(sizes)], pa.int32())


def _nodes(pages: list[scan.Page], urls: list[dict[int, str]]) -> pa.Array:
    every = lambda f: [v for p in pages for v in f(p)]
    numbers = {
        "id": lambda p: range(len(p.tags)), "end": lambda p: p.end, "parent": lambda p: p.parent, "depth": lambda p: p.depth, "p": lambda p: p.near_p, "li": lambda p: p.near_li,
        "links": scan.Page.linked, "edges": lambda p: p.holds("header", "footer"),
    }
    fields = {k: pa.array(every(f), pa.int32()) for k, f in numbers.items()}
    attrs = every(lambda p: p.attrs)
    fields["tag"] = pa.array(every(lambda p: p.tags), pa.string())
    fields["attrs"] = pa.MapArray.from_arrays(_offsets(map(len, attrs)), pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string()))
    fields["classes"] = pa.array(every(lambda p: p.classes), pa.list_(pa.string()))
    for k in ("t0", "t1", "r0", "r1"):
        fields[k] = pa.array(every(lambda p, k=k: [max(v, 0) for v in getattr(p, k)]), pa.int32())
    fields["own"] = pa.array(every(lambda p: [p.own.get(i, "") for i in range(len(p.tags))]), pa.string())
    fields["url"] = pa.array([u.get(i) for p, u in zip(pages, urls) for i in range(len(p.tags))], pa.string())
    return pa.ListArray.from_arrays(_offsets(len(p.tags) for p in pages), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


#: Pages that are read at once.
ROWS = 256
#: Bytes of rows that Spark sends to Python at once, where the session has no limit of its own: by number, 10,000 pages go together, however long they are.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)
#: Links that lead to no page.
NO_PAGE = re.compile(r"(?:#|javascript:|data:|mailto:|tel:|sms:)", re.IGNORECASE)


def link(base: str | None, href: str) -> str | None:
    href = href.strip()
    if not href or NO_PAGE.match(href):
        return None
    try:
        out = urljoin(base or "", href)
        return out if urlsplit(out).scheme else None
    except ValueError:
        return None


def node_url(page: scan.Page, base: str | None, i: int) -> str | None:
    """Where a node's href leads, or the text of a node that is said to be a URL; null if that can't be followed."""
    attrs = page.attrs[i]
    if attrs.get("href"):
        return link(base, attrs["href"])
    return link(base, page.text[max(page.t0[i], 0) : page.t1[i]]) if attrs.get("itemprop") == "url" else None


def title_of(page: scan.Page) -> str | None:
    found = page.found("title")
    return page.text[max(page.t0[found[0]], 0) : page.t1[found[0]]] if found else None


def read(html: list[str | None], bases: list[str | None], loose: bool = True) -> pa.Array:
    """Pages as a struct column."""
    pages = [scan.Page(h, loose) for h in html]
    urls = [{i: node_url(p, base, i) for i, a in enumerate(p.attrs) if a} for p, base in zip(pages, bases)]
    texts = {k: pa.array([getattr(p, k) for p in pages], pa.string()) for k in ("text", "raw")}
    hits = pa.array([p.hits for p in pages], pa.list_(pa.list_(pa.int32())))
    columns = {"nodes": _nodes(pages, urls), "hits": hits, "title": pa.array(map(title_of, pages), pa.string()), "content": pa.array([p.content_length() for p in pages], pa.int32())} | texts
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def bounded(spark: SparkSession) -> None:
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def with_dom(pages: DataFrame, name: str = "dom", loose: bool = True) -> DataFrame:
    """pages(html, url or not, ...) with the page: its nodes, what the library's selectors find (by node), its title, the length of its content, its text and its visible strings as they are.

    An operator of its own, not a UDF: expressions over its column are never merged with the parse, which runs once a page.
    Null html has no nodes. A column of that name is replaced. Unless `loose`, character references need their semicolon."""
    kept = [c for c in pages.columns if c != name]
    source = pages.select(*[f"`{c}`" for c in kept])
    bounded(pages.sparkSession)

    def over(batches):
        for part in (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS)):
            bases = part.column("url").to_pylist() if "url" in kept else [None] * part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, read(part.column("html").to_pylist(), bases, loose)], names=[*kept, name])

    return source.mapInArrow(over, StructType(source.schema.fields + StructType.fromDDL(f"{name} {PAGE}").fields))


def built_once(build):
    """Columns built once for a JVM: they name their inputs and belong to no table, and building some thousands of them takes seconds."""
    held: dict = {}

    def get():
        if held.get("of") is not SparkContext._gateway:
            held.update(of=SparkContext._gateway, columns=build())
        return held["columns"]

    return get


def text(page: Column, node: Column) -> Column:
    """The node's strings, stripped, joined by spaces."""
    return F.substring(page["text"], node["t0"] + 1, node["t1"] - node["t0"])


def text_length(node: Column) -> Column:
    return node["t1"] - node["t0"]


def visible(page: Column, node: Column) -> Column:
    """The node's strings as they are, comments too, joined by spaces."""
    return F.substring(page["raw"], node["r0"] + 1, node["r1"] - node["r0"])


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: list[str]) -> Column:
    """A constant array, parsed at once: a call for each of its values would take longer than the query."""
    return F.expr("array(" + ", ".join(map(literal, values)) + ")")


def _simple(selector: str, n: str) -> str:
    """Predicate of a node as SQL of `tag`, `.class`, `[attr]`, `[attr=v]`, `[attr~=v]` and `[attr*=v]`, joined without spaces."""
    tests = []
    for tag, klass, attr, op, value in re.findall(r"([a-z][a-z0-9]*)|\.([\w-]+)|\[([\w-]+)(?:([~*]?=)([^\]]+))?\]", selector):
        at, v = f"{n}.attrs[{literal(attr)}]", literal(value)
        if tag:
            tests.append(f"{n}.tag = {literal(tag)}")
        elif klass:
            tests.append(f"array_contains({n}.classes, {literal(klass)})")
        elif not op:
            tests.append(f"map_contains_key({n}.attrs, {literal(attr)})")
        elif op == "=":
            tests.append(f"coalesce({at} = {v}, false)")
        elif op == "~=":
            tests.append(f"array_contains(split(coalesce({at}, ''), '[ \\\\t\\\\n\\\\r\\\\f]+'), {v})")
        else:
            tests.append(f"coalesce(contains({at}, {v}), false)")
    return " AND ".join(tests)


def select_sql(page: str, selector: str) -> str:
    """Nodes that a selector of one or two steps (descendant) finds, in document order. The parse has found the library's own; any other is looked for among all nodes."""
    if selector in scan.NUMBER:
        return f"transform({page}.hits[{scan.NUMBER[selector]}], i -> {page}.nodes[i])"

    def matching(step: str, n: str) -> str:
        return f"filter({page}.nodes, {n} -> {_simple(step, n)})"

    *outer, inner = selector.split()
    found = matching(inner, "n")
    for step in outer:
        found = f"filter({found}, m -> exists({matching(step, 'k')}, a -> a.id < m.id AND m.id <= a.end))"
    return found


def select(page: str, *selectors: str) -> Column:
    """What the selectors find, selector by selector; page names the column."""
    found = [select_sql(page, s) for s in selectors]
    return F.expr(found[0] if len(found) == 1 else f"flatten(array({', '.join(found)}))")


def by_tag(page: Column, *tags: str) -> Column:
    if len(tags) == 1 and tags[0] in scan.NUMBER:
        return F.transform(page["hits"][scan.NUMBER[tags[0]]], lambda i: page["nodes"][i])
    return F.filter(page["nodes"], lambda n: n["tag"].isin(*tags))


def first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def within(nodes: Column, box: Column) -> Column:
    return F.filter(nodes, lambda n: (n["id"] > box["id"]) & (n["id"] <= box["end"]))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def first_text(page: str, selectors: list[str], least: int = 1) -> Column:
    """Of each selector the first element; the text of the first that has enough."""
    texts = [f"transform(slice({select_sql(page, s)}, 1, 1), e -> trim(regexp_replace(substring({page}.text, e.t0 + 1, e.t1 - e.t0), '(?U)\\\\s+', ' ')))" for s in selectors]
    return first(F.filter(F.expr(f"flatten(array({', '.join(texts)}))"), lambda t: F.length(t) >= least))


def meta(page: str, *keys: str) -> Column:
    """Content of the first meta element that has one of the names or properties."""
    named = f"array({', '.join(map(literal, keys))})"
    test = f"m.tag = 'meta' AND (array_contains({named}, lower(coalesce(m.attrs['name'], ''))) OR array_contains({named}, lower(coalesce(m.attrs['property'], '')))) AND trim(m.attrs['content']) <> ''"
    return F.expr(f"trim(try_element_at(filter({page}.nodes, m -> {test}), 1).attrs['content'])")


def link_density(box: Column) -> Column:
    """Share of a node's text that its links have; 1 without text."""
    return F.when(text_length(box) > 0, box["links"] / text_length(box)).otherwise(1.0)


def data_attributes(node: Column) -> Column:
    """Values of a node's data attributes, but for the one with a coded address."""
    return F.map_values(F.map_filter(node["attrs"], lambda k, v: k.startswith("data-") & (k != "data-cfemail")))
