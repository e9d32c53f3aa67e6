"""One sweep over a page's markup: nodes as nested sets, the texts' places, what every selector finds, and intervals' lookups.

Whatever a page holds, the sweep takes time in proportion to its length, and nothing in it raises.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from html.entities import html5
from itertools import accumulate

from . import lists

#: A comment, a tag (a quote counts only after an equals sign), or a declaration; no part of it goes back.
MARKUP = re.compile(r"""<!--(-?>|.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: A tag or comment that the page ends in.
UNFINISHED = re.compile("<[a-zA-Z!?/]")
#: Elements without content; elements whose strings aren't text, and aren't visible; elements whose content is no markup.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOT_TEXT = {"script", "style", "template"}
NOT_VISIBLE = {"script", "style", "noscript"}
RAW_ENDS = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in ("script", "style", "title", "textarea")}
#: Elements that don't count as a page's content.
NOT_CONTENT = ("script", "style", "noscript", "svg", "head")
#: Elements that the library looks up by name.
TAGS = ("a", "h1", "title", "p", "li", "meta", "main", "article", "header", "footer", *NOT_CONTENT)


REFERENCE = re.compile("&#?[0-9a-zA-Z]+;")


def strict(text: str) -> str:
    """Character references with their semicolon decoded; a text cut within one keeps its start."""
    return REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


class Matcher:
    """All selectors at once: `tag`, `.class`, `[attr]`, `[attr=v]`, `[attr~=v]`, `[attr*=v]`, joined without spaces, of one or two steps.

    Each step is a bit, listed under one of its tests (a class, else an attribute, else the tag), so that a node is held only against steps
    that it may meet. A two-step selector looks for its outer bit among those of the node's ancestors, which come as one number."""

    def __init__(self, selectors: tuple[str, ...]):
        self.selectors = selectors
        self.by_class, self.by_attr, self.by_tag = {}, {}, {}
        bits: dict[str, int] = {}
        self.inner: dict[int, list[tuple[int, int]]] = {}
        for number, selector in enumerate(selectors):
            *outer, inner = (bits.setdefault(step, 1 << len(bits)) for step in selector.split())
            self.inner.setdefault(inner, []).append((number, outer[0] if outer else 0))
        self.last = sum(self.inner)
        for step, bit in bits.items():
            self._list(step, bit)

    def _list(self, step: str, bit: int) -> None:
        tests = []
        for tag, klass, attr, op, value in re.findall(r"([a-z][a-z0-9]*)|\.([\w-]+)|\[([\w-]+)(?:([~*]?=)([^\]]+))?\]", step):
            tests.append(("tag", tag, "") if tag else ("class", klass, "") if klass else ("has" if not op else op, attr, value))
        tests.sort(key=lambda t: (t[0] == "tag", t[0] != "class"))
        kind, name, _ = tests[0]
        where = self.by_tag if kind == "tag" else self.by_class if kind == "class" else self.by_attr
        where.setdefault(name, []).append((bit, tests if kind in ("=", "~=", "*=") else tests[1:]))

    def steps(self, tag: str, attrs: dict, classes: list[str]) -> int:
        """Bits of the steps that a node meets."""
        found = 0
        for names, listed in (((tag,), self.by_tag), (attrs, self.by_attr), (classes, self.by_class)):
            for name in names:
                for bit, tests in listed.get(name, ()):
                    if all(self._meets(t, tag, attrs, classes) for t in tests):
                        found |= bit
        return found

    @staticmethod
    def _meets(test: tuple[str, str, str], tag: str, attrs: dict, classes: list[str]) -> bool:
        kind, name, value = test
        if kind == "tag":
            return tag == name
        if kind == "class":
            return name in classes
        given = attrs.get(name)
        return given is not None and (kind == "has" or (value == given if kind == "=" else value in given.split() if kind == "~=" else value in given))


#: What the author record and the candidates look for; a page's `hits` has a list of nodes for each, in this order.
SELECTORS = tuple(dict.fromkeys([*TAGS, *lists.AUTHOR_SCOPES, *lists.BIO_SELECTORS, *lists.JOB_SELECTORS, *lists.LOCATION_SELECTORS, *lists.BYLINE_SELECTORS, "[itemprop=author]", "[itemprop=name]", "[itemprop=url]", "[data-cfemail]"]))
NUMBER = {s: i for i, s in enumerate(SELECTORS)}
MATCHER = Matcher(SELECTORS)


class Page:
    """A page's nodes as lists by node; `loose` if a character reference may lack its semicolon, as browsers have it. A node's descendants are those after it up to its `end`; (t0, t1) is its place in `text`
    (strings stripped and joined by spaces), (c0, c1) in `flat` (white space within them collapsed too), (r0, r1) in `raw` (visible strings and comments as they are)."""

    def __init__(self, source: str | None, loose: bool = True):
        self._plain = html.unescape if loose else strict
        self.tags, self.attrs, self.classes, self.parent, self.depth, self.end = [], [], [], [], [], []
        self.t0, self.t1, self.c0, self.c1, self.r0, self.r1 = [], [], [], [], [], []
        self.own: dict[int, str] = {}
        self.near_p, self.near_li = [], []
        self.hits: list[list[int]] = [[] for _ in SELECTORS]
        self._above, self._open, self._where = [], [], {}
        self._parts: tuple[list, list, list] = ([], [], [])
        self._ends = [-1, -1, -1]
        self._sweep(source or "")
        self._shut(0)
        self.text, self.flat, self.raw = (" ".join(p) for p in self._parts)

    def _string(self, data: str, comment: bool = False) -> None:
        tag = self.tags[self._open[-1]] if self._open else ""
        clean = data.strip()
        ends = self._ends
        if clean and not comment and tag not in NOT_TEXT and not self._where.get("template"):
            self._begin(self.t0, ends[0] + 1, self.c0, ends[1] + 1)
            flat = " ".join(clean.split())
            self._parts[0].append(clean)
            self._parts[1].append(flat)
            ends[0] += 1 + len(clean)
            ends[1] += 1 + len(flat)
        if tag not in NOT_VISIBLE:
            self._begin(self.r0, ends[2] + 1)
            self._parts[2].append(data)
            ends[2] += 1 + len(data)
        if tag == "script" and not comment:
            self.own[self._open[-1]] = self.own.get(self._open[-1], "") + data

    def _begin(self, places: list[int], at: int, more: list[int] | None = None, more_at: int = 0) -> None:
        """A string's place, told to the open elements that had none yet."""
        for i in reversed(self._open):
            if places[i] >= 0:
                return
            places[i] = at
            if more is not None:
                more[i] = more_at

    def _start(self, tag: str, given: str) -> None:
        attrs = {}
        if given:
            for name, a, b, c in ATTRIBUTE.findall(given):
                value = a or b or c
                attrs[name.lower()] = self._plain(value) if "&" in value else value
        classes = attrs["class"].split() if "class" in attrs else []
        n, parent = len(self.tags), self._open[-1] if self._open else -1
        found = MATCHER.steps(tag, attrs, classes)
        above = self._above[parent] if parent >= 0 else 0
        last = found & MATCHER.last
        while last:
            bit = last & -last
            last ^= bit
            for number, outer in MATCHER.inner[bit]:
                if not outer or outer & above:
                    self.hits[number].append(n)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.classes.append(classes)
        self.parent.append(parent)
        self.depth.append(len(self._open))
        self._above.append(above | found)
        for near, kind in ((self.near_p, "p"), (self.near_li, "li")):
            near.append(-1 if parent < 0 else parent if self.tags[parent] == kind else near[parent])
        self.end.append(n)
        for places, value in ((self.t0, -1), (self.c0, 0), (self.r0, -1), (self.t1, 0), (self.c1, 0), (self.r1, 0)):
            places.append(value)
        if tag not in VOID:
            self._where.setdefault(tag, []).append(len(self._open))
            self._open.append(n)

    def _shut(self, depth: int) -> None:
        last = len(self.tags) - 1
        while len(self._open) > depth:
            i = self._open.pop()
            self._where[self.tags[i]].pop()
            self.end[i] = last
            if self.t0[i] >= 0:
                self.t1[i], self.c1[i] = self._ends[0], self._ends[1]
            if self.r0[i] >= 0:
                self.r1[i] = self._ends[2]

    def _end(self, tag: str) -> None:
        """An end tag closes the nearest open element of its name, if there is one; none is implied."""
        if self._where.get(tag):
            self._shut(self._where[tag][-1])

    def _sweep(self, source: str) -> None:
        last, at = source.rfind(">") + 1, 0
        while True:
            m = MARKUP.search(source, at, last) if at < last else None
            data = source[at : m.start()] if m else UNFINISHED.split(source[at:], maxsplit=1)[0]
            if data:
                self._string(self._plain(data) if "&" in data else data)
            if not m:
                break
            at = m.end()
            if m[1] is not None:
                if not m[1].endswith(">"):
                    break
                self._string(m[1][:-3] if m[1].endswith("-->") else "", comment=True)
                continue
            shut, tag, given = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
            if not tag:
                continue
            tag = tag.lower()
            if shut:
                self._end(tag)
                continue
            self._start(tag, given)
            if given.endswith("/"):
                if tag not in VOID:
                    self._end(tag)
            elif tag in RAW_ENDS:
                m = RAW_ENDS[tag].search(source, at)
                if m or tag in NOT_TEXT:
                    data = source[at : m.start() if m else len(source)]
                    at += len(data)
                    if data:
                        self._string(data if tag in NOT_TEXT else self._plain(data))

    def found(self, *selectors: str) -> list[int]:
        """Nodes, selector by selector."""
        return [i for s in selectors for i in self.hits[NUMBER[s]]]

    def linked(self) -> list[int]:
        """For each node the characters of its text that are links'."""
        if not self.hits[NUMBER["a"]]:
            return [0] * len(self.tags)
        sums = [0, *accumulate(t1 - t0 if tag == "a" and t0 >= 0 else 0 for tag, t0, t1 in zip(self.tags, self.t0, self.t1))]
        return [sums[end + 1] - sums[i + 1] for i, end in enumerate(self.end)]

    def holds(self, *tags: str) -> list[int]:
        """For each node how many such elements are in it."""
        sums = [0, *accumulate(int(tag in tags) for tag in self.tags)]
        return [sums[end + 1] - sums[i + 1] for i, end in enumerate(self.end)]

    def outermost(self, nodes: list[int]) -> list[int]:
        """Those that lie in no other of them, in order."""
        out, end = [], -1
        for i in sorted(set(nodes)):
            if i > end:
                out.append(i)
                end = self.end[i]
        return out

    def first_box(self, points: list[int], boxes: list[int]) -> list[int]:
        """For ascending nodes, the place of the first box that each lies in, or -1. A node's place once found, it's skipped from then on."""
        rank, following = [-1] * len(points), list(range(len(points) + 1))

        def free(i: int) -> int:
            while following[i] != i:
                following[i] = following[following[i]]
                i = following[i]
            return i

        for k, box in enumerate(boxes):
            i = free(bisect_right(points, box))
            while i < len(points) and points[i] <= self.end[box]:
                rank[i] = k
                following[i] = i + 1
                i = free(i + 1)
        return rank

    def string(self, i: int) -> str:
        return self.flat[self.c0[i] : self.c1[i]]

    def length(self, i: int) -> int:
        return self.t1[i] - max(self.t0[i], 0)

    def content_length(self) -> int:
        """Characters of text outside head, scripts, styles and drawings."""
        return max(0, len(self.text) - sum(self.length(i) + 1 for i in self.outermost([i for i in self.found(*NOT_CONTENT) if self.length(i) > 0])))
