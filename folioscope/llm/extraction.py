"""Main text of web pages: pages of neighbouring URLs are laid over each other line by line, and what they share goes."""

from __future__ import annotations

import html as entities
import re
import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytewords import chunks
from .common import Scratch, lower_ascii

#: A comment, a tag (a quote counts only after an equals sign), or a declaration. Nothing in it goes back, so a page takes linear time.
MARKUP = re.compile(r"""<!--(?:-?>|.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""")
#: Fixed values. Elements whose content is no markup, and where it ends; those without content; those that begin and end a line.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
RAW_ENDS = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW}
#: A tag or comment that the page ends in.
UNFINISHED = re.compile("<[a-zA-Z!?/]")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
#: Elements that an open one of the same kind ends at, and what an open paragraph ends at.
SELF_CLOSING = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Elements, roles and words of class and id that mark what isn't the article.
ASIDE = {"nav", "aside", "footer", "dialog", "menu", "search", "noscript", "template", "svg", "button", "select", "datalist", "object", "canvas", "audio", "video"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"}
ASIDE_WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social comment comments disqus reply replies respond footer masthead topbar toolbar pagination pager login copyright".split())
#: Words that make even an article element something else.
NOT_ARTICLE = {"ad", "ads", "advert", "sponsored", "promo", "teaser", "comment", "comments", "reply"}
BODY_WORDS = re.compile(r"(?:article|entry|post|story)[-_]?(?:body|content|text)|articlebody", re.IGNORECASE)
#: Of these words, those that no article stands under; the others may name a box that wraps the whole page, such as one with a sidebar.
FIRM = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter related recommended comment comments disqus reply replies respond".split())
#: LOOSE text is under such a word; STRAY is an article under one, which counts if the page has no other.
OPEN, ARTICLE, FURNITURE, FORM, MAIN, LOOSE, STRAY = range(7)
BESIDE = (FURNITURE, FORM, LOOSE)
#: Neighbours on each side; pages' places in one group; share of characters from which two pages are copies of each other.
SIDE, GROUP, COPY = 2, 64, 0.8
#: Bits of an alignment that are held at once; a longer one is halved first.
HELD = 1 << 28
#: Pages whose lines are unpacked at once.
ROWS = 256
#: Pages of one path, at least, that are dealt to several tasks, and such paths at most (by the share of all pages that each must have).
HOT, HOT_PATHS = 10_000, 1000


def _place(tag: str, given: str, outer: int) -> int:
    """What an element's text counts as, by the element, its role and the words of its class and id, within an outer element's place."""
    if outer == FURNITURE:
        return FURNITURE
    words, role, prop = set(), "", ""
    if given and ("=" in given):
        for name, a, b, c in ATTRIBUTE.findall(given):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                words |= {w for v in value.lower().split() for w in re.split(r"[-_]+", v) if not v.startswith(("has-", "with-", "no-", "is-"))}
                prop = prop or ("articlebody" if BODY_WORDS.fullmatch(value.strip()) or any(BODY_WORDS.fullmatch(v) for v in value.split()) else "")
            elif name == "role":
                role = value.lower().strip()
            elif name == "itemprop":
                prop = prop or value.lower()
    if tag in ("html", "body"):
        return outer
    if tag in ("article", "main") or role in ("article", "main"):
        if words & NOT_ARTICLE:
            return FURNITURE
        article = outer in (ARTICLE, STRAY) or tag == "article" or role == "article"
        return (outer if outer == STRAY else STRAY if outer == LOOSE else ARTICLE) if article else MAIN
    if prop == "articlebody":
        return STRAY if outer in (LOOSE, STRAY) else ARTICLE
    if tag in ASIDE or role in ASIDE_ROLES or words & FIRM or tag == "header" and outer not in (ARTICLE, STRAY):
        return FURNITURE
    if words & ASIDE_WORDS or "header" in words and outer not in (ARTICLE, STRAY):
        return FURNITURE if outer in (ARTICLE, STRAY) else LOOSE
    return FORM if tag in ("form", "fieldset") else outer


def lines_of(page: str | None) -> list[tuple[str, int, bool]]:
    """(text, place, whether a first-level heading) of a page's lines in order: character references decoded, white space as one space, none empty."""
    page, out = page or "", []
    end, at = page.rfind(">") + 1, 0
    open_: list[tuple[str, int]] = []
    where: dict[str, list[int]] = {}
    said: list[str] = []
    beside: list[str] = []
    state = [OPEN, False]  # place, heading

    def end_line() -> None:
        for parts, place in ((said, None), (beside, FURNITURE)):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    out.append((text, state[0] if place is None else place, state[1]))
                parts.clear()

    def put(raw: str) -> None:
        if raw:
            place = open_[-1][1] if open_ else OPEN
            text = entities.unescape(raw) if "&" in raw else raw
            if place in BESIDE:
                beside.append(text)
            else:
                state[0], state[1] = place, bool(where.get("h1"))
                said.append(text)

    def close(depth: int) -> None:
        while len(open_) > depth:
            where[open_.pop()[0]].pop()

    while True:
        m = MARKUP.search(page, at, end) if at < end else None
        if not m:
            put(UNFINISHED.split(page[at:], maxsplit=1)[0])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith(">"):
            break
        shut, tag, given = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            end_line()
        if shut:
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag in BLOCK and where.get("p") and tag != "br":
            boxes = max((where[t][-1] for t in ("td", "th", "li", "div", "section", "article", "blockquote") if where.get(t)), default=-1)
            if where["p"][-1] > boxes:
                close(where["p"][-1])
        if tag in SELF_CLOSING and where.get(tag):
            if where[tag][-1] > max((where[t][-1] for t in SELF_CLOSING[tag] if where.get(t)), default=-1):
                close(where[tag][-1])
        if tag in VOID:
            continue
        outer = open_[-1][1] if open_ else OPEN
        if tag in RAW:
            m = RAW_ENDS[tag].search(page, at)
            at = m.start() if m else len(page)
        where.setdefault(tag, []).append(len(open_))
        open_.append((tag, FURNITURE if tag in RAW else _place(tag, given, outer)))
    end_line()
    return out


def _names(lines: list[tuple[str, int, bool]]) -> list[int]:
    return [int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t, _, _ in lines]


def _rows(a: list[int], b: list[int]) -> list[int]:
    """For each prefix of a: bit j is 0 where b up to j has a longer common subsequence with it than b before j."""
    has: dict[int, int] = {}
    for j, x in enumerate(b):
        has[x] = has.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        met = row & has.get(x, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with each prefix of b, the empty one first."""
    row = (_rows(a, b) or [(1 << len(b)) - 1])[-1]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _middle(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > HELD:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _middle(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _middle(a[half:], b[cut:])]
    rows, out, i, j = _rows(a, b), [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        j -= 1
        out.append((i, j))
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both lists, the same one at every call."""
    n, m, head, tail = len(a), len(b), 0, 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    ours, theirs = set(a[head : n - tail]), set(b[head : m - tail])
    left = [i for i in range(head, n - tail) if a[i] in theirs]
    right = [j for j in range(head, m - tail) if b[j] in ours]
    inner = _middle([a[i] for i in left], [b[j] for j in right])
    return [(i, i) for i in range(head)] + [(left[i], right[j]) for i, j in inner] + [(n - tail + t, m - tail + t) for t in range(tail)]


def shared_lines(pages: list[tuple[int, str, list[int], list[int]]]) -> dict[int, list[bool]]:
    """For pages (place, host, names and sizes of lines) in order of place: which lines each shares with its neighbours.

    A line is shared if the alignments with two of the up to four neighbours on the host keep it, or that with the only one. A neighbour that has most
    of the page's text is a copy and says nothing of what the site adds; where all are copies, only what all of them keep is shared."""
    by = {p[0]: p for p in pages}
    met: dict[int, list[tuple[bool, list[int]]]] = {p[0]: [] for p in pages}
    for place, host, names, sizes in pages:
        for step in range(1, SIDE + 1):
            other = by.get(place + step)
            if other is None or other[1] != host:
                break
            pairs = align(names, other[2])
            common, least = sum(sizes[i] for i, _ in pairs), min(sum(sizes), sum(other[3]))
            copy = common >= COPY * max(sum(sizes), sum(other[3])) if least else True
            met[place].append((copy, [i for i, _ in pairs]))
            met[other[0]].append((copy, [j for _, j in pairs]))
    out = {}
    for place, _, names, _ in pages:
        telling = [lines for copy, lines in met[place] if not copy]
        need = min(2, len(telling)) if telling else max(2, len(met[place]))
        votes = np.zeros(len(names), np.int64)
        for lines in telling or [lines for _, lines in met[place]]:
            votes[lines] += 1
        out[place] = (votes >= need).tolist()
    return out


def main_text(lines: list[tuple[str, int, bool]], shared: list[bool]) -> tuple[str, int]:
    """The article's text and how many lines went as shared. An article element has the article, quotations of other pages included; without one it is
    what main, else the page, has besides furniture and shared lines. A first-level heading outside stays if it isn't shared."""
    body = next((p for p in (ARTICLE, STRAY, MAIN) if any(place == p for _, place, _ in lines)), OPEN)
    kept, gone = [], 0
    for (text, place, heading), same in zip(lines, shared):
        if same and place not in (ARTICLE, STRAY):
            gone += 1
        elif place == body or heading and place in (OPEN, MAIN):
            kept.append(text)
    return " ".join(kept), gone


def _packed(lines: list[tuple[str, int, bool]]) -> bytes:
    """Lines hold no line break, as their white space is one space."""
    marks = bytes(64 | place | heading << 3 for _, place, heading in lines)
    return zlib.compress(marks + b"\n\n" + "\n".join(t for t, _, _ in lines).encode("utf-8", "replace"), 1)


def _unpacked(data: bytes) -> list[tuple[str, int, bool]]:
    marks, texts = zlib.decompress(data).split(b"\n\n", 1)
    return [(t, m & 7, bool(m & 8)) for t, m in zip(texts.decode().split("\n"), marks)]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without a host's mark."""
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(scratch: Scratch, told: DataFrame) -> DataFrame:
    """told(host, path, ...) with `place`, its rank by host and path: a sort by ranges, whose sizes are all that the driver sees."""
    run = scratch.save(told.repartitionByRange("host", "path").sortWithinPartitions("host", "path").withColumn("mark", F.monotonically_increasing_id()))
    sizes = run.groupBy(F.shiftright("mark", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total))
        total += r.n
    first = scratch.spark.createDataFrame(starts, "part long, start long")
    return run.withColumn("part", F.shiftright("mark", 33)).join(F.broadcast(first), "part").withColumn("place", F.col("start") + F.col("mark").bitwiseAND((1 << 33) - 1)).drop("part", "start", "mark")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared) of pages(page_id, url, html): a row for each input row.

    Pages are cut into lines at block elements. In each host, paths are put in order, and each path's fullest capture (of equals the greatest by its lines)
    is aligned with those of the two paths before it and after it by a longest common subsequence of lines; shared lines (see
    `shared_lines`) are what the site adds to its pages. Any other capture of a path takes over what it shares with that one. Then `main_text` takes
    the article: shared lines go first, and elements, roles and class names tell furniture that no neighbour has.
    Text in an article element is never taken for shared, as articles quote and copy each other.

    Null and empty html have an empty text. Without a host (null url, no `://`) a page has no neighbours and goes by its elements alone; so does the only
    path of a host. Repeated rows are one capture and stay rows of their own. Malformed and very long pages pass in linear time; an alignment holds
    32 MiB at most. An empty table gives none. Further columns aren't read.

    Lines travel as 64-bit names; a page's own lines travel once, compressed, to its path's verdict. A host of any size is cut into groups of 64
    neighbouring paths, and pages of a very common path are dealt to several tasks."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "lines")
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))

    def named(batches):
        for part in (p for batch in batches for p in chunks(batch, "html")):
            found = [lines_of(h) for h in part.column("html").to_pylist()]
            sizes = [[len(t) for t, _, _ in lines] for lines in found]
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("path"), pa.array([_names(x) for x in found], pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=["host", "path", "names", "sizes"])

    lines = rows.where("host <> ''").select("host", "path", "html").mapInArrow(named, "host string, path string, names array<long>, sizes array<int>")
    captures = lines.groupBy("host", "path").agg(F.max(F.struct(F.size("names").alias("many"), "names", "sizes")).alias("l"), F.count(F.lit(1)).alias("n"))
    captures = _ordered(scratch, captures.select("host", "path", "n", "l.names", "l.sizes"))
    # A group has the places of its pages and those next to it on both sides.
    group = lambda shift: F.floor((F.col("place") + shift) / GROUP)
    grouped = captures.select("*", F.explode(F.array_distinct(F.array(group(-SIDE), group(0), group(SIDE)))).alias("group")).drop("n")

    def verdicts(key, table):
        own = key[0].as_py()
        table = table.sort_by("place").to_pylist()
        told = shared_lines([(r["place"], r["host"], r["names"], r["sizes"]) for r in table])
        core = [r for r in table if r["place"] // GROUP == own]
        return pa.table({"host": pa.array([r["host"] for r in core], pa.string()), "path": pa.array([r["path"] for r in core], pa.string()), "names": pa.array([r["names"] for r in core], pa.list_(pa.int64())), "shared": pa.array([told[r["place"]] for r in core], pa.list_(pa.bool_()))})

    told = grouped.groupBy("group").applyInArrow(verdicts, "host string, path string, names array<long>, shared array<boolean>")
    counts = captures.select("host", "path", "n").unionByName(rows.where("host = ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(HOT, total // HOT_PATHS)).select("host", "path", F.ceil(F.col("n") / HOT).alias("parts"))
    hot = spark.createDataFrame(hot.collect(), "host string, path string, parts long")
    key = ["host", "path", "part"]
    dealt = lambda df, parts: df.join(F.broadcast(hot), ["host", "path"], "left").withColumn("part", parts(F.coalesce("parts", F.lit(1)).cast("long"))).drop("parts")
    told = dealt(told, lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    spread = dealt(rows, lambda n: F.pmod(F.monotonically_increasing_id(), n))
    schema = pages.select("page_id", "url").schema

    def packed(batches):
        for part in (p for batch in batches for p in chunks(batch, "html")):
            lines = pa.array([_packed(lines_of(h)) for h in part.column("html").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", *key)), lines], names=["page_id", "url", *key, "lines"])

    travelling = spread.mapInArrow(packed, StructType([*schema.fields, *StructType.fromDDL("host string, path string, part long, lines binary").fields]))
    both = travelling.join(told, key, "left").select("page_id", "url", "lines", "names", "shared")

    def extracted(batches):
        for part in (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS)):
            texts, n_lines, n_shared = [], [], []
            for lines, names, shared in zip(*(part.column(c).to_pylist() for c in ("lines", "names", "shared"))):
                found = _unpacked(lines)
                own = _names(found) if names else []
                if own != names:
                    marks = [False] * len(found)
                    for i, j in align(own, names or []):
                        marks[i] = shared[j]
                    shared = marks
                text, gone = main_text(found, shared)
                texts.append(text)
                n_lines.append(len(found))
                n_shared.append(gone)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in ([len(t) for t in texts], n_lines, n_shared))], names=["page_id", "url", "text", "n_chars", "n_lines", "n_shared"])

    return both.mapInArrow(extracted, StructType([*schema.fields, *StructType.fromDDL("text string, n_chars long, n_lines long, n_shared long").fields]))
