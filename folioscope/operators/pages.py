"""Page state, the author record of a page, its author candidates, and the crawl that joins them, over the page's DOM."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import dom, jsonld, lists, scan, text, urls

LD = "array<struct<types array<string>, name string, job string, bio string, email string, said string, org string, place string, url string, same_as array<string>, accounts array<string>, author string>>"
LINK = "label string, url string"
FACTS = (
    "struct<title string, text string, content int, h1 string, metas array<struct<key string, name string, property string, content string>>, prose string, bio string, job string, place string, "
    f"anchors array<struct<{LINK}, prose boolean, scope int, main int, item boolean>>, bylines array<struct<{LINK}>>, items array<struct<{LINK}>>, "
    "scoped boolean, seen array<string>, mails array<string>, codes array<string>, data array<string>>"
)
#: Fields of an author's record beside the name and the profile's URL.
FIELDS = [f for f in lists.AUTHOR_FIELDS if f not in ("name", "profile_url")]
#: Characters of text that page states are told by, of a bio that selectors find, of running text, of what may be a person's name.
STATED, BIO, PROSE, NAME = 20000, 20, 80, 80


def _name(page: scan.Page, i: int) -> str | None:
    """A node's text if it isn't too long for a name."""
    return page.string(i) if page.length(i) <= NAME else None


def _first_text(page: scan.Page, selectors: list[str], least: int = 1) -> str | None:
    """Of each selector the first element; the text of the first that has enough."""
    for s in selectors:
        found = page.found(s)
        if found and page.c1[found[0]] - page.c0[found[0]] >= least:
            return page.string(found[0])


def _longest_paragraph(page: scan.Page, linked: list[int]) -> str | None:
    """The longest paragraph over 50 characters outside list items that isn't mostly links, of main, else article, else the page;
    the first of equals."""
    box = next(iter(page.found("main") or page.found("article")), None)
    best, most = None, 50
    for p in page.found("p"):
        size = page.c1[p] - page.c0[p]
        if size > most and page.near_li[p] < 0 and (box is None or box < p <= page.end[box]) and linked[p] <= 0.5 * page.length(p):
            best, most = p, size
    return None if best is None else page.string(best)


def _facts(page: scan.Page, base: str | None) -> dict:
    """All that the author record, the candidates and the page's state read of a page, each text once."""
    linked, edges = page.linked(), page.holds("header", "footer")
    scopes = [i for i in page.found(*lists.AUTHOR_SCOPES) if page.tags[i] not in ("html", "body") and not edges[i]]
    mains = page.found("main", "article")
    area = page.outermost(scopes or mains)
    within = lambda nodes: [i for i, k in zip(nodes, page.first_box(nodes, area)) if k >= 0] if area else nodes
    url = lambda i: dom.node_url(page, base, i)
    anchors = [i for i in page.found("a") if page.attrs[i].get("href")]
    inside = lambda boxes: page.first_box(anchors, boxes)
    prose = lambda p: p >= 0 and page.length(p) >= PROSE and linked[p] < 0.5 * page.length(p)
    authors = page.found("[itemprop=author]")
    scoped = [i for i in authors if "itemscope" in page.attrs[i]]
    named, to = page.found("[itemprop=name]"), page.found("[itemprop=url]")

    def item(i: int) -> dict:
        """A link's own text and URL; those of the parts of a scoped item; the text of any other."""
        if page.tags[i] == "a":
            return {"label": _name(page, i), "url": url(i)}
        if i not in known:
            return {"label": _name(page, i), "url": None}
        name, link = (next(iter(nodes[k : k + 1]), None) if (k := bisect_right(nodes, i)) < len(nodes) and nodes[k] <= page.end[i] else None for nodes in (named, to))
        return {"label": None if name is None else _name(page, name), "url": None if link is None else url(link)}

    known = set(scoped)
    metas = []
    for i in page.found("meta"):
        a = page.attrs[i]
        if a.get("content", "").strip():
            name, prop = a.get("name", "").lower(), a.get("property", "").lower()
            metas.append({"key": name or prop, "name": name, "property": prop, "content": a["content"].strip()})
    mails = [h[7:].split("?")[0].strip() for h in (page.attrs[i]["href"].strip() for i in within(anchors)) if h[:7].lower() == "mailto:"]
    data = [i for i, a in enumerate(page.attrs) if any(k.startswith("data-") and k != "data-cfemail" for k in a)]
    head = next(iter(page.found("h1")), None)
    return {
        "title": dom.title_of(page), "text": page.text[:STATED], "content": page.content_length(), "h1": None if head is None else page.string(head), "metas": metas, "prose": _longest_paragraph(page, linked),
        "bio": _first_text(page, lists.BIO_SELECTORS, BIO), "job": _first_text(page, lists.JOB_SELECTORS), "place": _first_text(page, lists.LOCATION_SELECTORS),
        "anchors": [
            {"label": _name(page, i), "url": url(i), "prose": prose(page.near_p[i]), "scope": s, "main": m, "item": k >= 0}
            for i, s, m, k in zip(anchors, inside(scopes), inside(mains), inside(scoped))
        ],
        "bylines": [{"label": _name(page, i), "url": url(i)} for i in page.found(*lists.BYLINE_SELECTORS)], "items": [item(i) for i in authors], "scoped": bool(scopes),
        "seen": [page.raw[max(page.r0[i], 0) : page.r1[i]] for i in area] if area else [page.raw], "mails": mails, "codes": [page.attrs[i]["data-cfemail"] for i in within(page.found("[data-cfemail]"))],
        "data": [v for i in within(data) for k, v in page.attrs[i].items() if k.startswith("data-") and k != "data-cfemail"],
    }


def _ld(page: scan.Page, base: str | None) -> list[dict]:
    blocks = [page.own.get(i, "") for i in page.found("script") if page.attrs[i].get("type") == "application/ld+json"]
    records = [jsonld.record(n) for raw in blocks for n in jsonld.objects(jsonld.block(raw))]
    return [r | {"accounts": [u for u in (jsonld.sound(dom.link(base, s)) for s in r["same_as"]) if u]} for r in records]


def parsed(pages: DataFrame) -> DataFrame:
    """pages(url or not, html, ...) with page and ld, in one pass through Python that takes time in proportion to a page's length.

    page has the facts that all else reads: title, the start of its text, the length of its content, first heading, metas, texts that selectors
    find, links with a label (null if too long for a name) and the blocks that they lie in, and the strings and attributes of the author's blocks, else
    of the content, else of the page. ld has every object of the JSON-LD blocks, in order; blocks that don't parse are skipped. Columns of these names are replaced."""
    kept = [c for c in pages.columns if c not in ("page", "ld")]
    source = pages.select(*[f"`{c}`" for c in kept])
    added = StructType.fromDDL(f"page {FACTS}, ld {LD}")
    dom.bounded(pages.sparkSession)

    def over(batches):
        kinds = to_arrow_schema(added)
        for part in (batch.slice(i, dom.ROWS) for batch in batches for i in range(0, batch.num_rows, dom.ROWS)):
            bases = part.column("url").to_pylist() if "url" in kept else [None] * part.num_rows
            read = [scan.Page(h) for h in part.column("html").to_pylist()]
            facts = pa.array([_facts(p, b) for p, b in zip(read, bases)], kinds.field("page").type)
            yield pa.RecordBatch.from_arrays([*part.columns, facts, pa.array([_ld(p, b) for p, b in zip(read, bases)], kinds.field("ld").type)], names=[*kept, "page", "ld"])

    return source.mapInArrow(over, StructType(source.schema.fields + added.fields))


def _typed(ld: Column, *kinds: str) -> Column:
    return F.filter(ld, lambda n: F.exists(n["types"], lambda t: F.exists(dom.strings(list(kinds)), lambda k: F.contains(t, k))))


def _first(ld: Column, field: str) -> Column:
    return dom.first(F.filter(F.transform(ld, lambda n: n[field]), lambda v: v.isNotNull()))


def _has(c: Column, markers: list[str]) -> Column:
    return F.exists(dom.strings(markers), lambda m: F.contains(c, m))


def page_state(page: Column, html: Column, status: Column | None = None) -> Column:
    """blocked, retry, paywall, thin or ok, by HTTP status if there is one, title, markers and the length of the content."""
    title, body = F.lower(F.coalesce(page["title"], F.lit(""))), F.lower(F.left(page["text"], F.lit(STATED)))
    challenge = _has(title, lists.CHALLENGE_TITLES) | _has(F.lower(F.left(F.coalesce(html, F.lit("")), F.lit(8000))), lists.CHALLENGE_BODIES)
    paywall = _has(title, lists.PAYWALL_TITLES) | _has(body, lists.PAYWALL_BODIES)
    out = F.when(status.isin(lists.REFUSED), "blocked").when(status.isin(lists.RETRIED), "retry") if status is not None else F.when(F.lit(False), "")
    return out.when(challenge, "blocked").when(paywall, "paywall").when(page["content"] < 200, "thin").otherwise("ok")


def classify_fetched(fetched: DataFrame, backoff: float = 1.5) -> DataFrame:
    """fetched(url, status_code, content_type, content, retry_after, attempt) with html, garbled, state and, for those to
    be fetched again, delay in seconds."""
    html = text.decode_bytes(F.col("content"), text.charset(F.col("content_type")))
    out = parsed(fetched.withColumn("html", html))
    state = page_state(F.col("page"), F.col("html"), F.col("status_code"))
    delay = F.when(text.http_class(F.col("status_code")) == "retry", text.retry_delay(F.col("retry_after"), backoff, F.col("attempt")))
    return out.withColumns({"garbled": F.coalesce(text.bad_chars(F.col("html")), F.lit(False)), "state": state, "delay": delay}).drop("page", "ld")


def author_scopes(name: str = "dom") -> Column:
    """Boxes that selectors of author blocks find, selector by selector; those that hold a header or footer wrap the page and don't count."""
    return F.filter(dom.select(name, *lists.AUTHOR_SCOPES), lambda s: ~s["tag"].isin("html", "body") & (s["edges"] == 0))


def main_scopes(page: Column) -> Column:
    return F.concat(dom.by_tag(page, "main"), dom.by_tag(page, "article"))


def meta(page: Column, *keys: str) -> Column:
    """Content of the first meta element of a page's facts that has one of the names or properties."""
    named = dom.strings(list(keys))
    return dom.first(F.filter(page["metas"], lambda m: F.array_contains(named, m["name"]) | F.array_contains(named, m["property"])))["content"]


def site_names(page: Column) -> Column:
    """The publication's names, lower-cased."""
    return F.array_distinct(F.array_compact(F.array(F.lower(meta(page, "og:site_name")), F.lower(meta(page, "application-name")))))


def page_emails(page: Column, people: Column) -> Column:
    """Distinct plausible addresses in order: a person's in JSON-LD, and of the author's blocks, else the content, else the whole page: mail links, text, coded and data attributes.
    Spelt-out ones stand apart from words: running text of some languages has "at" and "dot" within one."""
    coded = F.transform(page["codes"], text.decode_hidden_email)
    # The joint is no white space and no part of an address: none is read across two blocks or two attributes.
    joint = lambda c: F.array_join(c, "\u0001")
    written = text.plain_emails(joint(page["data"]))
    known = F.transform(people, lambda p: p["email"])
    found = F.filter(F.concat(known, page["mails"], coded, written), lambda e: F.coalesce((e != "") & text.plausible_email(e), F.lit(False)))
    return F.array_sort(F.array_distinct(F.concat(found, text.emails(joint(page["seen"]), lists.APART))))


def ranked_emails(found: Column, name: Column, url: Column) -> Column:
    """By score, best first, then in order."""
    scored = F.array_sort(F.transform(found, lambda e: F.struct((-text.email_score(e, name, urls.root_domain(url))).alias("s"), e.alias("e"))))
    return F.transform(scored, lambda s: s["e"])


@dom.built_once
def _accounts() -> list[dict[str, Column]]:
    links = F.filter("page.anchors", lambda a: a["url"].isNotNull() & ~a["prose"] & ((a["scope"] >= 0) | (a["main"] >= 0)))
    own = F.transform(links, lambda a, i: F.struct(a["scope"].alias("scope"), a["main"].alias("main"), i.alias("i"), urls.classify_social(a["url"]).alias("platform"), a["url"].alias("url")))
    declared = F.transform(F.flatten(F.transform(_typed(F.col("ld"), "Person"), lambda p: p["accounts"])), lambda u: F.struct(urls.classify_social(u).alias("platform"), u.alias("url")))
    known = lambda found: F.filter(found, lambda s: s["platform"].isNotNull())
    held = lambda box: F.array_sort(F.transform(F.filter("_own", lambda a: a[box] >= 0), lambda a: F.struct(a[box].alias("box"), a["i"].alias("i"), a["platform"].alias("platform"), a["url"].alias("url"))))
    kinds = F.array_sort(F.array_distinct(F.transform("_linked", lambda s: s["platform"])))  # as many as there are platforms, at most
    first = F.transform(kinds, lambda k: F.element_at(F.filter("_linked", lambda s: s["platform"] == k), 1))
    return [
        {"_own": known(own), "_same": known(declared)},
        {"_held": F.when(F.exists("_own", lambda a: a["scope"] >= 0), held("scope")).otherwise(held("main"))},
        {"_linked": F.concat("_same", F.transform("_held", lambda a: F.struct(a["platform"].alias("platform"), a["url"].alias("url"))))},
        {"social_links": F.transform(first, lambda s: F.struct(s["platform"].alias("platform"), urls.clean_url(s["url"]).alias("url")))},
    ]


def _with(rows: DataFrame, stages: list[dict[str, Column]]) -> DataFrame:
    """Columns added step by step; those that begin with an underscore are dropped in the end."""
    for columns in stages:
        rows = rows.withColumns(columns)
    return rows.drop(*[c for columns in stages for c in columns if c.startswith("_")])


def with_accounts(rows: DataFrame) -> DataFrame:
    """Adds social_links, (platform, url) by platform, to a parsed page: those of JSON-LD before links of the author's blocks, or of the content
    where these have no account; the first of a platform counts, by block, then in order. Links in running text are citations, no accounts."""
    return _with(rows, _accounts())


@dom.built_once
def _record() -> list[dict[str, Column]]:
    page, people = F.col("page"), F.col("_people")
    head = F.when((page["h1"] != "") & (F.length(page["h1"]) < 80) & ~F.array_contains(site_names(page), F.lower(page["h1"])), page["h1"])
    byline = dom.first(F.filter(page["metas"], lambda m: F.array_contains(dom.strings(lists.BYLINE_META), m["key"]) & (F.length(m["content"]) < 80)))["content"]
    told = dom.first(F.filter(F.transform(people, lambda p: p["bio"]), lambda b: F.length(b) >= BIO))
    described = F.trim(text.strip_tags(dom.first(F.filter(page["metas"], lambda m: m["name"].isin("description", "author-description")))["content"]))
    bio = F.left(F.coalesce(text.collapse(text.strip_tags(told)), F.when(F.length(described) >= BIO, text.collapse(described)), page["bio"], page["prose"]), F.lit(2000))
    account = lambda kind: dom.first(F.filter("social_links", lambda s: s["platform"] == kind))["url"]
    found = {
        "name": F.coalesce(_first(people, "name"), head, byline), "bio": bio, "emails": page_emails(page, people), "location": F.coalesce(_first(people, "place"), page["place"]),
        "organization": F.coalesce(_first(people, "org"), _first(_typed(F.col("ld"), "Organization"), "name"), meta(page, "og:site_name"), meta(page, "application-name")),
        "_job": F.coalesce(_first(people, "job"), page["job"]), "_email": _first(people, "said"),
    }
    told = {
        "job_title": F.coalesce("_job", text.role_in_prose(F.col("bio"), F.col("name"))), "email": F.coalesce("_email", dom.first(F.col("emails"))),
        "linkedin": account("linkedin"), "twitter": account("twitter"),
    }
    return [{"_people": _typed(F.col("ld"), "Person")}, found, {"emails": ranked_emails(F.col("emails"), F.col("name"), F.col("url"))}, told]


def author_fields(rows: DataFrame) -> DataFrame:
    """Adds the author record's fields, and emails, to a parsed page. Each is the first source that has it; null where none has."""
    return _with(with_accounts(rows), _record())


@dom.built_once
def _found() -> list[dict[str, Column]]:
    page, here = F.col("page"), F.col("url")
    none = F.lit(None).cast("string")
    pair = lambda name, url: F.struct(name.alias("name"), url.alias("url"))
    at_home = lambda url: F.coalesce(urls.same_domain(url, here), F.lit(False))
    name_of = lambda c: F.when(text.plausible_name(c), c)
    empty = F.expr("cast(array() as array<struct<name string, url string>>)")
    some = lambda ok, p: F.when(ok, F.array(p)).otherwise(empty)

    def from_ld(n: Column) -> Column:
        is_person = F.exists(n["types"], lambda t: F.contains(t, F.lit("Person")) | F.contains(t, F.lit("Author")))
        same = F.transform(F.filter(n["same_as"], at_home), lambda u: pair(n["name"], urls.absolute(here, u)))
        own = F.when(n["url"].isNotNull(), F.array(pair(n["name"], F.when(at_home(n["url"]), urls.absolute(here, n["url"]))))).otherwise(F.concat(same, F.array(pair(n["name"], none))))
        return F.concat(some(text.plausible_name(n["author"]), pair(n["author"], none)), F.when(is_person, own).otherwise(empty))

    def from_meta(m: Column) -> Column:
        parts = F.filter(F.transform(F.split(m["content"], r"[;,]|\s+and\s+"), lambda t: F.trim(t)), text.plausible_name)
        return F.when(F.lower(m["content"]).startswith("http"), some(at_home(m["content"]), pair(none, urls.absolute(here, m["content"])))).otherwise(F.transform(parts, lambda t: pair(t, none)))

    def from_link(a: Column) -> Column:
        """A byline's link; without a followable href only its label counts."""
        return some(F.coalesce(a["url"] != F.col("_self"), F.lit(True)), pair(name_of(a["label"]), F.when(at_home(a["url"]), a["url"])))

    clean = lambda a: F.struct(a["label"].alias("label"), urls.clean_url(a["url"]).alias("url"))
    paths = F.filter(page["anchors"], lambda a: at_home(a["url"]) & urls.looks_like_author_page(a["url"]))
    paths = F.transform(paths, lambda a: F.struct(a["label"].alias("label"), urls.clean_url(a["url"]).alias("url"), a["item"].alias("item")))
    by = F.trim(F.regexp_extract(F.coalesce(page["title"], F.lit("")), lists.TITLE_BYLINE, 1))
    parts = {
        "_links": F.transform(page["bylines"], clean), "_paths": F.filter(paths, lambda a: a["url"] != F.col("_self")), "_by": by, "_items": F.filter(page["items"], lambda a: text.plausible_name(a["label"])),
        "_metas": F.filter(page["metas"], lambda m: F.array_contains(dom.strings(lists.AUTHOR_META), m["key"])), "_ld": F.filter("ld", lambda n: n["author"].isNotNull() | (F.size(n["types"]) > 0)),
    }
    detected = [
        F.flatten(F.transform("_ld", from_ld)),
        F.flatten(F.transform("_metas", from_meta)),
        F.flatten(F.transform("_links", from_link)),
        F.transform("_paths", lambda a: pair(name_of(a["label"]), a["url"])),
        F.concat(F.transform("_items", lambda a: pair(a["label"], urls.clean_url(a["url"]))), F.transform(F.filter("_paths", lambda a: a["item"]), lambda a: pair(none, a["url"]))),
        some(text.plausible_name(F.col("_by")), pair(F.col("_by"), none)),
    ]
    told = lambda i: lambda s: F.struct(F.lit(i).alias("source"), F.nullif(F.trim(s["name"]), F.lit("")).alias("name"), s["url"].alias("profile_url"))
    every = F.filter(F.concat(*[F.transform(c, told(i)) for i, c in enumerate(detected)]), lambda c: c["name"].isNotNull() | c["profile_url"].isNotNull())
    # Equal ones lie next to each other once sorted by key, so that the first of each is told by the one before it.
    keyed = F.array_sort(F.transform("_every", lambda c, i: F.struct(F.struct(F.lower(c["name"]).alias("name"), c["profile_url"].alias("url")).alias("key"), i.alias("i"), c.alias("c"))))
    first = F.filter("_sorted", lambda c, i: (i == 0) | ~F.get("_sorted", i - 1)["key"].eqNullSafe(c["key"]))
    found = F.transform(F.array_sort(F.transform(first, lambda c: F.struct(c["i"].alias("i"), c["c"].alias("c")))), lambda c: c["c"])
    return [{"_self": F.coalesce(urls.absolute(here, here), here)}, parts, {"_every": every}, {"_sorted": keyed}, {"found": found}]


def candidates(rows: DataFrame) -> DataFrame:
    """Adds found, array<struct<source, name, profile_url>>, to a parsed page: the ordered union of all detectors, the first of
    each (name, URL). Sources: 0 JSON-LD, 1 meta, 2 byline links, 3 links to author pages, 4 microdata, 5 title.

    A profile page is on the article's site and isn't the article: of links elsewhere only the name stays."""
    return _with(rows, _found())


def candidate_score(c: Column, here: Column) -> Column:
    flag = lambda ok: F.coalesce(ok, F.lit(False)).cast("int")
    url = c["profile_url"]
    return flag(c["name"].isNotNull()) + flag(url.isNotNull()) + flag(urls.same_domain(url, here)) + flag(urls.looks_like_author_page(url))


def choose_author(found: Column, here: Column) -> Column:
    """The candidate with most of: a name, a URL, on the same site, that looks like an author page; the earliest of equals. Null without any."""
    scored = F.transform(found, lambda c, i: F.struct((-candidate_score(c, here)).alias("s"), i.alias("i"), c.alias("c")))
    return dom.first(F.array_sort(scored))["c"]


def choose_authors(found: Column, most: int = 10) -> Column:
    """The first candidate of each name, so many at most."""
    named = F.filter(found, lambda c: c["name"].isNotNull())
    names = F.slice(F.array_distinct(F.transform(named, lambda c: F.lower(c["name"]))), 1, most)
    return F.transform(names, lambda n: F.element_at(F.filter(named, lambda c: F.lower(c["name"]) == n), 1))


def crawl(articles: DataFrame, captured: DataFrame) -> DataFrame:
    """articles(page_id, url, html) and all captured pages(url, html) to (page_id, article_url, status, the author's record, authors).

    status: blocked or paywall of either page, no_author_found, no_author_page, error where the profile page isn't among the captured ones, success.
    authors has all of several: the first with the record, others with their own page's, or with name and URL where it has none. Of repeated
    captures of a URL the least counts. page_id names an article; repeated ones count once."""
    page = candidates(parsed(articles.withColumn("url", urls.normalize_article_url(F.col("url")))))
    page = page.select("page_id", F.col("url").alias("article_url"), page_state(F.col("page"), F.col("html")).alias("state"), choose_author(F.col("found"), F.col("url")).alias("chosen"), choose_authors(F.col("found")).alias("several"))
    rest = F.transform(F.slice("several", 2, 9), lambda c, i: F.struct((i + 1).alias("place"), c["name"].alias("name"), c["profile_url"].alias("profile_url")))
    slots = F.concat(F.array(F.struct(F.lit(0).alias("place"), F.col("chosen.name").alias("name"), F.col("chosen.profile_url").alias("profile_url"))), F.when(F.size("several") > 1, rest).otherwise(F.array().cast("array<struct<place int, name string, profile_url string>>")))
    fetched = F.col("state").isin("blocked", "paywall")
    slots = F.when(fetched | F.col("chosen").isNull(), F.array().cast("array<struct<place int, name string, profile_url string>>")).otherwise(slots)
    asked = page.select("page_id", "article_url", "state", F.col("chosen").isNull().alias("none"), (F.size("several") > 1).alias("many"), F.explode_outer(slots).alias("s"))
    open_to = F.coalesce(urls.same_domain(F.col("s.profile_url"), F.col("article_url")), F.lit(False))
    # A profile that isn't fetched has a key of its own that no page has: no task gets all of these rows.
    asked = asked.withColumn("url", F.when(open_to, F.col("s.profile_url"))).withColumn("key", F.coalesce("url", F.concat(F.lit("\u0001"), F.col("page_id").cast("string"))))
    if articles.sparkSession.sparkContext.getCheckpointDir():
        asked = asked.checkpoint()  # narrow, and read twice: else articles are parsed for each reading
    wanted = captured.select("url", "html").join(asked.select("url").where("url is not null").distinct(), "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    known = author_fields(parsed(wanted))
    known = known.select(F.col("url").alias("key"), page_state(F.col("page"), F.col("html")).alias("page_state"), F.col("name").alias("page_name"), *FIELDS)
    got = asked.join(known, "key", "left")
    stub = F.coalesce(F.col("page_state").isin("blocked", "paywall"), F.lit(True))
    main = F.col("s.place") == 0
    own = F.when(~stub, F.col("page_name"))
    record = F.struct(
        F.col("s.place").alias("place"), F.col("page_state").alias("state"), F.when(main, F.coalesce("s.name", own)).otherwise(F.coalesce(own, "s.name")).alias("name"),
        F.when(main, F.col("url")).otherwise(F.col("s.profile_url")).alias("profile_url"), *[F.when(~stub, F.col(f)).alias(f) for f in FIELDS],
    )
    kept = ["article_url", "state", "none", "many"]
    out = got.groupBy("page_id").agg(*[F.first(c).alias(c) for c in kept], F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), record))).alias("all")).withColumn("r", dom.first(F.col("all")))
    status = (
        F.when(F.col("state").isin("blocked", "paywall"), F.col("state")).when(F.col("none"), "no_author_found").when(F.col("r.profile_url").isNull(), "no_author_page")
        .when(F.col("r.state").isNull(), "error").when(F.col("r.state").isin("blocked", "paywall"), F.col("r.state")).otherwise("success")
    )
    authors = F.transform("all", lambda r: F.struct(*[r[f].alias(f) for f in lists.AUTHOR_FIELDS]))
    out = out.withColumn("status", status)
    return out.select("page_id", "article_url", "status", *[F.col(f"r.{f}").alias(f) for f in lists.AUTHOR_FIELDS], F.when((F.col("status") == "success") & F.col("many"), authors).alias("authors"))
