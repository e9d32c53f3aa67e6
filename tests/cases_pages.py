"""Queries of the page operators: small pages in turn over the suppliers, each with what must be read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import dom
from folioscope.operators import pages as P
from folioscope.operators import results as R
from cases import cases

KEY = "s_suppkey"
URL = "https://press.org/authors/u§/"
LONG = "Some words of a story that goes on for a while, and then for a while more. "


def page(body: str, head: str = "") -> str:
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def ld(body: str) -> str:
    return f'<script type="application/ld+json">{body}</script>'


def fields(rows: DataFrame) -> DataFrame:
    return P.author_fields(P.parsed(rows.withColumn("url", F.concat(F.lit("https://press.org/authors/u"), F.col(KEY).cast("string"), F.lit("/")))))


def found(rows: DataFrame) -> DataFrame:
    return P.candidates(P.parsed(rows.withColumn("url", F.concat(F.lit("https://press.org/news/"), F.col(KEY).cast("string")))))


def of_pages(name: str, pages: list[str], outputs: dict, prepare) -> None:
    cases(name, {"html": pages}, outputs, "supplier", KEY, prepare)


def parse(rows: DataFrame) -> DataFrame:
    return dom.with_dom(rows)


def both(rows: DataFrame) -> DataFrame:
    return dom.with_dom(P.parsed(rows.withColumn("url", F.lit("https://press.org/"))))


def listed(c):
    """Candidates as source:name>url."""
    one = lambda s: F.concat(s["source"].cast("string"), F.lit(":"), F.coalesce(s["name"], F.lit("-")), F.lit(">"), F.coalesce(F.regexp_replace(s["profile_url"], "^https://press.org", ""), F.lit("-")))
    return F.array_join(F.transform(c("found"), one), " ")


# ---- the DOM ---------------------------------------------------------------------------------------------------------

of_pages(
    "f61_f62_f65_node_texts",
    [
        page("<p>a  <b>b §</b><!-- c --><script>var d;</script><p>e<style>f</style><noscript>g</noscript>"),
        page("<div class='x  y'> <i> </i>one</div>two<br>three<svg><text>s</text></svg>"),
        page('<a data-x="u§@press.org" data-cfemail="00" href="#">l</a><template>t</template>&lt;k&gt;'),
    ],
    {
        "text": (lambda c: c("dom")["text"], ["a b § e g", "one two three s", "l <k>"]),
        "raw": (lambda c: F.regexp_replace(c("dom")["raw"], r"\s+", " "), ["a b § c e", " one two three s", "l t <k>"]),
        "first": (lambda c: dom.text(c("dom"), dom.first(dom.by_tag(c("dom"), "p", "div", "a"))), ["a b § e g", "one", "l"]),
        "boxes": (lambda c: F.size(dom.select("dom", ".y")) + F.size(dom.select("dom", "div i")) + F.size(dom.select("dom", "[href]")), [0, 2, 1]),
        "data": (lambda c: F.array_join(F.flatten(F.transform(c("dom")["nodes"], dom.data_attributes)), ","), ["", "", "u§@press.org"]),
        "content": (lambda c: c("dom")["content"], [None, None, None]),
    } | {"content": (lambda c: c("dom")["content"] > 6, [True, True, False])},
    parse,
)
of_pages(
    "f8_f10_f11_page_states",
    [
        page(LONG * 4), page("<svg><text>" + LONG * 4 + "</text></svg>short §"), page("<noscript>" + LONG * 4 + "</noscript>", "<title>" + LONG * 4 + "</title>"), page(LONG * 4, "<title>Just a MOMENT...</title>"),
        page(LONG * 4 + "<div id=cf-chl>"), page(LONG * 4, "<title>Premium Content</title>"), page(LONG * 4 + "<p>Register for FREE to continue reading §"), page(LONG * 120 + "<p>paywall"), page(""),
    ],
    {"state": (lambda c: P.page_state(c("dom"), c("html")), ["ok", "thin", "thin", "blocked", "blocked", "paywall", "paywall", "paywall", "thin"])},
    parse,
)
of_pages(
    "f63_f64_a15_lookups",
    [
        page("<p class='role'> </p><p class='position'>Night \n editor §</p>", '<meta property="og:site_name" content=" The Daily "><meta name="application-name" content="THE DAILY">'),
        page("<p class='role'></p><p class='role'>Second</p>", '<meta name="OG:site_name" content="x§"><meta name="application-name" content="App">'),
        page("", ""),
    ],
    {
        "role": (lambda c: dom.first_text("dom", [".role", ".position"]), ["Night editor §", None, None]),
        "site": (lambda c: dom.meta("dom", "og:site_name"), ["The Daily", "x§", None]),
        "names": (lambda c: F.array_join(P.site_names(c("page")), ";"), ["the daily", "x§;app", ""]),
    },
    both,
)
of_pages(
    "s11_f40_f41_f42_embedded_json",
    [
        page("", ld('{"@type":["Thing","OrganizationalPerson"],"name":" Ann § ","worksFor":{"name":""},"affiliation":"Org §","x":[{"@type":"Person","name":3},{"@type":"NewsMediaOrganization","name":"N"}]}')),
        page("", ld('//<![CDATA[\n{"@type":"Person","name":"Bob"}\n//]]>')),
        page("", ld('/* {"@type":"Person","name":"Cat"} */') + ld("{broken") + ld('[{"@type":"Person","name":"Dan","address":{"addressRegion":"R§"}}]')),
        page("", '<script type="text/javascript">{"@type":"Person","name":"Eve"}</script>'),
    ],
    {
        "nodes": (lambda c: F.size(c("ld")), [4, 1, 3, 0]),
        "people": (lambda c: F.array_join(F.transform(P._typed(c("ld"), "Person"), lambda p: F.coalesce(p["name"], F.lit("-"))), ","), ["Ann §,-", "Bob", "Cat,Dan", ""]),
        "org": (lambda c: P._first(c("ld"), "org"), ["Org §", None, None, None]),
        "place": (lambda c: P._first(c("ld"), "place"), [None, None, "R§", None]),
        "media": (lambda c: P._first(P._typed(c("ld"), "Organization"), "name"), ["Ann §", None, None, None]),
    },
    lambda rows: P.parsed(rows.withColumn("url", F.lit("https://press.org/"))),
)

# ---- the author record -----------------------------------------------------------------------------------------------

of_pages(
    "e1_f14_names",
    [
        page("<h1>Bob</h1>", ld('{"@type":"Person","name":" "}') + ld('{"@type":"Person","name":"Ann §"}')),
        page("<h1>The  <b>Daily</b></h1><h1>Bob</h1>", '<meta property="og:site_name" content="the daily"><meta name="byl" content="' + "x" * 80 + '"><meta name="AUTHOR" content=" Cat § ">'),
        page("<h1> Dan  § </h1>"), page("<h1></h1><p>x"), page(f"<h1>{'y' * 80}</h1>", '<meta property="byline" content="Eve">'),
    ],
    {"name": (lambda c: c("name"), ["Ann §", "Cat §", "Dan §", None, "Eve"])},
    fields,
)
PROSE = "Ann writes about the sea, about ships and about those who live by them."
of_pages(
    "e2_f15_a7_a8_bios",
    [
        page("", ld('{"@type":"Person","description":"short"}') + ld('{"@type":"Person","description":"<b>Writes</b> of ships and the sea."}')),
        page("", '<meta name="Description" content="<i>A page on Ann</i>  who writes">'), page("<div class='bio'>too short</div><div class='about-author'>A reporter on  ships §.</div>", '<meta name="description" content="short">'),
        page(f"<main><ul><li><p>{PROSE * 2}</ul><p><a href=x>{PROSE * 2}</a></p><p>{PROSE}</p><p>{PROSE}!</p></main><p>{PROSE * 3}</p>"), page(f"<article><p>{PROSE}</p></article><p>{PROSE * 2}"),
        page(f"<p>{PROSE}</p><p>{PROSE[::-1]}</p>"), page("<p>" + "word " * 500 + "</p>"), page("<p>fifty characters are not enough to be taken for it"),
    ],
    {"bio": (lambda c: c("bio"), ["Writes of ships and the sea.", "A page on Ann who writes", "A reporter on ships §.", PROSE + "!", PROSE, PROSE, ("word " * 400).strip() + " ", None])},
    fields,
)
of_pages(
    "e3_e5_e6_places_and_roles",
    [
        page("<i class='job-title'>Desk</i>", ld('{"@type":"Person","jobTitle":"Editor §","worksFor":{"x":1},"memberOf":"Club","address":{"addressLocality":"","addressRegion":"North"}}')),
        page("<i class='author__position'>Desk  §</i><b class='author-city'>Town</b>", ld('{"@type":"NewsMediaOrganization","name":"Org §"}')),
        page("<div class=author><i class=role>Inner</i></div><b class=location>Port</b>", '<meta property="og:site_name" content="The Daily">'),
        page("<div class=bio>Ann is a staff writer for the Daily §.</div><h1>Ann</h1>", '<meta name="application-name" content="App">'), page("<p>x"),
    ],
    {
        "job_title": (lambda c: c("job_title"), ["Editor §", "Desk §", "Inner", "staff writer", None]),
        "location": (lambda c: c("location"), ["North", "Town", "Port", None, None]),
        "organization": (lambda c: c("organization"), ["Club", "Org §", "The Daily", "App", None]),
    },
    fields,
)
MANY = "a" * 420
of_pages(
    "e4_e9_w2_o1_o3_o4_u2_emails",
    [
        page("<h1>Ann Doe</h1><div class=author>zed@x.org desk@press.org <a href='mailto:ann§@mail.org?subject=x'>m</a> doe@press.org</div>"),
        page("<div class=profile><a data-cfemail='2a4b6a484e046d58'>x</a><a data-cfemail='zz'>y</a><b data-mail='to: b§@press.org.' data-n=1>z</b></div>"),
        page("<footer>desk@press.org</footer><main>main§@press.org</main>", ld('{"@type":"Person","email":"Own§@Else.net"}')),
        page("other§@press.org <!-- hidden@press.org --><script>no@press.org</script><noscript>nor@press.org</noscript>"),
        page(f"<div class=author><a href=' MAILTO:{MANY}@press.org'>m</a> at dot</div><article>x@y.org</article>"),
        page("<div class=author>u§ at press dot org</div><div class=byline>logo@2x.png u@example.com</div>"),
        page("<div class=author>write to me at</div><div class=staff>press dot org</div>"),
    ],
    {
        "email": (lambda c: c("email"), ["doe@press.org", "b§@press.org", "Own§@Else.net", "hidden@press.org", f"{MANY}@press.org", "u§@press.org", None]),
        "emails": (
            lambda c: F.array_join(c("emails"), " "),
            ["doe@press.org ann§@mail.org zed@x.org desk@press.org", "b§@press.org a@bd.Gr", "main§@press.org Own§@Else.net", "hidden@press.org other§@press.org", f"{MANY}@press.org", "u§@press.org", ""],
        ),
    },
    fields,
)
of_pages(
    "p1_spelt_out_emails",
    [
        page("<article><p>La r\u00f3jatadotaga de u§atdotorg, ua at udotorg.</p></article>"),
        page("<article><p>Write to u§ [at] press [dot] org, v(at)press(dot)org or w at press dot org.</p></article>"),
    ],
    {"emails": (lambda c: F.array_join(F.array_sort(c("emails")), " "), ["", "u§@press.org v@press.org w@press.org"])},
    fields,
)
CITED = "Ann has written at length about the firm <a href='https://x.com/cited'>on its account</a>, its people, its ships and the sea."
of_pages(
    "e7_f12_a2_a3_a16_o2_p6_accounts",
    [
        page(f"<div class='author profile'><p>{CITED}</p><a href='https://github.com/g§'>g</a><a href='//x.com/a?utm_source=b#c'>1</a><a href='https://twitter.com/b'>2</a></div><footer><a href='https://facebook.com/site'>f</a></footer>"),
        page("<div class=author><a href='/self'>s</a></div><main><a href='https://www.linkedin.com/in/u§'>l</a><a href='https://linkedin.com/company/x'>c</a></main>"),
        page("<a href='https://x.com/nowhere'>n</a>", ld('{"@type":"Person","sameAs":["https://x.com/own§","https://lnkd.in/z",3]}')),
        page("<div class=byline><a href='https://x.com/linked'>n</a><a href='https://mas.to/@m'>m</a></div>", ld('{"@type":"Person","sameAs":["https://x.com/own§"]}') + ld('{"@type":"Organization","sameAs":["https://mas.to/@org"]}')),
        page("<div class=author><header>h</header><a href='https://x.com/wrapped'>n</a></div><p class=author><a href='https://x.com/short'>Short § line</a></p>"),
    ],
    {
        "social": (
            lambda c: R.social_string(c("social_links")),
            ["github: https://github.com/g§; twitter: https://x.com/a", "linkedin: https://www.linkedin.com/in/u§", "linkedin: https://lnkd.in/z; twitter: https://x.com/own§", "mastodon: https://mas.to/@m; twitter: https://x.com/own§", "twitter: https://x.com/short"],
        ),
        "linkedin": (lambda c: c("linkedin"), [None, "https://www.linkedin.com/in/u§", "https://lnkd.in/z", None, None]),
        "twitter": (lambda c: c("twitter"), ["https://x.com/a", None, "https://x.com/own§", "https://x.com/own§", "https://x.com/short"]),
    },
    fields,
)
of_pages(
    "e16_e17_u3_u4_f13_scopes",
    [
        page("<div class='x author'>1</div><div class=person>2<i class=my-author-x>3</i></div><article>4</article><main>5</main>"), page("<div class=author><footer>f</footer></div><main>5 §</main>"),
        '<html><body class="author-page"><p class=reporter>r</p></body></html>', page("<article>a</article><main>m</main><article>b</article>"),
    ],
    {
        "scopes": (lambda c: F.array_join(F.transform(P.author_scopes(), lambda s: dom.text(c("dom"), s)), "|"), ["1|2 3|1|3|2 3", "", "r", ""]),
        "mains": (lambda c: F.array_join(F.transform(P.main_scopes(c("dom")), lambda s: dom.text(c("dom"), s)), "|"), ["5|4", "5 §", "", "m|a|b"]),
    },
    parse,
)

# ---- candidates ------------------------------------------------------------------------------------------------------

of_pages(
    "e10_f17_ld_candidates",
    [
        page("", ld('{"author":"Ann Doe","@type":"Article","x":{"@type":"Author","name":"Bob § !","url":"/authors/b/"}}')),
        page("", ld('[{"@type":"Person","name":"Cat","url":"https://press.org/c§"},{"@type":"Person","name":"Dan","url":"https://x.com/d"}]')),
        page("", ld('{"@type":"Person","name":"Eve","sameAs":["https://x.com/e","https://press.org/e","https://blog.press.org/e§"]}')), page("", ld('{"author":"https://x.org"}') + ld('{"@type":"Thing","name":"Fay"}')),
    ],
    {"found": (listed, ["0:Ann Doe>- 0:Bob § !>-", "0:Cat>/c§ 0:Dan>-", "0:Eve>/e 0:Eve>https://blog.press.org/e§ 0:Eve>-", ""])},
    found,
)
of_pages(
    "e11_meta_candidates",
    [
        page("", '<meta name="Author" content="Ann Doe, Bob Roe; Cat and Dan § Lee"><meta name="twitter" content="Zed">'), page("", '<meta property="article:author" content="https://facebook.com/x"><meta name="byl" content="https://press.org/u§">'),
        page("", '<meta name="author" content="View All"><meta name="dc.creator" content=" ">'), page("", '<meta name="author" content="Ann AND Bob"><meta name="author" content="ann and bob">'),
    ],
    {"found": (listed, ["1:Ann Doe>- 1:Bob Roe>- 1:Cat>- 1:Dan § Lee>-", "1:->/u§", "", "1:Ann AND Bob>- 1:ann>- 1:bob>-"])},
    found,
)
of_pages(
    "e12_f16_byline_candidates",
    [
        page('<a rel="author nofollow" href="/a/u§?utm_source=x">Ann  Doe</a>'), page('<p class=byline><a href="https://x.com/b">Bob</a><a href="/news/§">Self</a><a>Cat</a></p>'),
        page('<b class=my-author-box><a href="/d">View all</a></b>'), page('<a rel=author href="javascript:x()">Eve</a><a class="author-name" href="/e">Eve</a>'),
    ],
    {"found": (listed, ["2:Ann Doe>/a/u§", "2:Bob>- 2:Cat>-", "2:->/d", "2:Eve>- 2:Eve>/e"])},
    found,
)
of_pages(
    "e13_e14_e15_u1_a9_candidates",
    [
        page('<a href="/staff/u§/">Ann Doe</a><a href="/staff/">All</a><a href="https://staff.press.org/z">Read more</a><a href="https://else.org/staff/u/">Else</a>'),
        page('<i itemprop=author>Bob Roe</i><a itemprop=author href="/b">Cat</a><div itemprop=author itemscope><b itemprop=name>Dan §</b><link itemprop=url href="/d"><a href="/people/d/">p</a></div>'),
        page("x", "<title>Ships sail - By Eve O'Neil | The Daily</title>"), page("x", "<title>Passed by popular demand</title>"),
        page('<a rel=author href="/authors/f§/">Fay</a>', ld('{"@type":"Person","name":"Fay","url":"https://press.org/authors/f§/"}') + '<meta name=author content="fay"><meta name=author content="Fay">'),
    ],
    {
        "found": (
            listed,
            ["3:Ann Doe>/staff/u§/ 3:All>/staff/ 3:->https://staff.press.org/z", "3:p>/people/d/ 4:Bob Roe>- 4:Cat>/b 4:Dan §>/d 4:->/people/d/", "5:Eve O'Neil>-", "5:popular demand>-", "0:Fay>/authors/f§/ 1:fay>-"],
        )
    },
    found,
)
of_pages(
    "a6_a10_o5_w3_choices",
    [
        page('<meta name=author content="Ann"><a rel=author href="/x">Bob §</a><a rel=author href="/y">Cat</a>'), page('<a rel=author href="/x">Bob</a><a rel=author href="/authors/c§/">View all</a><a rel=author href="/authors/d/">Dan</a>'),
        page("".join(f'<meta name=author content="{n}a, {n}b, {n}A">' for n in ("q", "r", "s", "t", "u", "v"))), page("<p>none"),
    ],
    {
        "chosen": (lambda c: F.concat_ws(">", F.coalesce(P.choose_author(c("found"), c("url"))["name"], F.lit("-")), F.regexp_replace(P.choose_author(c("found"), c("url"))["profile_url"], "^https://press.org", "")), ["Bob §>/x", "Dan>/authors/d/", "qa", "-"]),
        "several": (lambda c: F.array_join(F.transform(P.choose_authors(c("found")), lambda a: a["name"]), ","), ["Ann,Bob §,Cat", "Bob,Dan", "qa,qb,ra,rb,sa,sb,ta,tb,ua,ub", ""]),
    },
    found,
)
