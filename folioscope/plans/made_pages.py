"""Author pages and articles written from the tables' columns, and the queries that read them back.

Every text on a page is a column's, or made of columns: names, posts, places, houses, addresses and accounts come from customer, nation and region, and a customer's
market segment says which markup holds them. The SQL computes the same record from the columns, and knows nothing of pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..operators import linked_data
from ..operators import pages as P
from ..operators import results as R
from .register import query, read, read_dealt

#: A person for each customer, as SQL that both engines read.
PERSON = {
    "page_id": "c_custkey", "seg": "c_mktsegment", "who": "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || replace(c_name, '#', ' ')", "slug": "lower(replace(c_name, '#', '.'))",
    "org": "replace(n_name, '_', ' ') || ' Press'", "place": "upper(left(r_name, 1)) || lower(substr(r_name, 2))", "job": "lower(c_mktsegment) || ' editor'", "rich": "c_acctbal > 5000", "sum": "CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR(20))",
}
TEXTS = {
    "bio": "who || ' writes about ' || job || 's of ' || place || ' and was paid ' || sum || ' so far.'",
    "prose": "who || ' has written at length about ' || org || ' on its account, its people, its ships and the sea off ' || place || '.'",
    "told": "who || ' is a ' || job || ' for ' || org || ' and has lived in ' || place || ' for ' || sum || ' days.'",
    "url": "'https://press.org/authors/' || slug || '/'",
}
FROM = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
PEOPLE = "WITH person AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PERSON.items()) + f" FROM {FROM}), people AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in TEXTS.items()) + " FROM person) "


def people(spark, sf_dir) -> DataFrame:
    c, n, r = read_dealt(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in PERSON.items()]).selectExpr("*", *[f"{e} AS {n}" for n, e in TEXTS.items()])


def filled(template: str):
    """A template's {column}s filled in."""
    out = F.lit(template)
    for name in [*PERSON, *TEXTS]:
        if "{" + name + "}" in template:
            out = F.replace(out, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return out


def by_segment(templates: dict[str, str]):
    out = F.when(F.lit(False), "")
    for seg, template in templates.items():
        out = out.when(F.col("seg") == seg, filled(template))
    return out


def ld(body: str) -> str:
    return f'<script type="application/ld+json">{body}</script>'


FOOT = '<footer><a href="https://facebook.com/site">f</a> desk@press.org</footer></body></html>'
AUTHORS = {
    "AUTOMOBILE": "<html><head>" + ld('{"@graph":[{"@type":"WebSite","name":"Site"},{"@type":["Thing","Person"],"name":" {who} ","jobTitle":"{job}","description":"<b>{bio}</b>","email":"{slug}@press.org","worksFor":{"name":""},"memberOf":"{org}","address":{"addressLocality":"","addressRegion":"{place}"},"sameAs":["https://x.com/{slug}","/@{slug}","https://www.linkedin.com/in/{slug}/",7]}]}') + '</head><body><h1>Another</h1><div class=author><i class=role>Boss</i><a href="https://github.com/{slug}?utm_source=x">g</a><a href="https://x.com/linked">x</a></div>' + FOOT,
    "BUILDING": '<html><head><meta property="og:site_name" content=" {org} "></head><body><h1>{who}</h1><div class="author profile"><p class="author-title">{job}</p><span class="author__city author-city">{place}</span><a href="mailto:{slug}@press.org?subject=hi">m</a> desk@press.org zed@else.org<a href="https://github.com/{slug}">g</a><a href="//x.com/{slug}#b">x</a><a href="https://x.com/second">y</a><div class="author-bio">{bio}</div></div>' + FOOT,
    "FURNITURE": "<html><head>" + ld("//<![CDATA[\n" + '{"@type":"Person","name":"{who}"}' + "\n//]]>") + '<meta name="application-name" content="{org}"></head><body><main><ul><li><p>{prose} {prose}</p></li></ul><p><a href="/all">{prose} {prose}</a></p><p>{prose} <a href="https://x.com/cited">x</a></p><a href="https://mas.to/@{slug}">m</a><b data-mail="to: {slug}@press.org.">w</b><em class="job-title">{job}</em><b class=location>{place}</b></main><p>{prose} {prose} {prose}</p>' + FOOT,
    "HOUSEHOLD": '<html><head><title>{org}</title><meta property="og:site_name" content="{org}"><meta name="byl" content="{who}"></head><body><h1>{org}</h1><p>Short.</p><a href="https://x.com/{slug}">x</a>' + FOOT,
    "MACHINERY": '<html><head></head><body class="author-page"><h1>  {who} </h1><div class="staff"><header>h</header><article><p>{told}</p><a href="https://lnkd.in/{slug}">l</a><a href="https://linkedin.com/company/{slug}">c</a>Write to {slug} [at] press [dot] org</article></div>' + FOOT,
}


def author_pages(spark, sf_dir) -> DataFrame:
    rows = people(spark, sf_dir)
    html = F.when((F.col("seg") == "HOUSEHOLD") & F.col("rich"), F.replace(by_segment(AUTHORS), F.lit("<meta name"), F.concat(F.lit('<meta name="Description" content="<i>'), "bio", F.lit('</i>"><meta name')))).otherwise(by_segment(AUTHORS))
    return rows.select("page_id", "url", html.alias("html"))


def records(spark, sf_dir) -> DataFrame:
    return P.author_fields(P.parsed(author_pages(spark, sf_dir)))


NAME = "who"
BIO = "CASE seg WHEN 'AUTOMOBILE' THEN bio WHEN 'BUILDING' THEN bio WHEN 'FURNITURE' THEN prose || ' x' WHEN 'HOUSEHOLD' THEN CASE WHEN rich THEN bio END ELSE told END"
JOB = "CASE WHEN seg <> 'HOUSEHOLD' THEN job END"
PLACE = "CASE WHEN seg IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN place END"
ORG = "CASE WHEN seg <> 'MACHINERY' THEN org END"
EMAIL = "CASE seg WHEN 'HOUSEHOLD' THEN 'desk@press.org' ELSE slug || '@press.org' END"
EMAILS = "CASE seg WHEN 'HOUSEHOLD' THEN 'desk@press.org' WHEN 'BUILDING' THEN slug || '@press.org zed@else.org desk@press.org' ELSE slug || '@press.org' END"
LINKEDIN = "CASE seg WHEN 'AUTOMOBILE' THEN 'https://www.linkedin.com/in/' || slug || '/' WHEN 'MACHINERY' THEN 'https://lnkd.in/' || slug END"
TWITTER = "CASE WHEN seg IN ('AUTOMOBILE', 'BUILDING') THEN 'https://x.com/' || slug END"
SOCIAL = "CASE seg WHEN 'AUTOMOBILE' THEN 'github: https://github.com/' || slug || '; linkedin: https://www.linkedin.com/in/' || slug || '/; twitter: https://x.com/' || slug WHEN 'BUILDING' THEN 'github: https://github.com/' || slug || '; twitter: https://x.com/' || slug WHEN 'FURNITURE' THEN 'mastodon: https://mas.to/@' || slug WHEN 'MACHINERY' THEN 'linkedin: https://lnkd.in/' || slug ELSE '' END"


@query(f"{PEOPLE} SELECT page_id, {NAME} AS name, {JOB} AS job_title, {BIO} AS bio, {EMAIL} AS email, {ORG} AS organization, {PLACE} AS location, {SOCIAL} AS social FROM people")
def p1_author_records(spark, sf_dir):
    return records(spark, sf_dir).select("page_id", "name", "job_title", "bio", "email", "organization", "location", R.social_string(F.col("social_links")).alias("social"))


@query(f"{PEOPLE} SELECT page_id, {NAME} AS name FROM people")
def e1_f14_names(spark, sf_dir):
    return records(spark, sf_dir).select("page_id", "name")


@query(f"{PEOPLE} SELECT page_id, {BIO} AS bio FROM people")
def e2_f15_a7_a8_bios(spark, sf_dir):
    return records(spark, sf_dir).select("page_id", "bio")


@query(f"{PEOPLE} SELECT page_id, {JOB} AS job_title, {PLACE} AS location, {ORG} AS organization FROM people")
def e3_e5_e6_places_and_roles(spark, sf_dir):
    return records(spark, sf_dir).select("page_id", "job_title", "location", "organization")


@query(f"{PEOPLE} SELECT page_id, {EMAIL} AS email, {EMAILS} AS emails FROM people")
def e4_e9_w2_o1_o3_o4_u2_emails(spark, sf_dir):
    return records(spark, sf_dir).select("page_id", "email", F.array_join("emails", " ").alias("emails"))


@query(f"{PEOPLE} SELECT page_id, {SOCIAL} AS social, {LINKEDIN} AS linkedin, {TWITTER} AS twitter FROM people")
def e7_f12_a2_a3_a16_o2_p6_accounts(spark, sf_dir):
    return records(spark, sf_dir).select("page_id", R.social_string(F.col("social_links")).alias("social"), "linkedin", "twitter")


@query(
    f"{PEOPLE} SELECT page_id, CASE seg WHEN 'AUTOMOBILE' THEN 'Boss g x' WHEN 'BUILDING' THEN job || ' ' || place || ' m desk@press.org zed@else.org g x y ' || bio || '|' || job || '|' || place || '|' || bio ELSE '' END AS scopes,"
    " CASE seg WHEN 'FURNITURE' THEN length(prose) * 5 + 12 + length(job) + length(place) WHEN 'MACHINERY' THEN length(told) + length(slug) + 35 ELSE 0 END::BIGINT AS mains FROM people"
)
def e16_e17_u3_u4_f13_scopes(spark, sf_dir):
    """Texts of the author's blocks, each once, and the length of the content regions' texts."""
    rows = dom.with_dom(author_pages(spark, sf_dir))
    scopes = F.array_distinct(F.transform(P.author_scopes(), lambda s: dom.text(F.col("dom"), s)))
    mains = F.aggregate(P.main_scopes(F.col("dom")), F.lit(0), lambda n, s: n + dom.text_length(s))
    return rows.select("page_id", F.array_join(scopes, "|").alias("scopes"), mains.cast("long").alias("mains"))


@query(
    f"{PEOPLE} SELECT page_id, CASE seg WHEN 'AUTOMOBILE' THEN 'Boss' WHEN 'BUILDING' THEN job WHEN 'FURNITURE' THEN job END AS role, CASE WHEN seg IN ('BUILDING', 'HOUSEHOLD') THEN org END AS site,"
    " CASE WHEN seg IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE') THEN lower(org) ELSE '' END AS names FROM people"
)
def f63_f64_a15_lookups(spark, sf_dir):
    from ..functions import lists

    rows = dom.with_dom(P.parsed(author_pages(spark, sf_dir)))
    return rows.select("page_id", dom.first_text("dom", lists.JOB_SELECTORS).alias("role"), dom.meta("dom", "og:site_name").alias("site"), F.array_join(P.site_names(F.col("page")), ";").alias("names"))


# ---- embedded JSON of varying depth ---------------------------------------------------------------------------------


@query(
    f"{PEOPLE}, depth AS (SELECT *, length(sum) AS d FROM people) SELECT page_id, (CASE WHEN rich THEN d + 3 ELSE d + 2 END)::BIGINT AS nodes, CASE WHEN rich THEN who || ',' || job ELSE who END AS people, CASE WHEN rich THEN org END AS org, place FROM depth"
)
def s11_f40_f41_f42_embedded_json(spark, sf_dir):
    """A person as deep in the JSON as the digits of the balance, the house in a list beside; for the rich a second, broken and a third block."""
    wrapped = F.concat(F.repeat(F.lit('{"x":['), F.length("sum")), filled('{"@type":"Person","name":"{who}","address":{"addressLocality":"{place}"}}'), F.repeat(F.lit("]}"), F.length("sum")))
    more = F.when(F.col("rich"), filled(ld("{broken {who}") + ld('/* [{"@type":["CollegePerson"],"name":" {job}","worksFor":"{org}"}] */'))).otherwise(ld("[]") + ld("[1, null, \"{}\"]"))
    rows = people(spark, sf_dir).select("page_id", "url", F.concat(F.lit('<script type="application/ld+json">'), wrapped, F.lit("</script>"), more).alias("html"))
    ps = P._typed(F.col("ld"), "Person")
    return P.parsed(rows).select("page_id", F.size("ld").cast("long").alias("nodes"), F.array_join(F.transform(ps, lambda p: p["name"]), ",").alias("people"), P._first(F.col("ld"), "org").alias("org"), P._first(ps, "place").alias("place"))


@query(
    f"{PEOPLE}, depth AS (SELECT *, length(sum) AS d FROM people) SELECT page_id, 0 AS block, (d + 1)::INTEGER AS place, (d + 1)::INTEGER AS depth, who AS name, job, place AS town, length(slug)::BIGINT AS years, CASE WHEN rich THEN slug || ',' || org ELSE org END AS awards FROM depth"
)
def f40_f42_ld_relation(spark, sf_dir):
    """Persons out of JSON as deep as their balance has digits, their town from the object beside, and fields that no record knows: a number and a list."""
    body = filled('{"w":[{"@type":["Thing","Person"],"name":" {who} ","jobTitle":"{job}","years":YEARS,"award":[LIST"{org}"],"address":{"addressLocality":"{place}"}}]}')
    body = F.replace(F.replace(body, F.lit("YEARS"), F.length("slug").cast("string")), F.lit("LIST"), F.when(F.col("rich"), F.concat(F.lit('"'), "slug", F.lit('",'))).otherwise(""))
    wrapped = F.concat(F.lit('<script type="application/ld+json">'), F.repeat(F.lit('{"x":['), F.length("sum")), body, F.repeat(F.lit("]}"), F.length("sum")), F.lit("</script>"))
    pages = people(spark, sf_dir).select("page_id", wrapped.alias("html"))
    more = linked_data.objects(pages).where(linked_data.typed("Person")).select("page_id", "place", "depth", linked_data.field("years", "bigint").alias("years"), F.array_join(linked_data.field("award", "array<string>"), ",").alias("awards"))
    return linked_data.people(pages, "page_id").join(more, ["page_id", "place"]).select("page_id", "block", "place", "depth", "name", "job", "town", "years", "awards")


# ---- candidates -----------------------------------------------------------------------------------------------------

ARTICLE = {
    "AUTOMOBILE": ld('[{"author":"{org}","@type":"Article"},{"@type":"Author","name":"{who}","url":"{url}"},{"@type":"Person","name":"{place}","sameAs":["https://x.com/{slug}","https://blog.press.org/{slug}"]}]'),
    "BUILDING": '<meta name="Author" content="{who}, {org}; {place} and {who}"><meta property="article:author" content="https://press.org/staff/{slug}"><meta name="byl" content="https://facebook.com/{slug}">',
    "FURNITURE": '<p class=byline><a href="/authors/{slug}/?utm_source=x">{who}</a><a href="https://x.com/{slug}">{place}</a><a href="javascript:x()">{org}</a></p><a rel="author nofollow" href="/authors/{slug}/">{who}</a>',
    "HOUSEHOLD": '<div itemprop=author itemscope><b itemprop=name>{who}</b><link itemprop=url href="/u/{slug}"><a href="/people/{slug}/">{job}</a></div><i itemprop=author>{place}</i>',
    "MACHINERY": "<title>{place} news - By {who} | {org}</title>",
}
LONG = "Some words of a story that goes on for a while, and then for a while more. "


def articles(spark, sf_dir) -> DataFrame:
    return people(spark, sf_dir).select("page_id", "url", "slug", F.concat(F.lit("https://press.org/news/"), "slug").alias("article"), F.concat(F.lit("<html><body>"), by_segment(ARTICLE), F.lit(f"<p>{LONG * 4}</p></body></html>")).alias("html"))


def listed(found):
    """Candidates as source:name>url."""
    return F.array_join(F.transform(found, lambda s: F.concat(s["source"].cast("string"), F.lit(":"), F.coalesce(s["name"], F.lit("-")), F.lit(">"), F.coalesce(F.regexp_replace(s["profile_url"], "^https://press.org", ""), F.lit("-")))), " ")


def candidate_rows(spark, sf_dir) -> DataFrame:
    return P.candidates(P.parsed(articles(spark, sf_dir).select("page_id", F.col("article").alias("url"), "html")))


FOUND = {
    0: "CASE seg WHEN 'AUTOMOBILE' THEN '0:' || org || '>- 0:' || who || '>/authors/' || slug || '/ 0:' || place || '>https://blog.press.org/' || slug || ' 0:' || place || '>-' ELSE '' END",
    1: "CASE seg WHEN 'BUILDING' THEN '1:' || who || '>- 1:' || org || '>- 1:' || place || '>- 1:->/staff/' || slug ELSE '' END",
    2: "CASE seg WHEN 'FURNITURE' THEN '2:' || who || '>/authors/' || slug || '/ 2:' || place || '>- 2:' || org || '>-' ELSE '' END",
    3: "CASE seg WHEN 'HOUSEHOLD' THEN '3:' || job || '>/people/' || slug || '/ 4:' || who || '>/u/' || slug || ' 4:' || place || '>- 4:->/people/' || slug || '/' WHEN 'MACHINERY' THEN '5:' || who || '>-' ELSE '' END",
}


def _detected(name: str, first: int, last: int) -> None:
    def run(spark, sf_dir):
        return candidate_rows(spark, sf_dir).select("page_id", listed(F.filter("found", lambda c: c["source"].between(first, last))).alias("found"))

    run.__name__ = name
    query(f"{PEOPLE} SELECT page_id, {FOUND[first]} AS found FROM people")(run)


_detected("e10_f17_ld_candidates", 0, 0)
_detected("e11_meta_candidates", 1, 1)
_detected("e12_f16_byline_candidates", 2, 2)
_detected("e13_e14_e15_u1_a9_candidates", 3, 5)


@query(
    f"{PEOPLE} SELECT page_id, CASE seg WHEN 'AUTOMOBILE' THEN who || '>/authors/' || slug || '/' WHEN 'BUILDING' THEN '->/staff/' || slug WHEN 'FURNITURE' THEN who || '>/authors/' || slug || '/' WHEN 'HOUSEHOLD' THEN job || '>/people/' || slug || '/' ELSE who || '>-' END AS chosen,"
    " CASE seg WHEN 'AUTOMOBILE' THEN org || ',' || who || ',' || place WHEN 'BUILDING' THEN who || ',' || org || ',' || place WHEN 'FURNITURE' THEN who || ',' || place || ',' || org WHEN 'HOUSEHOLD' THEN job || ',' || who || ',' || place ELSE who END AS several FROM people"
)
def a6_a10_o5_w3_choices(spark, sf_dir):
    """A URL that looks like an author's page on the site outweighs a name alone."""
    rows = candidate_rows(spark, sf_dir)
    chosen = P.choose_author(F.col("found"), F.col("url"))
    short = F.concat(F.coalesce(chosen["name"], F.lit("-")), F.lit(">"), F.coalesce(F.regexp_replace(chosen["profile_url"], "^https://press.org", ""), F.lit("-")))
    return rows.select("page_id", short.alias("chosen"), F.array_join(F.transform(P.choose_authors(F.col("found")), lambda a: a["name"]), ",").alias("several"))


# ---- crawls ---------------------------------------------------------------------------------------------------------

CAPTURED = "(rich OR seg = 'AUTOMOBILE')"
STATUS = f"CASE WHEN seg IN ('AUTOMOBILE', 'FURNITURE') THEN CASE WHEN {CAPTURED} THEN 'success' ELSE 'error' END WHEN seg = 'MACHINERY' THEN 'no_author_page' ELSE 'error' END"


@query(f"{PEOPLE} SELECT page_id, 'https://press.org/news/' || slug AS article_url, {STATUS} AS status, CASE WHEN seg = 'BUILDING' THEN NULL WHEN seg = 'HOUSEHOLD' THEN job ELSE who END AS name, CASE WHEN {STATUS} = 'success' THEN {EMAIL} END AS email FROM people")
def s31_crawl(spark, sf_dir):
    """Articles by the site's people; of their own pages those of the rich and of one segment were captured."""
    captured = author_pages(spark, sf_dir).join(people(spark, sf_dir).where(CAPTURED).select("page_id"), "page_id", "left_semi")
    rows = articles(spark, sf_dir).select("page_id", F.col("article").alias("url"), "html")
    return P.crawl(rows, captured.select("url", "html")).select("page_id", "article_url", "status", "name", "email")


@query(
    f"{PEOPLE} SELECT page_id, {STATUS} AS status, CASE WHEN {STATUS} = 'success' THEN {TWITTER} END AS twitter, CASE WHEN {STATUS} = 'success' THEN CASE seg WHEN 'AUTOMOBILE' THEN who || '|' || url || '|' || slug || '@press.org;' || who || '|' || url || '|' || slug || '@press.org;' || place || '|https://blog.press.org/' || slug || '|'"
    " ELSE who || '|' || url || '|' || slug || '@press.org;' || place || '||;' || org || '||' END END AS authors FROM people"
)
def j1_j2_f18_p2_crawl(spark, sf_dir):
    """Several authors of an article: the chosen one stands for the first; others have their own page's record where there is one, else what the article says."""
    captured = author_pages(spark, sf_dir).join(people(spark, sf_dir).where(CAPTURED).select("page_id"), "page_id", "left_semi").select("url", "html")
    rows = articles(spark, sf_dir).select("page_id", F.regexp_replace("article", "^https://", "").alias("url"), "html")
    out = P.crawl(rows, captured.unionByName(captured))
    line = F.transform("authors", lambda a: F.concat_ws("|", F.coalesce(a["name"], F.lit("")), F.coalesce(a["profile_url"], F.lit("")), F.coalesce(a["email"], F.lit(""))))
    return out.select("page_id", "status", "twitter", F.array_join(line, ";").alias("authors"))
