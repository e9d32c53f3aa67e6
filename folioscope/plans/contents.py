"""Queries of the scalar functions, page facts, sources and exports over what the tables' own columns hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom, lists, text, urls
from ..operators import pages as P
from ..operators import results as R
from ..sources import captures, shared, sinks
from ..sources import urls as sources
from .made_pages import PEOPLE, people
from .register import query, read, read_dealt


def listing(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


#: Fixed values as DuckDB reads them.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PLACEHOLDER = "@(" + "|".join(d.replace(".", r"\.") for d in lists.PLACEHOLDER_DOMAINS) + ")$"
IMAGE = "(" + "|".join(s.replace(".", r"\.") for s in lists.IMAGE_SUFFIXES) + ")$"
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def unescaped(c: str) -> str:
    """References that the pages have; a cut title may lack the semicolon."""
    for entity, plain in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{entity};?', '{plain}', 'g')"
    return c


def name_sql(c: str) -> str:
    """Whether a text may be a person's name."""
    return (
        f"(length(trim({c})) BETWEEN 1 AND 80 AND regexp_matches(trim({c}), '\\p{{L}}') AND regexp_full_match(trim({c}), '[\\p{{L}}\\p{{M}}\\p{{N}}_À-ɏ''.\\- ]+') AND lower(trim({c})) NOT IN {listing(lists.NOT_NAMES)}"
        f" AND split_part(lower(trim({c})), ' ', 1) NOT IN {listing(lists.NOT_NAMES)} AND NOT regexp_matches(lower({c}), 'http|@') AND length(trim({c})) - length(replace(trim({c}), ' ', '')) <= 5)"
    )


def strings(c: str) -> str:
    """The strings of a piece of a page: tags cut it, and no string holds a sign that a tag begins with."""
    return f"list_filter(list_transform(regexp_split_to_array({c}, '<[^>]*>'), lambda s: regexp_replace({unescaped('s')}, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> '')"


PAGE = (
    "WITH p AS (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS raw_h1, regexp_replace(regexp_replace(html, '(?s)^.*?</head>', ''), '<!--.*?-->', '', 'g') AS body, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article FROM pages), "
    f"s AS (SELECT *, trim({unescaped('raw_title')}) AS title, trim(regexp_replace({unescaped('raw_h1')}, '{SPACE}+', ' ', 'g')) AS h1, array_to_string({strings('body')}, ' ') AS said, "
    f"list_transform(regexp_extract_all(article, '<p>([^<]*)</p>', 1), lambda t: regexp_replace(array_to_string({strings('t')}, ' '), '{SPACE}+', ' ', 'g')) AS closed, "
    f"regexp_replace(array_to_string({strings('reach')}, ' '), '{SPACE}+', ' ', 'g') AS opened FROM (SELECT *, regexp_extract(article, '(?s)(<p><b>.*)$', 1) AS reach FROM p)) "
)


def page_table(spark, sf_dir) -> DataFrame:
    return read_dealt(spark, sf_dir, "pages").select("page_id", "url", "html")


@query(PAGE + "SELECT page_id, length(title) + 1 + length(said) AS n_text, title, CASE WHEN position('<p>' IN article) = position('<p><b>' IN article) THEN opened ELSE closed[1] END AS first_paragraph, 0::BIGINT AS data FROM s")
def f61_f62_f65_node_texts(spark, sf_dir):
    """Length of the page's text, title, first paragraph (unclosed ones reach to the article's end) and how many data attributes there are."""
    rows, d = dom.with_dom(page_table(spark, sf_dir)), F.col("dom")
    data = F.aggregate(F.transform(d["nodes"], lambda n: F.size(dom.data_attributes(n))), F.lit(0), lambda a, n: a + n)
    first = dom.collapse(dom.text(d, dom.first(dom.by_tag(d, "p"))))
    return rows.select("page_id", F.length(d["text"]).cast("long").alias("n_text"), d["title"].alias("title"), first.alias("first_paragraph"), data.cast("long").alias("data"))


STATE = "CASE WHEN length(said) < 200 THEN 'thin' ELSE 'ok' END"
#: Pages with a title of the table's own kind: those with loud titles are given a challenge's, those with a final point a wall's.
MARKED = "CASE WHEN upper(title) = title AND lower(title) <> title THEN 'blocked' WHEN ends_with(title, '.') THEN 'paywall' ELSE " + STATE + " END"


@query(PAGE + f"SELECT page_id, {STATE} AS state, {MARKED} AS marked FROM s")
def f10_f11_page_states(spark, sf_dir):
    """States of the pages as they are, and with a challenge or a wall written into those whose title asks for it."""
    rows = P.parsed(page_table(spark, sf_dir))
    title = F.col("page.title")
    loud = (F.upper(title) == title) & (F.lower(title) != title)
    # A challenge stands before the page: states look for it in the first characters only, and pages may be longer.
    html = F.when(loud, F.concat(F.lit('<div class="CF-chl"></div>'), "html")).when(title.endswith("."), F.regexp_replace("html", "<p>", "<p>Subscribe to continue reading. ")).otherwise(F.col("html"))
    again = P.parsed(rows.select("page_id", P.page_state(F.col("page"), F.col("html")).alias("state"), "url", html.alias("html")))
    return again.select("page_id", "state", P.page_state(F.col("page"), F.col("html")).alias("marked"))


@query(PAGE + f"SELECT page_id, {STATE} AS state, length(said) AS n_content FROM s")
def f8_f10_f11_page_states(spark, sf_dir):
    rows = dom.with_dom(page_table(spark, sf_dir))
    return rows.select("page_id", P.page_state(F.col("dom"), F.col("html")).alias("state"), F.col("dom.content").cast("long").alias("n_content"))


ROOT = r"regexp_extract(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', ''), '([^.]+\.[^.]+)$', 1)"
SHARED = "^(" + "|".join(lists.SHARED_MAILBOXES) + ")"


@query(
    PAGE + f""", f AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(article, '<[^>]*>', ' ', 'g'), '{EMAIL}'), lambda e: regexp_replace(e, '^\\.+|\\.+$', '', 'g')), lambda e: NOT regexp_matches(lower(e), '{PLACEHOLDER}') AND NOT regexp_matches(e, '{IMAGE}')))) AS mails,
CASE WHEN length(h1) BETWEEN 1 AND 79 THEN h1 END AS name, trim(regexp_extract(title, '(?i)\\bBy\\s+([A-Za-z][\\p{{L}}\\p{{M}}\\p{{N}}_''’.\\- ]{{1,70}}?)(?:\\s*[|\\-–—]\\s|$)', 1)) AS by_line, list_sort(list_filter(list_append(closed, opened), lambda t: length(t) > 50), 'DESC') AS long FROM s),
r AS (SELECT *, list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda t: length(t) > 2) AS tokens FROM f),
g AS (SELECT *, list_transform(mails, lambda e: {{'s': -((CASE WHEN len(list_filter(tokens, lambda t: contains(lower(split_part(e, '@', 1)), t))) > 0 THEN 3 ELSE 0 END) + (CASE WHEN ends_with(lower(e), {ROOT}) THEN 1 ELSE 0 END) - (CASE WHEN regexp_matches(lower(split_part(e, '@', 1)), '{SHARED}') THEN 3 ELSE 0 END)), 'e': e}}) AS ranked FROM r)
SELECT page_id, {STATE} AS state, name, left(list_sort(list_transform(long, lambda t: {{'n': -length(t), 't': t}}))[1].t, 2000) AS bio, list_sort(ranked)[1].e AS email, len(mails)::INTEGER AS n_emails, '' AS social, NULL::VARCHAR AS organization, ({name_sql('by_line')})::INTEGER AS n_candidates, CASE WHEN {name_sql('by_line')} THEN by_line END AS author FROM g"""
)
def p1_real_pages(spark, sf_dir):
    """The record, state and candidates of the pages table's own pages."""
    rows = P.candidates(P.author_fields(P.parsed(page_table(spark, sf_dir))))
    chosen = P.choose_author(F.col("found"), F.col("url"))
    return rows.select("page_id", P.page_state(F.col("page"), F.col("html")).alias("state"), "name", "bio", "email", F.size("emails").alias("n_emails"), R.social_string(F.col("social_links")).alias("social"), "organization", F.size("found").alias("n_candidates"), chosen["name"].alias("author"))


# ---- strings --------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, place::INTEGER AS place, e, NOT regexp_matches(e, '{IMAGE}') AND NOT regexp_matches(lower(e), '{PLACEHOLDER}') AS ok FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS e, generate_subscripts(regexp_extract_all(text, '{EMAIL}'), 1) - 1 AS place FROM documents)")
def f1_plausible_emails(spark, sf_dir):
    found = F.posexplode(F.regexp_extract_all("text", F.lit(lists.EMAIL), F.lit(0))).alias("place", "e")
    return read(spark, sf_dir, "documents").select("doc_id", found).select("doc_id", "place", "e", text.plausible_email(F.col("e")).alias("ok"))


LABELS = "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS label, generate_subscripts(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), 1) - 1 AS place FROM pages UNION ALL SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1), -1 FROM pages) "


@query(LABELS + f"SELECT page_id, place::INTEGER AS place, {name_sql(unescaped('label'))} AS ok FROM l")
def f2_person_names(spark, sf_dir):
    """Which labels of links and headings may be names."""
    rows = P.parsed(page_table(spark, sf_dir))
    links = rows.select("page_id", F.posexplode("page.anchors").alias("place", "a")).select("page_id", "place", F.col("a.label").alias("label"))
    heads = rows.select("page_id", F.lit(-1).alias("place"), F.col("page.h1").alias("label"))
    return links.unionByName(heads).select("page_id", "place", text.plausible_name(F.col("label")).alias("ok"))


@query("SELECT conv_id, turn, '/' || role || '/' || conv_id AS href, role = 'user' OR contains(lower(text), 'author') OR contains(lower(text), 'profile') AS ok FROM conversations WHERE NOT regexp_matches(lower(text), 'byline|contributor|reporter|journalist|columnist')")
def f5_author_link_texts(spark, sf_dir):
    """Turns as links: a role is a path, a text a label."""
    c = read(spark, sf_dir, "conversations").where(~F.lower("text").rlike("byline|contributor|reporter|journalist|columnist"))
    href = F.concat(F.lit("/"), "role", F.lit("/"), F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", href.alias("href"), urls.looks_like_author_link(F.col("text"), F.concat(href, F.lit("/"))).alias("ok"))


@query("SELECT page_id, split_part(pair, '=', 1) AS k, split_part(pair, '=', 1) LIKE 'utm%' AS ok FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS pair FROM pages) WHERE pair <> ''")
def f6_tracking_params(spark, sf_dir):
    pairs = F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("pair")
    keys = read(spark, sf_dir, "pages").select("page_id", pairs).where("pair <> ''").select("page_id", F.substring_index("pair", "=", 1).alias("k"))
    return keys.select("page_id", "k", urls.is_tracking(F.col("k")).alias("ok"))


@query(f"SELECT page_id, contains(html, chr(65533)) AS bad, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g')) AS bare FROM pages")
def f9_f46_f47_texts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.bad_chars(F.col("html")).alias("bad"), text.collapse(text.strip_tags(F.col("html"))).alias("bare"))


@query("SELECT page_id, href, href <> '' AND href NOT LIKE '#%' AS ok FROM (SELECT page_id, regexp_extract(url, '([?#].*)$', 1) AS href FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) FROM pages)")
def f25_crawlable_hrefs(spark, sf_dir):
    """The ends of the pages' URLs as links, and the links of their menus."""
    p = read(spark, sf_dir, "pages")
    ends = p.select("page_id", F.regexp_extract("url", "([?#].*)$", 1).alias("href"))
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return ends.unionByName(links).select("page_id", "href", urls.crawlable(F.col("href")).alias("ok"))


@query("SELECT p_partkey, CASE WHEN 400 + p_size IN (401, 403, 451) THEN 'refused' WHEN 400 + p_size IN (408, 425, 429) THEN 'retry' ELSE 'ok' END AS class, least(CASE p_type WHEN 'SMALL' THEN p_size::DOUBLE ELSE 1.5 * power(2, p_size % 7) END, 30.0)::DOUBLE AS delay FROM part")
def f26_f51_http_classes(spark, sf_dir):
    """A part's size as a status, its type as what the server says to wait."""
    header = F.when(F.col("p_type") == "SMALL", F.col("p_size").cast("string")).when(F.col("p_type") == "LARGE", F.col("p_name"))
    status = F.col("p_size") + 400
    return read(spark, sf_dir, "part").select("p_partkey", text.http_class(status).alias("class"), text.retry_delay(header, 1.5, F.col("p_size") % 7).alias("delay"))


@query("SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url WHEN length(html) % 2 = 0 THEN 'https://' || substr(url, 8) ELSE url END AS url FROM pages")
def f33_article_urls(spark, sf_dir):
    """Secure URLs as typed without a scheme, and half of the others."""
    bare = F.regexp_replace("url", "^https?://", "")
    typed = F.when(F.col("url").startswith("https://") | (F.length("html") % 2 == 0), bare).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", urls.normalize_article_url(typed).alias("url"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) AS origin FROM pages")
def f34_origins(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.origin(F.upper("url")).alias("origin"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'https://press.org/' || lower(c_name) WHEN 'MACHINERY' THEN lower(c_name) || '@press.org' WHEN 'FURNITURE' THEN NULL ELSE lower(c_name) END AS key FROM customer")
def f36_author_keys(spark, sf_dir):
    seg = F.col("c_mktsegment")
    url = F.when(seg == "BUILDING", F.concat(F.lit("https://Press.org/"), "c_name", F.lit("//"))).when(seg == "MACHINERY", "")
    email, name = F.when(seg == "MACHINERY", F.concat("c_name", F.lit("@Press.org"))), F.when(seg != "FURNITURE", F.concat(F.lit(" "), "c_name", F.lit(" "))).otherwise(" ")
    return read(spark, sf_dir, "customer").select("c_custkey", urls.author_key(url, email, name).alias("key"))


WORDS = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct([{WORDS[0]} || '@' || {WORDS[1]} || '.' || lower(p_type), {WORDS[1]} || p_size || '@' || lower(replace(p_brand, '#', '-')) || '.org'])), ',') AS emails FROM part")
def f43_f44_written_emails(spark, sf_dir):
    """An address spelt out and one at a sentence's end, of a part's words."""
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    written = F.concat(F.lit("Ask "), a, F.lit(" [at] "), b, F.lit(" (dot) "), F.lower("p_type"), F.lit(", or else "), b, F.col("p_size").cast("string"), F.lit("@"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(".org. Not no@example.org!"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.emails(written), ",").alias("emails"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@Press.org' AS email FROM customer")
def f45_hidden_email(spark, sf_dir):
    """Addresses coded by a key that follows the nation."""
    plain = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@Press.org"))
    key = F.col("c_nationkey") + 33
    code = F.concat(F.lpad(F.hex(key), 2, "0"), F.array_join(F.transform(F.split(plain, ""), lambda c: F.lpad(F.hex(F.ascii(c).bitwiseXOR(key)), 2, "0")), ""))
    return read_dealt(spark, sf_dir, "customer").select("c_custkey", text.decode_hidden_email(code).alias("email"))


@query(f"SELECT p_partkey, p_name AS tokens, (CASE p_type WHEN 'PROMO' THEN -3 WHEN 'SMALL' THEN 0 ELSE 3 END) + (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS score FROM (SELECT * FROM part WHERE length({WORDS[0]}) > 2 AND length({WORDS[1]}) > 2)")
def f48_f49_j8_email_scores(spark, sf_dir):
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    local = F.when(F.col("p_type") == "PROMO", "Editor7").when(F.col("p_type") == "SMALL", "x7").otherwise(F.concat(F.lit("7"), F.upper(b)))
    email = F.concat(local, F.when(F.col("p_size") % 2 == 0, "@mail.Press.org").otherwise("@else.net"))
    rows = read(spark, sf_dir, "part").where((F.length(a) > 2) & (F.length(b) > 2))
    name = F.concat(F.initcap("p_name"), F.lit(" X."))
    return rows.select("p_partkey", F.array_join(text.name_tokens(name), " ").alias("tokens"), text.email_score(email, name, F.lit("press.org")).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL ELSE lower(split_part(p_brand, '#', 1)) || '-' || p_size END AS charset FROM part")
def f50_charsets(spark, sf_dir):
    said = F.concat(F.lit("text/html; Charset = '"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("'"))
    said = F.concat(F.regexp_replace(said, r"-\d+'$", "-"), F.col("p_size").cast("string"), F.lit('"; x=1'))
    return read(spark, sf_dir, "part").select("p_partkey", text.charset(F.when(F.col("p_type") != "PROMO", said).otherwise("text/html")).alias("charset"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '''', '&#39;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents")
def f53_html_escapes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.html_escape(F.col("text")).alias("html"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN round(o_totalprice / 7.003::DOUBLE, 1) ELSE round(o_totalprice / 7.003::DOUBLE, 2) END AS elapsed FROM orders")
def f55_elapsed(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.elapsed(F.col("o_totalprice") / 7.003, F.col("o_orderstatus") == "O").alias("elapsed"))


@query(f"{PEOPLE} SELECT page_id, CASE WHEN seg = 'HOUSEHOLD' THEN NULL WHEN seg = 'BUILDING' THEN 'chief of ' || lower(seg) ELSE job END AS role FROM people")
def e3_e8_roles_in_prose(spark, sf_dir):
    """What a sentence says of a person; of a house it says nothing, and a sentence without a role has none."""
    seg = F.col("seg")
    said = F.when(seg == "HOUSEHOLD", F.col("bio")).when(seg == "BUILDING", F.concat("who", F.lit(" is "), F.regexp_replace("org", r"\d+ ", ""), F.lit("'s chief of "), F.lower("seg"), F.lit(". More.")))
    said = said.when(seg == "MACHINERY", F.concat(F.lit("Now "), "place", F.lit(" is an "), "job", F.lit(", who stays."))).otherwise(F.col("told"))
    return people(spark, sf_dir).select("page_id", text.role_in_prose(said, F.when(seg != "MACHINERY", F.col("who"))).alias("role"))


@query("SELECT page_id, html FROM pages")
def s13_decoded_bytes(spark, sf_dir):
    """Pages' bytes, in the charset that the length of the page picks, with and without what a server says of it."""
    n = F.length("html") % 4
    content = F.when(n == 0, F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    whole = F.decode(F.encode("html", "ISO-8859-1"), "ISO-8859-1") == F.col("html")
    content = F.when(whole, content).otherwise(F.encode("html", "UTF-8"))
    said = F.when(n == 1, "utf-8").when(n == 2, "iso-8859-1").when(n == 3, "no-such")
    return read_dealt(spark, sf_dir, "pages").select("page_id", text.decode_bytes(content, said).alias("html"))


# ---- URLs -----------------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' || split_part(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', 2) || '/' || length(html) || '?n=' || page_id AS resolved FROM pages")
def f31_resolve_url(spark, sf_dir):
    """A reference made of the page's own path and length, with dot segments, a tracking parameter and a fragment, seen from the page."""
    u = F.col("url")
    href = F.concat(F.lit(" ../../"), F.split_part(urls.path(u), F.lit("/"), F.lit(2)), F.lit("/./x/../"), F.length("html").cast("string"), F.lit("?utm_source=a&n="), F.col("page_id").cast("string"), F.lit("#b"))
    return read(spark, sf_dir, "pages").select("page_id", urls.resolve_url(u, href).alias("resolved"))


HOSTS = "WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), t AS (SELECT host, 'p' || length(host) AS platform FROM (SELECT DISTINCT host FROM u) WHERE length(host) % 3 = 0 UNION SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1), 'root' FROM u WHERE host LIKE '%.net' OR host LIKE 'm.%') "


@query(HOSTS + "SELECT page_id, arg_max(platform, length(t.host)) AS platform FROM u LEFT JOIN (SELECT host, min(platform) AS platform FROM t GROUP BY host) t ON u.host = t.host OR ends_with(u.host, '.' || t.host) GROUP BY page_id")
def f37_classify_social(spark, sf_dir):
    """Hosts of two to four labels as platforms, some below others: the nearest counts."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    host = p.select(urls.authority(F.col("url")).alias("host"))
    own = host.distinct().where(F.length("host") % 3 == 0).select("host", F.concat(F.lit("p"), F.length("host").cast("string")).alias("platform"))
    roots = host.where(F.col("host").endswith(".net") | F.col("host").startswith("m.")).select(F.substring_index("host", ".", -2).alias("host"), F.lit("root").alias("platform")).distinct()
    return urls.with_platform(p, "url", own.unionByName(roots)).select("page_id", "platform")


@query("SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) = 'example.com' OR regexp_extract(url, '://([^/?#]*)', 1) LIKE '%.example.com' AS same_site, contains(url, '/de/') OR starts_with(regexp_extract(url, '://([^/?#]*)', 1), 'm.') AS author_page, starts_with(url, 'https') AS valid FROM pages")
def f3_f4_url_predicates(spark, sf_dir):
    """German pages stand for authors' pages, mobile hosts for authors' hosts, secure URLs for valid ones."""
    u = F.col("url")
    made = F.regexp_replace(F.regexp_replace(u, "/de/", "/Authors/"), "://m\\.", "://staff.")
    return read(spark, sf_dir, "pages").select("page_id", urls.same_domain(u, F.lit("https://example.com/")).alias("same_site"), urls.looks_like_author_page(made).alias("author_page"), urls.valid_http(F.regexp_replace(u, "^http:", "ftp:")).alias("valid"))


# ---- sources --------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY page_id) - 1 AS ord, url FROM pages")
def s2_text_file_urls(spark, sf_dir):
    """URLs written to text files in order of the page, in several files, and read back with their lines' numbers."""
    path = shared.folder(spark, "lines")
    read(spark, sf_dir, "pages").repartitionByRange(4, "page_id").sortWithinPartitions("page_id").select(F.concat(F.lit("  "), "url", F.lit("\t")).alias("value")).write.text(path)
    return sources.from_text(spark, path)


@query(
    "WITH c AS (SELECT page_id, url, length(html) AS n FROM pages) SELECT page_id AS request, 0 AS place, CASE WHEN n % 4 < 2 THEN url END AS url, 20.0::DOUBLE AS timeout, CASE n % 4 WHEN 0 THEN (n / 1000.0)::DOUBLE ELSE 1.5 END AS delay, n % 4 <> 1 AS rendered,"
    " CASE n % 4 WHEN 2 THEN 'invalid body' WHEN 3 THEN CASE WHEN n % 8 = 3 THEN 'invalid url' ELSE 'Maximum 50 URLs per batch' END END AS error FROM c UNION ALL SELECT page_id, 1, 'https://a.org/' || n, 20.0, 1.5, false, NULL FROM c WHERE n % 4 = 1"
)
def s7_f23_f24_requests(spark, sf_dir):
    """Requests for the pages' URLs: one, two, a body that is no JSON, too many or a bad one, as a page's length has it."""
    n, u = F.length("html"), F.col("url")
    quoted = F.concat(F.lit('"'), u, F.lit('"'))
    body = F.when(n % 4 == 0, F.concat(F.lit('{"url":'), quoted, F.lit(',"delay":'), (n / 1000.0).cast("string"), F.lit("}")))
    body = body.when(n % 4 == 1, F.concat(F.lit('{"urls":['), quoted, F.lit(',"https://a.org/'), n.cast("string"), F.lit('"],"use_playwright":false}'))).when(n % 4 == 2, F.concat(F.lit("url="), u))
    body = body.when(n % 8 == 3, F.concat(F.lit('{"url":"ftp'), F.regexp_replace(u, "^https?", ""), F.lit('"}'))).otherwise(F.concat(F.lit('{"urls":['), F.array_join(F.array_repeat(quoted, 51), ","), F.lit("]}")))
    return sources.requests(read(spark, sf_dir, "pages").select(F.col("page_id").alias("request"), body.alias("value")))


@query(PAGE + "SELECT page_id, CASE length(html) % 5 WHEN 1 THEN 'blocked' WHEN 2 THEN 'retry' ELSE " + STATE + " END AS state, length(html) % 5 = 2 AS waits, CASE WHEN length(html) % 5 = 2 THEN least(page_id, 30)::DOUBLE END AS delay, html, false AS garbled FROM s")
def s8_f9_t7_fetched(spark, sf_dir):
    """The pages as answers: of some lengths refused, of some put off for as many seconds as the page's number."""
    n = F.length("html") % 5
    c = page_table(spark, sf_dir).select("page_id", "url", F.when(n == 1, 403).when(n == 2, 503).otherwise(200).alias("status_code"), F.encode("html", "utf-8").alias("content"), F.lit("text/html; charset=utf-8").alias("content_type"), F.col("page_id").cast("string").alias("retry_after"), F.lit(0).alias("attempt"))
    return P.classify_fetched(c).select("page_id", "state", F.col("delay").isNotNull().alias("waits"), "delay", "html", "garbled")


@query(PAGE + "SELECT page_id, url, CASE WHEN length(html) % 7 = 1 THEN 404 ELSE 200 END AS status_code, html, CASE length(html) % 7 WHEN 2 THEN 'x-' || page_id END AS mark, " + STATE + " AS state FROM s WHERE starts_with(url, 'https://')")
def s8_s13_captured_archives(spark, sf_dir):
    """Pages written to capture archives and read back by the start of their URL: status, headers, bytes decoded, state."""
    path, n = shared.folder(spark, "captures"), F.length("html") % 7
    headers = F.when(n == 2, F.create_map(F.lit("X-Mark"), F.concat(F.lit("x-"), F.col("page_id").cast("string")), F.lit("Page"), F.col("page_id").cast("string"))).otherwise(F.create_map(F.lit("Page"), F.col("page_id").cast("string")))
    captures.write_captures(page_table(spark, sf_dir).select("url", F.when(n == 1, 404).otherwise(200).alias("status_code"), F.lit("text/html; charset=utf-8").alias("content_type"), headers.alias("headers"), F.encode("html", "utf-8").alias("content")), path)
    found = captures.read_captures(spark, path).where(F.col("url").startswith("https://"))
    rows = P.classify_fetched(found.withColumns({"retry_after": F.lit(None).cast("string"), "attempt": F.lit(0)}))
    return rows.select(F.col("headers")["page"].cast("long").alias("page_id"), "url", "status_code", "html", F.col("headers")["x-mark"].alias("mark"), "state")


# ---- exports --------------------------------------------------------------------------------------------------------


def export_source(spark, sf_dir) -> DataFrame:
    """A result for each person; the rich have a second author, their house."""
    link = lambda platform, c: F.struct(F.lit(platform).alias("platform"), F.col(c).alias("url"))
    one = lambda name, email, job, links: F.struct(F.col(name).alias("name"), email.alias("email"), F.lit("").alias("linkedin"), F.col("slug").alias("twitter"), F.col(job).alias("job_title"), F.col("org").alias("organization"), F.lit(None).cast("string").alias("location"), links.alias("social_links"))
    mail = F.concat("slug", F.lit("@press.org"))
    several = F.array(one("who", F.lit(""), "job", F.array(link("github", "slug"))), F.when(F.col("rich"), one("org", mail, "seg", F.array(link("github", "sum"), link("x", "slug")))))
    return people(spark, sf_dir).select(
        F.col("page_id").alias("ord"), F.col("url").alias("article_url"), F.when(F.col("seg") == "BUILDING", F.array("url", "slug")).alias("article_urls"), F.lower("seg").alias("status"), F.col("who").alias("name"), F.col("url").alias("profile_url"), F.col("job").alias("job_title"),
        F.concat(F.lit('"'), "bio", F.lit('"')).alias("bio"), mail.alias("email"), F.col("slug").alias("linkedin"), F.col("sum").alias("twitter"), F.array(link("github", "slug"), link("x", "sum")).alias("social_links"), F.concat("org", F.lit(", Ltd")).alias("organization"), F.col("place").alias("location"),
        F.array_compact(several).alias("authors"),
    )


@query(
    f"""{PEOPLE} SELECT url AS "Article URL", CASE WHEN seg = 'BUILDING' THEN url || '; ' || slug ELSE url END AS "Article URLs", lower(seg) AS "Status", CASE WHEN rich THEN who || '; ' || org ELSE who END AS "Name", url AS "Profile URL", CASE WHEN rich THEN job || '; ' || seg ELSE job END AS "Job Title", '"' || bio || '"' AS "Bio",
slug || '@press.org' AS "Email", CASE WHEN rich THEN '' ELSE slug END AS "LinkedIn", CASE WHEN rich THEN slug || '; ' || slug ELSE sum END AS "Twitter / X",
CASE WHEN rich THEN 'github: ' || slug || '; github: ' || sum || '; x: ' || slug ELSE 'github: ' || slug || '; x: ' || sum END AS "Social Links", CASE WHEN rich THEN org || '; ' || org ELSE org || ', Ltd' END AS "Organization", CASE WHEN rich THEN '' ELSE place END AS "Location" FROM people"""
)
def p3_p4_p5_p8_a5_a14_k2_export(spark, sf_dir):
    return sinks.export_rows(export_source(spark, sf_dir))


@query(f"""{PEOPLE} SELECT url AS "Profile URL", who AS "Name", 'github: ' || slug AS "Social Links" FROM people""")
def p3_export_rows(spark, sf_dir):
    rows = people(spark, sf_dir).select(F.col("url").alias("profile_url"), F.col("who").alias("name"), F.array(F.struct(F.lit("github").alias("platform"), F.col("slug").alias("url"))).alias("social_links"))
    return sinks.export_rows(rows)


@query(f"""{PEOPLE} SELECT page_id AS ord, lower(seg) || ',' || who || ',' || slug || '@press.org,' || slug || ',' || sum || ',' || job || ',"' || org || ', Ltd",' || place || ',' || url || ',' || url AS line FROM people UNION ALL SELECT -1, 'status,name,email,linkedin,twitter,job_title,organization,location,profile_url,article_url' """)
def k3_csv_lines(spark, sf_dir):
    return sinks.csv_lines(export_source(spark, sf_dir))


@query(f"{PEOPLE} SELECT page_id AS job_id, url AS article_url, who AS name, CAST(CASE WHEN rich THEN 2 ELSE 1 END AS INTEGER) AS n_authors, lower(seg) AS status, round(sum::DOUBLE / 7, 2) AS elapsed FROM people")
def p7_api_shape(spark, sf_dir):
    rows = export_source(spark, sf_dir).withColumns({"job_id": F.col("ord"), "error": F.lit(None).cast("string"), "elapsed_seconds": F.col("twitter").cast("double") / 7})
    r = R.api_shape(rows)
    return r.select("job_id", "result.article_url", "result.author.name", F.size("result.authors").alias("n_authors"), "result.status", F.col("result.elapsed_seconds").alias("elapsed"))
