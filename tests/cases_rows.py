"""Queries of the scalar functions: cases in turn over the customers, or nations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text, urls
from cases import cases

cases(
    "f1_plausible_emails",
    {"e": ["u§@press.org", "u§@Example.com", "x@news.example.com", "logo§.png", "logo@2x§.PNG", "a/b@c.org", "u§@site.com."]},
    {"ok": (lambda c: text.plausible_email(c("e")), [True, False, True, False, True, False, False])},
)
cases(
    "f5_author_link_texts",
    {"t": ["View Author", "More", "  Our REPORTERS", "Home", None], "h": ["/x/§", "/AUTHORS/u§/", "/y", "/authors", "/people/§/"]},
    {"ok": (lambda c: urls.looks_like_author_link(c("t"), c("h")), [True, True, True, False, True])},
)
cases(
    "f6_tracking_params",
    {"k": ["utm_§", "UTM_Source", "hs_x", "gclid", "id§", "xutm_a", "ref"]},
    {"ok": (lambda c: urls.is_tracking(c("k")), [True, True, True, True, False, False, False])},
)
cases(
    "f9_f46_f47_texts",
    {"t": ["a <b>§</b>  c", "x�y§", "<p>\n §", "plain §", "￿"]},
    {
        "bad": (lambda c: text.bad_chars(c("t")), [False, True, False, False, True]),
        "bare": (lambda c: text.collapse(text.strip_tags(c("t"))), ["a § c", "x�y§", "§", "plain §", "￿"]),
    },
)
cases(
    "f25_crawlable_hrefs",
    {"h": ["/a/§", "#top", " javascript:x()", "MAILTO:a@b.org", "", "tel:§", "data:x", "sms:1", "?p=§", None]},
    {"ok": (lambda c: urls.crawlable(c("h")), [True, False, False, False, False, False, False, False, True, False])},
)
cases(
    "f26_f51_http_classes",
    {"status": [200, 401, 403, 451, 404, 429, 503, 408], "after": ["", "5", None, "", "1", "12", "90", "soon"], "attempt": [0, 0, 1, 2, 0, 1, 2, 3]},
    {
        "class": (lambda c: text.http_class(c("status")), ["ok", "refused", "refused", "refused", "ok", "retry", "retry", "retry"]),
        "delay": (lambda c: text.retry_delay(c("after"), 1.5, c("attempt")), [1.5, 5.0, 3.0, 6.0, 1.0, 12.0, 30.0, 12.0]),
    },
)
cases(
    "f33_article_urls",
    {"u": ["press.org/§", "http://press.org/§", "https://press.org", "//press.org/§", "ftp://press.org"]},
    {"url": (lambda c: urls.normalize_article_url(c("u")), ["https://press.org/§", "http://press.org/§", "https://press.org", "//press.org/§", "ftp://press.org"])},
)
cases(
    "e9_document_emails",
    {"t": ["osas enrr§atadotaci\u00f3n", "\u00f3u§ at press dot org\u00f1", "u§ at press dot orgs_", "\u00e9 (at) b", "u§ at a dot org.foo at b dot com"]},
    {"emails": (lambda c: F.array_join(text.emails(c("t")), ","), ["enrr§@a.aci", "u§@press.org", "", "", ".foo@b.com,u§@a.org"])},
)
cases(
    "f43_f44_written_emails",
    {"t": ["Write u§@press.org. or v@press.org", "u§ [at] press [dot] org", "u§(at)press(dot)org now", "none here", "a@example.org", "u§ AT news.press DOT org, b@c.io"]},
    {"emails": (lambda c: F.array_join(text.emails(c("t")), ","), ["u§@press.org,v@press.org", "u§@press.org", "u§@press.org", "", "", "b@c.io,u§@news.press.org"])},
)
cases(
    "f48_f49_j8_email_scores",
    {"e": ["ann§@press.org", "editor§@press.org", "doe@mail.org", "ANN.DOE@PRESS.ORG", "newsann@x.org", "bo@x.org"], "n": ["Ann Doe", "Ann Doe", "Ann Doe", "Ann Doe", "Ann Doe", "Bo Li"]},
    {
        "tokens": (lambda c: F.array_join(text.name_tokens(c("n")), " "), ["ann doe", "ann doe", "ann doe", "ann doe", "ann doe", ""]),
        "score": (lambda c: text.email_score(c("e"), c("n"), F.lit("press.org")), [4, -2, 3, 4, 0, 0]),
    },
)
cases(
    "f50_charsets",
    {"t": ["text/html; charset=UTF-8", "text/html;charset='cp1252'", "text/html", 'a; Charset="x-§"', None, "text/html; charset = utf-16"]},
    {"charset": (lambda c: text.charset(c("t")), ["utf-8", "cp1252", None, "x-§", None, "utf-16"])},
)
cases(
    "f53_html_escapes",
    {"t": ["<b>§</b>", "Tom & \"Jo\"", "it's", "§", None]},
    {"html": (lambda c: text.html_escape(c("t")), ["&lt;b&gt;§&lt;/b&gt;", "Tom &amp; &quot;Jo&quot;", "it&#39;s", "§", ""])},
)
cases(
    "f55_elapsed",
    {"s": [1.234, 10.816, 0.05, 119.96], "open": [False, False, True, True]},
    {"elapsed": (lambda c: text.elapsed(c("s"), c("open")), [1.23, 10.82, 0.1, 120.0])},
)
cases(
    "f34_origins",
    {"u": ["HTTPS://Press.org:8080/a?b", "http://u@press.org/§", "https://press.org"]},
    {"origin": (lambda c: urls.origin(c("u")), ["https://press.org:8080", "http://u@press.org", "https://press.org"])},
)
cases(
    "f36_author_keys",
    {"u": ["https://Press.org/A§//", "", None, ""], "e": ["", "U§@Press.org", None, None], "n": ["Ann", "Ann", "  Ann DOE ", " "]},
    {"key": (lambda c: urls.author_key(c("u"), c("e"), c("n")), ["https://press.org/a§", "u§@press.org", "ann doe", None])},
)
cases(
    "e3_e8_roles_in_prose",
    {
        "n": ["Ann Doe", "Ann Doe", None, None, None, "Ann Doe", "Ann Doe", "Zed Roe"],
        "b": [
            "Ann Doe is a staff writer for the Daily.", "Ann Doe is the Daily's senior health editor. She lives in Town.", "Cat Poe is an editor at the Daily.", "The Daily is a paper of record.",
            "she is a reporter.", "Doe covers the sea and ships.", "Doe is a  climate   reporter who writes on §.", "Zoë Bee is a columnist, and more.",
        ],
    },
    {"role": (lambda c: text.role_in_prose(c("b"), c("n")), ["staff writer", "senior health editor", "editor", None, None, None, "climate reporter", "columnist"])},
)
cases(
    "s13_decoded_bytes",
    {"x": ["c3a9", "e9", "efbbbf6869", "80", "fffe6100", "616263"], "d": ["utf-8", "utf-8", None, "iso-8859-1", "utf-16", "no-such"]},
    {"html": (lambda c: text.decode_bytes(F.unhex(c("x")), c("d")), ["é", "é", "﻿hi", "€", "a", "abc"])},
)
