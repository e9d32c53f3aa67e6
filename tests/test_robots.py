"""robots.txt against Python's own reader."""

from urllib.robotparser import RobotFileParser

from folioscope.operators import robots

BODY = "User-agent: a\nDisallow: /x%20y/\nAllow: /x\nDisallow: /é\nDisallow: /*.pdf\n\nUser-agent: *\nDisallow:\nDisallow: /q?a=1\n"
OTHER = "User-agent: *\nAllow: /\nDisallow: /\n"
URLS = ["https://a.org", "https://a.org/", "https://a.org/x y/1", "https://a.org/x%20y/1", "https://a.org/x+y/", "https://a.org/x", "https://a.org/é/b", "https://a.org/%C3%A9", "https://a.org/a.pdf", "https://a.org/*.pdf", "https://a.org/q?a=1#f", "https://a.org/q%3Fa=1", "https://a.org/100%/~b", "https://b.org/z", "https://c.org/z", "https://a.org/%zz", "https://a.org/a;b?c#d e"]


def test_same_as_python(spark):
    files = spark.createDataFrame([("https://a.org", 200, BODY), ("https://b.org", 200, OTHER), ("https://c.org", 500, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    pages = spark.createDataFrame([(u, "kept", "clash") for u in URLS + URLS[:2]], "url string, origin string, path string")
    for agent in ("a", "other"):
        want = {}
        for u in URLS:
            parser = RobotFileParser()
            parser.parse({"https://a.org": BODY, "https://b.org": OTHER}.get(u[:13], "").splitlines())
            want[u] = parser.can_fetch(agent, u)
        got = robots.with_robots(pages, files, agent).collect()
        assert len(got) == len(URLS) + 2 and all(r.origin == "kept" and r.path == "clash" for r in got) and {r.url: r.allowed for r in got} == want, agent


def test_odd_rows(spark):
    files = spark.createDataFrame([("https://a.org", 200, None), (None, 200, BODY)], "origin string, status int, body string")
    pages = spark.createDataFrame([(None,), ("",), ("no url",), ("https://a.org/x",)], "url string")
    assert [r.allowed for r in robots.with_robots(pages, files, "a").collect()] == [True] * 4
    assert robots.with_robots(pages.where("false"), files, "a").collect() == []
    assert robots.with_robots(pages, files.where("false"), "a").count() == 4
