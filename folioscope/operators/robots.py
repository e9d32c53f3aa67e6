"""robots.txt: rules of one agent as a relation, and URLs told apart by it."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

#: Parts that an origin's URLs are dealt to, so that one origin with most of them is no single task's; rules are repeated as often.
PARTS = 16


class _Rules:
    def eval(self, body: str, agent: str) -> Iterator[tuple[int, bool, str]]:
        parser = RobotFileParser()
        parser.parse((body or "").splitlines())
        group = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
        for place, rule in enumerate(group.rulelines if group else []):
            yield place, bool(rule.allowance), rule.path


def rules(files: DataFrame, agent: str) -> DataFrame:
    """(origin, place, allow, prefix) of files(origin, body): the rules, in order, of the first group that names the agent, else of the group for all."""
    read = F.udtf(_Rules, returnType="place int, allow boolean, prefix string")
    return files.lateralJoin(read(F.col("body").outer(), F.lit(agent))).select("origin", "place", "allow", "prefix")


def quoted_path(url: Column) -> Column:
    """Path, query and fragment as robots.txt writes them: decoded, then all but letters, digits and `_.-~/` encoded. `/` for a URL without any."""
    plain = F.try_url_decode(F.replace(F.regexp_replace(url, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))
    parts = [F.regexp_extract(plain, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", i) for i in (1, 2, 3)]
    mark = lambda sign, part: F.when(part != "", F.concat(F.lit(sign), part)).otherwise("")
    code = F.url_encode(F.concat(parts[0], mark("?", parts[1]), mark("#", parts[2])))
    for form, plain_form in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        code = F.replace(code, F.lit(form), F.lit(plain_form))
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("/"))


def with_robots(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """pages(url, ...) with allowed, by robots(origin, status, body), a file for each origin; only files got with status 200 count,
    other origins allow all. The first rule whose prefix a URL's path has decides; without one it is allowed.

    Each distinct path is cut to the lengths that its origin's prefixes have, and the pieces meet the rules by equality. URLs of one origin are dealt to PARTS
    tasks by their path. A column named allowed is replaced."""
    files = robots.where("status = 200").groupBy("origin").agg(F.min("body").alias("body"))
    relation = rules(files, agent).groupBy("origin", "prefix").agg(F.min("place").alias("place"), F.min_by("allow", "place").alias("allow"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part")
    lengths = relation.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths")).select("origin", "lengths", parts)
    keyed = pages.drop("allowed").withColumns({"_origin": F.coalesce(urls.origin(F.col("url")), F.lit("")), "_path": F.coalesce(quoted_path(F.col("url")), F.lit("/"))})
    asked = keyed.select(F.col("_origin").alias("origin"), F.col("_path").alias("path")).distinct().withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)))
    cut = asked.join(lengths, ["origin", "part"]).select("origin", "part", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    met = cut.withColumn("prefix", F.left("path", F.col("n"))).join(relation.select("*", parts), ["origin", "part", "prefix"])
    told = met.groupBy(F.col("origin").alias("_origin"), F.col("path").alias("_path")).agg(F.min_by("allow", "place").alias("_allow"))
    out = keyed.join(told, ["_origin", "_path"], "left")
    return out.withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_origin", "_path", "_allow")
