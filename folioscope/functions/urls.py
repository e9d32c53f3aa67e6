"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dom, lists


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", group), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Lower-cased, with port and user."""
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def root_domain(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(authority(url), r"^www\.", ""), ".", -2)


def same_domain(url: Column, base: Column) -> Column:
    return (authority(url) == authority(base)) | F.endswith(authority(url), F.concat(F.lit("."), authority(base)))


def is_tracking(key: Column) -> Column:
    low = F.lower(key)
    return F.array_contains(dom.strings(lists.TRACKING_PARAMS), low) | low.rlike("^(" + "|".join(lists.TRACKING_PREFIXES) + ")")


def clean_url(url: Column) -> Column:
    """Without fragment and tracking parameters; the others re-encoded, blank values kept."""
    base = F.regexp_replace(url, r"(?s)[?#].*$", "")
    pair = F.split(_part(url, 4), "&")
    kept = F.filter(pair, lambda p: (p != "") & ~is_tracking(F.try_url_decode(F.substring_index(p, "=", 1))))
    code = lambda c: F.url_encode(F.coalesce(F.try_url_decode(c), c))
    again = F.transform(kept, lambda p: F.concat(code(F.substring_index(p, "=", 1)), F.lit("="), code(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(again, "&"))).otherwise(base)


def crawlable(href: Column) -> Column:
    return F.coalesce((F.trim(href) != "") & ~F.trim(href).rlike(r"(?i)^(#|javascript:|data:|mailto:|tel:|sms:)"), F.lit(False))


def valid_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


#: Schemes whose references are resolved at all, and those among them that name a host, as the reference's library lists them.
RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]


def _merged_path(base: Column, href: Column) -> Column:
    """A path seen from a base path, without dot segments (RFC 3986, section 5.2)."""
    split = lambda p: F.split(p, "/")
    folder = split(F.regexp_replace(base, "[^/]+$", ""))
    folder = F.when(F.size(folder) > 1, F.slice(folder, 1, F.size(folder) - 1)).otherwise(folder)
    below = F.concat(F.when(base != "", folder).otherwise(F.array(F.lit(""))), split(href))
    parts = F.when(href.startswith("/"), split(href)).otherwise(F.filter(below, lambda s, i: (s != "") | (i == 0) | (i == F.size(below) - 1)))
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))
    done = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    done = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(done, F.lit(""))).otherwise(done)
    return F.regexp_replace(F.array_join(done, "/"), "^(?!/)", "/")


def joined(base: Column, href: Column) -> Column:
    """A reference seen from its base, as RFC 3986 resolves it; a reference of another scheme, or of one that isn't resolved, as it is. Null without a scheme."""
    own = scheme(href)
    kind = F.when(own != "", own).otherwise(scheme(base))
    host = F.regexp_extract(base, r"(?s)^(?:[^:/?#]+:)?(//[^/?#]*)?", 1)
    at = F.regexp_extract(href, r"(?s)^(?:[^:/?#]+:)?(//[^/?#]*)", 1)
    query, part = F.regexp_extract(href, r"(?s)^[^?#]*(\?[^#]+)", 1), F.regexp_extract(href, r"(?s)^[^#]*(#.+)$", 1)
    given = path(href)
    here = F.concat(kind, F.lit(":"), host, F.when(given != "", _merged_path(path(base), given)).otherwise(path(base)), F.when((given == "") & (query == ""), F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]+)", 1)).otherwise(query), part)
    there = F.concat(kind, F.lit(":"), at, given, query, part)
    out = F.when((own != "") & (own != scheme(base)) | ~kind.isin(RELATIVE), href).when(at.rlike("^//."), there).otherwise(here)
    return F.when(kind != "", out)


def resolve_url(base: Column, href: Column) -> Column:
    """Where a link leads, cleaned; null if it can't be followed."""
    return F.when(crawlable(href), clean_url(joined(F.coalesce(base, F.lit("")), F.trim(href))))


def absolute(base: Column, url: Column) -> Column:
    """A cleaned URL that names its host, as it stands or with the base's scheme; null for all others. Without a pass through Python."""
    full = F.when(url.startswith("//"), F.concat(scheme(base), F.lit(":"), url)).when((scheme(url) != "") & (authority(url) != ""), url)
    return F.when(crawlable(url), clean_url(F.trim(full)))


def normalize_article_url(url: Column) -> Column:
    return F.when(~scheme(url).isin("http", "https") & (authority(url) == ""), F.concat(F.lit("https://"), url)).otherwise(url)


def looks_like_author_page(url: Column) -> Column:
    return path(url).rlike("(?i)/(" + "|".join(lists.AUTHOR_PATHS) + ")/") | authority(url).rlike("^(" + "|".join(h.replace(".", r"\.") for h in lists.AUTHOR_HOSTS) + ")")


def looks_like_author_link(label: Column, href: Column) -> Column:
    """By the link's path, or by words of its label."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.lower(F.coalesce(href, F.lit(""))).rlike("/(" + "|".join(lists.AUTHOR_PATHS) + ")/") | F.exists(dom.strings(lists.AUTHOR_LINK_WORDS), lambda w: F.contains(low, w))


def host_suffixes(host: Column) -> Column:
    """A host and all above it, the longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


#: Rows of a platform table that are broadcast at most; a longer one is joined by a shuffle.
BROADCAST = 100_000


def with_platform(rows: DataFrame, url: str, platforms: DataFrame) -> DataFrame:
    """Rows with `platform`: that of platforms(host, platform) whose host is the URL's or the nearest above it, of any number of labels; null without one, and
    for LinkedIn's pages other than profiles. Each distinct host meets the table once. A column of that name is replaced."""
    kept = [c for c in rows.columns if c != "platform"]
    keyed = rows.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(authority(F.col(url)), F.lit("")).alias("_host"))
    listed = platforms.groupBy(F.col("host").alias("_suffix")).agg(F.min("platform").alias("_platform"))
    above = keyed.select("_host").distinct().select("_host", F.posexplode(host_suffixes(F.col("_host"))).alias("_i", "_suffix"))
    small = listed.limit(BROADCAST + 1).count() <= BROADCAST
    found = above.join(F.broadcast(listed) if small else listed, "_suffix").groupBy("_host").agg(F.min_by("_platform", "_i").alias("_platform"))
    out = keyed.join(found, "_host", "left")
    profile = (F.col("_platform") != "linkedin") | (F.col("_host") == "lnkd.in") | path(F.col(url)).rlike("(?i)^/(in|pub)/")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.when(profile, F.col("_platform")).alias("platform"))


def platform_table(spark: SparkSession) -> DataFrame:
    """The known platforms' hosts."""
    return spark.createDataFrame([(h, platform) for platform, hosts in [*lists.SOCIAL_HOSTS.items(), ("linkedin", ["linkedin.com", "lnkd.in"])] for h in hosts], "host string, platform string")


def classify_social(url: Column) -> Column:
    """The platform whose host is the URL's host or above it; LinkedIn only for profiles. Hosts have two labels each, so that the URL's
    last two labels look them up."""
    host = authority(url)
    known = F.expr("map(" + ", ".join(f"'{h}', '{platform}'" for platform, hosts in lists.SOCIAL_HOSTS.items() for h in hosts) + ")")
    last = F.substring_index(host, ".", -2)
    profile = F.when(path(url).rlike("(?i)^/(in|pub)/"), F.lit("linkedin"))
    return F.when(last == "linkedin.com", profile).when(last == "lnkd.in", F.lit("linkedin")).otherwise(F.try_element_at(known, last))


def author_key(profile_url: Column, email: Column, name: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(F.lower(F.regexp_replace(profile_url, "/+$", ""))), some(F.lower(email)), some(F.lower(F.trim(name))))
