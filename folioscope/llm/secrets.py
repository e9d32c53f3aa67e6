"""Secret scans: candidates by pattern, told apart by how many owners have them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key
from .bytewords import sha_hex
from .spans import Span, add_columns, base_digest, listed

KINDS = ["assign", "access", "hex", "key", "token"]
BASE = KINDS[:3]

#: The base patterns; a failing match is dropped and the search goes on after it.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: The lengths asked for stand in the pattern where that finds the same: runs are maximal.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Spans that the method adds: private key blocks, and tokens with an issuer's prefix.
KEY = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY-----)")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", re.ASCII)
#: White space as it stands in a text or, escaped, in a quoted string.
BLANK = r"(?:\s|\\[nrt])"
BLANKS = re.compile(BLANK + "+")
HEADERS = re.compile(rf"(?:{BLANK}*+[A-Za-z-]++:\x20[^\n\\]*+)*+")
LINE = re.compile(BLANK + "*+([A-Za-z0-9+/]++={0,2}+)")
LINE_END = re.compile(r"[\x20\t]*+(?:[\r\n]|\\[nr]|\Z)")
#: Shorter runs of base64 characters are a line of a key only if nothing else is on theirs.
LONG = 16


def body_end(text: str, at: int, stop: int) -> int:
    """Where a key's body without an END line ends: its lines of base64 are as wide as the first, but for the last."""
    start, at, width = at, HEADERS.match(text, at, stop).end(), 0
    while m := LINE.match(text, at, stop):
        n = len(m[1])
        if width and n > width or n < LONG and not LINE_END.match(text, m.end(), stop):
            break
        at, short, width = m.end(), n < width, n
        if short:
            break
    return at if width else start


def keys(text: str) -> list[tuple[Span, str]]:
    """Private key blocks with their body, without white space. A block ends with its END line if that comes before the next
    BEGIN line, else with its run of base64. A BEGIN line without a body is no key."""
    out = []
    for m in KEY.finditer(text):
        stop = text.find("-----BEGIN ", m.end())
        stop = stop if stop >= 0 else len(text)
        last = f"-----END {m[1]}"
        at = text.find(last, m.end(), stop)
        end, to = (at, at + len(last)) if at >= 0 else [body_end(text, m.end(), stop)] * 2
        if body := BLANKS.sub("", text[m.end() : end]):
            out.append(((m.start(), to, "key"), body))
    return out


def find(text: str) -> list[tuple[Span, str]]:
    """Spans with their secret."""
    out = [((m.start(), m.end(), "assign"), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    for kind, pattern in (("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        out += [((m.start(), m.end(), kind), m[0]) for m in pattern.finditer(text)]
    return out + keys(text)


def start():
    def row(text: str) -> tuple:
        found = find(text)
        spans = [s for s, _ in found]
        base = [s for s in spans if s[2] in BASE]
        order = sorted(found, key=lambda x: (x[0][0], KINDS.index(x[0][2]), x[0][1]))
        told = [{"span": listed([s], KINDS), "hash": sha_hex(x.encode("utf-8", "surrogatepass"))[:32]} for s, x in order]
        return (*[sum(s[2] == k for s in base) for k in BASE], base_digest(base, KINDS), listed(spans, KINDS), told)

    return row


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = 3, repositories: int = 20) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied and verdicts to documents(doc_id, text, source, ...).

    Candidate secrets' hashes are counted over the whole corpus by distinct owners and repositories. One that at least `owners`
    owners or `repositories` repositories have is a copied example; the others look live. n_live and n_copied count
    a document's distinct candidates of either sort; verdicts has live or copied for each span, like access:3:23:live, comma-joined in the order of spans. A private key's secret is its whole body without white space, its span the block. The owner is the source, the repository the document, unless other columns are named.

    Counting goes by hash, owner and repository first, so a hash that a third of all rows have is spread by repository.
    Null and empty texts have no candidates; a null owner or repository isn't counted as one; repeated rows are
    one repository and each get a row; an empty table gives none; input columns that have added names are replaced.
    """
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied", "verdicts"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in [*added, "text"]]
    scratch = Scratch(docs.sparkSession, "secrets")
    slim = docs.select(F.struct(*kept).alias("doc"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), "text", *row_key(F.col("doc_id"), F.col("text")))
    found = add_columns(slim, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<span string, hash string>>", start).drop("text")
    found = scratch.save(found)
    each = found.where(F.size("found") > 0).select("k_id", "k_text", "owner", "repository", F.explode(F.array_distinct(F.col("found.hash"))).alias("hash")).distinct()
    spread = (
        each.select("hash", "owner", "repository").distinct()
        .groupBy("hash", "owner").agg(F.count("repository").alias("r"))
        .groupBy("hash").agg(F.count("owner").alias("o"), F.sum("r").alias("r"))
    )
    copied = F.when((F.col("o") >= owners) | (F.col("r") >= repositories), 1).otherwise(0)
    sorted_out = scratch.save(spread.select("hash", copied.alias("copied")))
    told = each.select("k_id", "k_text", "hash").distinct().join(sorted_out, "hash").groupBy("k_id", "k_text").agg(F.sum("copied").alias("n_copied"), F.sum(1 - F.col("copied")).alias("n_live"), F.collect_set(F.when(F.col("copied") == 1, F.col("hash"))).alias("examples"))
    verdict = lambda s: F.concat(s["span"], F.when(F.array_contains(F.coalesce("examples", F.array().cast("array<string>")), s["hash"]), ":copied").otherwise(":live"))
    return found.join(told, ["k_id", "k_text"], "left").select("doc.*", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.array_join(F.transform("found", verdict), ",").alias("verdicts"))
