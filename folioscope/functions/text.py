"""Names, e-mail addresses and other strings as column expressions."""

from __future__ import annotations

import encodings
import encodings.aliases
import pkgutil

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dom, lists


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def plausible_email(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"\.+$", "")
    image = "(" + "|".join(s.replace(".", r"\.") for s in lists.IMAGE_SUFFIXES) + ")$"
    placeholder = "@(" + "|".join(d.replace(".", r"\.") for d in lists.PLACEHOLDER_DOMAINS) + ")$"
    return ~bare.rlike(image) & ~F.lower(bare).rlike(placeholder) & ~F.contains(bare, F.lit("/"))


def plausible_name(c: Column) -> Column:
    name = F.trim(c)
    low = F.lower(name)
    ok = F.length(name).between(1, 80) & name.rlike(r"\p{L}") & name.rlike(lists.NAME_SHAPE) & ~F.array_contains(dom.strings(lists.NOT_NAMES), low) & ~F.array_contains(dom.strings(lists.NOT_NAMES), F.substring_index(low, " ", 1))
    return F.coalesce(ok & ~low.rlike("http|@") & (F.length(name) - F.length(F.replace(name, F.lit(" "))) <= 5), F.lit(False))


def plain_emails(c: Column) -> Column:
    """Addresses as they stand, without dots around them. Looked for only where there is an at-sign."""
    found = F.transform(F.regexp_extract_all(c, F.lit(lists.EMAIL), F.lit(0)), lambda e: F.regexp_replace(e, r"^\.+|\.+$", ""))
    return F.when(F.contains(c, F.lit("@")), found).otherwise(F.expr("cast(array() as array<string>)"))


def emails(c: Column, pattern: str = lists.OBFUSCATED) -> Column:
    """Plain and obfuscated addresses, plausible ones, distinct and in order. A text is searched once for each kind, for spelt-out ones only where it has a dot's name;
    their parts are read from the few finds."""
    spelt = F.when(F.contains(F.lower(c), F.lit("dot")), F.regexp_extract_all(c, F.lit(f"(?i){lists.EDGE}{pattern}{lists.EDGE}"), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    part = lambda m, g: F.regexp_extract(m, rf"(?i)^{pattern}\z", g)
    hidden = F.transform(spelt, lambda m: F.concat(part(m, 1), F.lit("@"), part(m, 2), F.lit("."), part(m, 3)))
    return F.sort_array(F.array_distinct(F.filter(F.concat(plain_emails(c), hidden), plausible_email)))


def decode_hidden_email(code: Column) -> Column:
    """Hex whose first byte is the key of all others; null if it isn't such hex. The code is bound, so that it is worked out once, not for each of its bytes."""
    byte = lambda pair: F.conv(pair, 16, 10).cast("int")
    chars = lambda key, pairs: F.transform(pairs, lambda p, i: F.when(i > 0, F.char(byte(p).bitwiseXOR(key))))
    keyed = lambda pairs: F.transform(F.array(byte(F.get(pairs, F.lit(0)))), lambda key: F.array_join(chars(key, pairs), ""))[0]
    plain = lambda c: F.transform(F.array(F.regexp_extract_all(c, F.lit(".."), F.lit(0))), keyed)[0]
    return F.transform(F.array(code), lambda c: F.when(c.rlike("^([0-9a-fA-F]{2}){2,}$"), plain(c)))[0]


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"(?U)[^\w]+"), lambda t: F.length(t) > 2)


def email_score(email: Column, name: Column, root: Column) -> Column:
    """3 for a name's token in the local part, 1 for the site's domain, -3 for a shared mailbox."""
    local = F.lower(F.substring_index(email, "@", 1))
    named = F.coalesce(F.exists(name_tokens(name), lambda t: F.contains(local, t)), F.lit(False))
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return flag(named, 3) + flag(F.endswith(F.lower(email), root) & (root != ""), 1) - flag(local.rlike("^(" + "|".join(lists.SHARED_MAILBOXES) + ")"), 3)


def bad_chars(c: Column) -> Column:
    return c.rlike("[�￾￿]")


def retry_delay(header: Column, backoff: float, attempt: Column, most: float = 30.0) -> Column:
    return F.least(F.coalesce(header.try_cast("double"), F.lit(backoff) * F.pow(F.lit(2.0), attempt)), F.lit(most))


def charset(content_type: Column) -> Column:
    found = F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([\w.-]+)", 1)
    return F.when(found != "", F.lower(found))


def http_class(status: Column) -> Column:
    return F.when(status.isin(lists.REFUSED), "refused").when(status.isin(lists.RETRIED), "retry").otherwise("ok")


def header_label(field: str) -> str:
    return lists.HEADERS.get(field, field.replace("_", " ").title())


def csv_escape(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\n]'), quoted).otherwise(F.coalesce(c, F.lit("")))


def html_escape(c: Column) -> Column:
    """The five characters that mark-up gives a meaning; null is empty."""
    out = F.coalesce(c, F.lit(""))
    for plain, entity in lists.ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def elapsed(seconds: Column, running: Column) -> Column:
    """Rounded to hundredths, to tenths while a job runs."""
    return F.when(running, F.round(seconds, 1)).otherwise(F.round(seconds, 2))


def role_in_prose(bio: Column, name: Column) -> Column:
    """A role that a bio's sentence tells, such as "is a staff writer for": if the bio's lead has a token of the name, or opens
    with capitalised words as a name would; null where no pattern has 3 to 60 characters."""
    lead = F.lower(F.left(bio, F.lit(120)))
    named = F.coalesce(F.exists(name_tokens(name), lambda t: F.contains(lead, t)), F.lit(False))
    opening = F.lower(F.regexp_extract(F.trim(bio), r"^(?U)(\w+)\s", 1))
    opens = F.trim(bio).rlike(r"^\p{L}") & ~opening.isin(lists.BIO_STARTERS) & bio.rlike(lists.NAMED_OPENING)

    def role(pattern: str) -> Column:
        found = collapse(F.regexp_replace(F.regexp_extract(bio, pattern, 1), r"^[ \t,;.]+|[ \t,;.]+$", ""))
        return F.when(F.length(found).between(3, 60), found)

    return F.when(named | opens, F.coalesce(role(lists.ROLE_OF), role(lists.ROLE)))


def _squeezed(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def _charsets() -> list[str]:
    """Names, squeezed to letters and digits, that Python may know as a charset, but for UTF-8's, which is tried anyway. It may be too many: any is tried."""
    names = {m.name for m in pkgutil.iter_modules(encodings.__path__)} | set(encodings.aliases.aliases) | set(encodings.aliases.aliases.values())
    utf8 = {n for n, of in encodings.aliases.aliases.items() if of == "utf_8"} | {"utf_8"}
    return sorted({_squeezed(n) for n in names} - {_squeezed(n) for n in utf8})


BAD = "\ufffd\ufffe\uffff"
#: What windows-1252 has in place of the control characters of Latin-1, and the five bytes that it doesn't have.
WINDOWS = {b: bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}
MISSING = [chr(b) for b, c in WINDOWS.items() if c == "\ufffd"]


def _declared(content: pa.Array, declared: pa.Array) -> pa.Array:
    """Bytes as their declared charset reads them, or null if it doesn't read them cleanly; one row at a time."""

    def one(data: bytes | None, charset: str | None) -> str | None:
        if data is None or charset is None:
            return None
        try:
            out = data.decode(charset)
        except (LookupError, ValueError):
            return None
        if any(bad in out for bad in BAD):
            return None
        return out if out.isascii() else out.encode("utf-8", "replace").decode("utf-8")

    slices = [(content.slice(i, 64), declared.slice(i, 64)) for i in range(0, len(content), 64)]
    parts = [pa.array([one(d.as_py(), c.as_py()) for d, c in zip(ds, cs)], pa.string()) for ds, cs in slices]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def decode_bytes(content: Column, declared: Column) -> Column:
    """Bytes by the first charset that reads them cleanly: the declared one, unless it is of the Latin sort that servers declare
    by default, then UTF-8, windows-1252 and Latin-1, which reads all. Only bytes that are declared to be of a charset that Python knows and Spark doesn't go through Python."""
    said = F.lower(declared)
    asked = F.coalesce(~said.isin(lists.LATIN_CHARSETS) & F.regexp_replace(said, "[^a-z0-9]", "").isin(_charsets()), F.lit(False))
    known = F.arrow_udf(_declared, "string")(F.when(asked, content), F.when(asked, declared))
    text, latin = content.cast("string"), F.decode(content, "ISO-8859-1")
    present = {b: c for b, c in WINDOWS.items() if c != "\ufffd"}
    windows = F.translate(latin, "".join(map(chr, present)), "".join(present.values()))
    plain = F.when(F.is_valid_utf8(text) & ~text.rlike(f"[{BAD}]"), text).when(latin.rlike(f"[{''.join(MISSING)}]"), latin).otherwise(windows)
    return F.when(content.isNotNull(), F.coalesce(known, plain))
