"""Personal data by anchor expansion."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import LOWER, UPPER
from .spans import Span, add_columns, base_digest, listed

#: Kinds in the order of listing; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "account", "identity", "address"]
BASE = KINDS[:4]
FOLD = str.maketrans(UPPER, LOWER)

LETTERS_DIGITS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
DIGITS = frozenset("0123456789")
LOCAL = LETTERS_DIGITS | frozenset("._%+-")
LABEL = LETTERS_DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
#: Schemes, and cues of identifiers with the sort of value that follows them, lower-cased; words that may stand between.
SCHEMES = ["mailto:", "tel:", "sms:", "://"]
CUES = {
    "iban": ["iban"],
    "bank": ["account", "acct", "a/c", "konto", "kontonummer", "compte", "cuenta", "sort code", "blz"],
    "routing": ["routing", "aba"],
    "swift": ["swift", "bic", "swift code"],
    "ssn": ["ssn", "social security"],
    "passport": ["passport", "reisepass", "passeport", "pasaporte"],
    "tax": ["tax id", "vat id", "vat", "ust-idnr", "tin"],
}
BETWEEN = re.compile(r"(?:[\x20\t]{0,3}(?:number|num|nummer|code|no|nr|n°|id|is|#|[:.=-])){0,4}[\x20\t]{0,3}", re.ASCII)
#: Values by sort, and the kind of span that each makes. Lengths are bounded, so a look costs the same however long a text is.
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Z0-9])", re.ASCII)
VALUES = {
    "bank": (re.compile(r"[0-9](?:[\x20-]?[0-9]){5,17}(?![0-9])", re.ASCII), "account"),
    "routing": (re.compile(r"[0-9]{9}(?![0-9])", re.ASCII), "account"),
    "swift": (re.compile(r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?![A-Za-z0-9])", re.ASCII), "account"),
    "ssn": (re.compile(r"(?!000|666|9)[0-9]{3}([\x20-]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9])", re.ASCII), "identity"),
    "passport": (re.compile(r"(?=[A-Z]{0,3}[0-9])[A-Z0-9]{6,9}(?![A-Za-z0-9])", re.ASCII), "identity"),
    "tax": (re.compile(r"(?:[A-Z]{2})?[0-9](?:[\x20-]?[0-9]){7,11}(?![0-9])", re.ASCII), "identity"),
}


def automaton():
    """Anchors: at-signs, plus signs, digits, schemes and cues; a longer cue that ends at the same place is told instead."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for word in ["@", "+", *DIGITS]:
        out.add_word(word, (word if word in "@+" else "digit", 1))
    for word in SCHEMES:
        out.add_word(word, ("scheme", len(word)))
    for sort, words in CUES.items():
        for word in words:
            out.add_word(word, (sort, len(word)))
    out.make_automaton()
    return out


def run_end(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The e-mail around the at-sign; floor: where the match before ended."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (further := run_end(text, end + 1, LABEL)) > end + 1:
        end, dots = further, dots + 1
    return (start, end) if dots else None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def numbers_from(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Digit runs joined by single dots from a run's first digit; their end."""
    out, end = [], at
    while True:
        further = run_end(text, end, DIGITS)
        out.append((end, further))
        if further + 1 >= len(text) or text[further] != "." or text[further + 1] not in DIGITS:
            return out, further
        end = further + 1


def ips_in(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Each four joined runs in turn; a part above 255 drops its four."""
    found = []
    for i in range(0, len(runs) - 3, 4):
        four = runs[i : i + 4]
        if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
            found.append((four[0][0], four[3][1], "ip"))
    return found


def card_from(text: str, at: int) -> tuple[Span | None, int]:
    """The digits from at, each after one space or hyphen at most; their end."""
    n, end, digits = len(text), at + 1, [text[at]]
    while end < n:
        c = text[end]
        if c in DIGITS:
            end += 1
        elif c in " -" and end + 1 < n and text[end + 1] in DIGITS:
            c, end = text[end + 1], end + 2
        else:
            break
        digits.append(c)
    return ((at, end, "card") if 14 <= len(digits) <= 19 and luhn("".join(digits)) else None), end


def phone_at(text: str, at: int) -> tuple[Span | None, int]:
    """A plus, a digit, one or more phone characters, a digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None, at + 1
    end = run_end(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None, at + 1
    return ((at, end, "phone") if 10 <= sum(c in DIGITS for c in text[at:end]) <= 15 else None), end


def valid_iban(body: str) -> bool:
    return len(body) >= 15 and int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def iban_at(text: str, at: int) -> Span | None:
    """An IBAN that passes its check; grouped ones may be followed by other words in capitals, which are left off."""
    if not (m := IBAN.match(text, at)):
        return None
    end = m.end()
    while end > at and not valid_iban(text[at:end].replace(" ", "")):
        end = text.rfind(" ", at, end)
    return (at, end, "account") if end > at else None


def value_after(text: str, at: int, sort: str) -> Span | None:
    """The identifier that a cue ending at a place announces: of its sort, validated where it has a check."""
    if at < len(text) and text[at] in LETTERS_DIGITS:
        return None
    at += BETWEEN.match(text[at : at + 64].translate(FOLD)).end()
    if found := iban_at(text, at):
        return found
    if sort == "iban":
        return None
    pattern, kind = VALUES[sort]
    if not (m := pattern.match(text, at)):
        return None
    if sort == "routing" and sum(w * int(d) for w, d in zip((3, 7, 1) * 3, m[0])) % 10:
        return None
    if sort == "passport" and sum(c in DIGITS for c in m[0]) < 5:
        return None
    return at, m.end(), kind


def address_at(text: str, first: int, last: int) -> Span | None:
    """mailto:, tel: and sms: with what they address; user:password@host of a URL. No look goes past the next scheme's anchor."""
    scheme = text[first:last]
    if scheme == "://":
        user = last
        while user < len(text) and text[user] not in "/?#@:" and not text[user].isspace():
            user += 1
        at = user
        while at < len(text) and text[at] not in "/?#@" and not text[at].isspace():
            at += 1
        if not last < user < at < len(text) or text[user] != ":" or text[at] != "@":
            return None
        end = run_end(text, at + 1, LOCAL)
        return (last, end, "address") if end > at + 1 else None
    if scheme == "mailto:":
        at = run_end(text, last, LOCAL)
        found = email_at(text, at, last) if at < len(text) and text[at] == "@" else None
        return (*found, "address") if found else None
    start = last + (last < len(text) and text[last] == "+")
    end = run_end(text, start, PHONE - {" "})
    while end > start and text[end - 1] not in DIGITS:
        end -= 1
    return (last, end, "address") if sum(c in DIGITS for c in text[start:end]) >= 7 else None


def folded(text: str) -> str:
    """In lower case, with as many characters: full lower case is many times as fast, and longer only for one letter."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(FOLD)


def find(text: str, anchors=None) -> list[Span]:
    """All spans, base ones as the patterns define them: leftmost, not overlapping within a kind.

    Every look starts at an anchor and ends at the next character of another sort, so work follows the text's length."""
    spans: list[Span] = []
    free = dict.fromkeys(KINDS, 0)  # where a kind may match again
    for last, (anchor, size) in (anchors or automaton()).iter(folded(text)):
        at = last + 1 - size
        if anchor == "digit":
            if at >= free["card"]:
                hit, free["card"] = card_from(text, at)
                spans += [hit] if hit else []
            if at >= free["ip"]:
                runs, free["ip"] = numbers_from(text, at)
                spans += ips_in(text, runs)
        elif anchor == "@":
            if at >= free["email"] and (hit := email_at(text, at, free["email"])):
                spans.append((*hit, "email"))
                free["email"] = hit[1]
        elif anchor == "+":
            if at >= free["phone"]:
                hit, free["phone"] = phone_at(text, at)
                spans += [hit] if hit else []
        elif anchor == "scheme":
            hit = address_at(text, at, last + 1)
        elif at == 0 or text[at - 1] not in LETTERS_DIGITS:
            hit = value_after(text, last + 1, anchor)
        else:
            hit = None
        if anchor not in ("digit", "@", "+") and hit and hit[0] >= free[hit[2]]:
            spans.append(hit)
            free[hit[2]] = hit[1]
    return spans


def start() -> Callable[[str], tuple]:
    anchors = automaton()

    def row(text: str) -> tuple:
        spans = find(text, anchors)
        base = [s for s in spans if s[2] in BASE]
        return (*[sum(s[2] == k for s in base) for k in BASE], base_digest(base, KINDS), listed(spans, KINDS))

    return row


def find_pii(docs: DataFrame) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256 and spans to documents(text, ...).

    An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and account cues; parsers expand each to its
    span and validate it. Besides the base kinds: `account` (IBANs that pass mod 97, account, routing and SWIFT numbers after a
    cue), `identity` (social security, passport and tax numbers after a cue) and `address` (targets of mailto:, tel: and sms:,
    credentials in URLs). Offsets are code points. Each task builds the automaton, so executors need not have this package.

    Null and empty texts have no spans; texts of any length are read whole; repeated rows and null ids pass through;
    an empty table gives none; input columns that have the names of the added ones are replaced.
    """
    return add_columns(docs, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", start)


def mask(text: str) -> str:
    """The text with each span replaced by its kind in brackets, overlaps as one."""
    out, at = [], 0
    for a, b, kind in sorted(find(text), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out.append(text[at:a] + f"[{kind}]")
        at = max(at, b)
    return "".join(out) + text[at:]
