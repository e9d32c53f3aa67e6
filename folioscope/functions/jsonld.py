"""Embedded JSON-LD: blocks, their objects in order, and the fields that the author record reads. Nothing here recurses or raises."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null|NaN|-?Infinity))')
WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def sound(s: str | None) -> str | None:
    """Lone surrogates, which JSON's escapes can make, as question marks: no string column holds them."""
    return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def nested(raw: str):
    """JSON of any depth, where the standard reader gives up: values in a stack of open containers."""
    at, open_, value, told, want = 0, [], None, False, "value"
    while True:
        m = TOKEN.match(raw, at)
        if not m:
            if raw[at:].strip(" \t\n\r") or open_ or not told:
                raise ValueError("no JSON")
            return value
        at, mark, closed = m.end(), m[1], False
        if told and not open_:
            raise ValueError("more than one value")
        if mark in ("{", "["):
            if want not in ("value", "first"):
                raise ValueError("a container out of place")
            open_.append([{} if mark == "{" else [], None])
            want = "key" if mark == "{" else "first"
            continue
        if mark in ("}", "]"):
            if not open_ or isinstance(open_[-1][0], dict) != (mark == "}") or want not in (("key", "next") if mark == "}" else ("first", "next")) or want == "key" and open_[-1][0]:
                raise ValueError("an end out of place")
            value, closed = open_.pop()[0], True
        elif mark == ",":
            if want != "next":
                raise ValueError("a comma out of place")
            want = "key" if isinstance(open_[-1][0], dict) else "value"
            continue
        elif mark == ":":
            if want != "colon":
                raise ValueError("a colon out of place")
            want = "value"
            continue
        elif m[2]:
            value, at = scanstring(raw, at, True)
            if want == "key":
                open_[-1][1], want = value, "colon"
                continue
        else:
            value = WORDS[m[4]] if m[4] else float(m[3]) if re.search("[.eE]", m[3]) else int(m[3])
        if not closed and want not in ("value", "first"):
            raise ValueError("a value out of place")
        told = True
        if open_:
            box, key = open_[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            want, told = "next", False


def block(raw: str):
    """A block as it is, else without the comment marks or CDATA marks around it; None where none of these is JSON."""
    for attempt in dict.fromkeys((raw, raw.strip("/* \n\t"), raw.replace("//<![CDATA[", "").replace("//]]>", ""), raw.replace("<![CDATA[", "").replace("]]>", ""))):
        try:
            return json.loads(attempt)
        except RecursionError:
            try:
                return nested(attempt)
            except ValueError:
                continue
        except ValueError:
            continue


def objects(x) -> Iterator[dict]:
    """Every object, an outer one before those in it, in order."""
    left = [x]
    while left:
        x = left.pop()
        if isinstance(x, dict):
            yield x
            left.extend(reversed(x.values()))
        elif isinstance(x, list):
            left.extend(reversed(x))


def text_of(x) -> str | None:
    """Any value as Python writes it; None for what is too deep to be written."""
    try:
        return sound(x if isinstance(x, str) else str(x))
    except (RecursionError, ValueError):
        return None


def string(x) -> str | None:
    return sound(x.strip()) if isinstance(x, str) and x.strip() else None


def record(n: dict) -> dict:
    """The fields of one object that author pages are read by. `said` is an e-mail of any type, as text."""
    kinds, place, same, email = n.get("@type"), n.get("address"), n.get("sameAs"), n.get("email")
    place = place if isinstance(place, dict) else {}
    orgs = [n.get(k) for k in ("worksFor", "affiliation", "memberOf")]
    named = [string(o.get("name")) if isinstance(o, dict) else string(o) for o in orgs]
    whole = lambda k: sound(n[k]) if isinstance(n.get(k), str) else None
    return {
        "types": [t for t in map(text_of, kinds if isinstance(kinds, list) else [kinds] if kinds else []) if t is not None], "name": string(n.get("name")), "job": string(n.get("jobTitle")), "bio": string(n.get("description")),
        "email": string(email), "said": string(text_of(email)) if email else None, "org": next((o for o in named if o), None), "place": string(place.get("addressLocality") or place.get("addressRegion") or place.get("name")),
        "url": whole("url"), "same_as": [sound(s) for s in same if isinstance(s, str)] if isinstance(same, list) else [], "author": whole("author"),
    }


def shallow(x) -> Iterator[tuple[int, int | None, str | None, int, str]]:
    """(place, parent, key, depth, own fields as JSON) of every object, an outer one before those in it. Objects within it are left out of an object's own fields, as they
    come with its place and the key that they stand under; so all together take space in proportion to the block, however deep it nests."""
    left: list[tuple[object, int | None, str | None, int]] = [(x, None, None, 0)]
    place = 0
    while left:
        x, parent, key, depth = left.pop()
        if isinstance(x, list):
            left.extend((y, parent, key, depth) for y in reversed(x) if isinstance(y, (dict, list)))
        elif isinstance(x, dict):
            own = {sound(k): _plain(v) for k, v in x.items() if not isinstance(v, dict)}
            yield place, parent, key, depth, json.dumps(own, ensure_ascii=False)
            left.extend((v, place, sound(k), depth + 1) for k, v in reversed(x.items()) if isinstance(v, (dict, list)))
            place += 1


def _plain(v):
    """A value without objects and without what JSON has no word for; of a list its plain values."""
    if isinstance(v, list):
        return [_plain(y) for y in v if not isinstance(y, (dict, list))]
    if isinstance(v, float) and (v != v or v in (WORDS["Infinity"], WORDS["-Infinity"])):
        return None
    return sound(v) if isinstance(v, str) else v
