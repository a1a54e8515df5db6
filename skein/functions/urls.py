"""URL rules: native predicates, glob patterns and a normaliser for the general case."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"


def host(url: Column) -> Column:
    """Host name in lower case, without port; NULL where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, AUTHORITY + r"([^/?#:]*)", 1)), F.lit(""))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))


def path(url: Column) -> Column:
    """Path of an absolute URL, / if it has none."""
    p = F.regexp_extract(url, AUTHORITY + r"[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def is_web(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i)https?://"), F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def _braces(pattern: str) -> list[str]:
    """All patterns that the first {a,b} group of a pattern stands for."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                inner, parts, level, last = pattern[start + 1 : i], [], 0, 0
                for j, d in enumerate(inner):
                    level += (d == "{") - (d == "}")
                    if d == "," and level == 0:
                        parts.append(inner[last:j])
                        last = j + 1
                parts.append(inner[last:])
                if len(parts) == 1:
                    continue
                return [x for p in parts for x in _braces(pattern[:start] + p + pattern[i + 1 :])]
    return [pattern]


def _segment(seg: str) -> str:
    out, i = "", 0
    while i < len(seg):
        c = seg[i]
        if c == "*":
            while i + 1 < len(seg) and seg[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in seg[i + 2 :]:
            end = seg.index("]", i + 2)
            body = seg[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "\\" and i + 1 < len(seg):
            i += 1
            out += re.escape(seg[i])
        else:
            out += re.escape(c)
        i += 1
    wild = seg[:1] in ("*", "?", "[")
    return (r"(?!\.)(?=.)" if wild else "") + out


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a path glob, for both Java and Python.

    * stays within a segment, ** as a whole segment spans any number of them, neither takes
    a leading dot; braces expand, a leading ! negates, a leading # matches nothing.
    """
    if pattern.startswith("#"):
        return "(?!)"
    negate = (len(pattern) - len(pattern.lstrip("!"))) % 2 == 1
    alternatives = []
    for p in _braces(pattern.lstrip("!")):
        parts, out = p.split("/"), ""
        for i, seg in enumerate(parts):
            last = i == len(parts) - 1
            if seg == "**":
                out += r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*/?)?" if last else r"(?:(?!\.)[^/]+/)*"
            else:
                out += _segment(seg) + ("" if last else "/")
        alternatives.append(out)
    body = "(?:" + "|".join(alternatives) + ")"
    return f"^(?!{body}$).*$" if negate else f"^{body}$"


@F.pandas_udf(T.ArrayType(T.StringType()))
def globs_to_regexes(patterns: pd.Series) -> pd.Series:
    """Element-wise glob_to_regex; NULL stays NULL. Meant for the few rows of a job table."""
    return patterns.map(lambda ps: None if ps is None else [glob_to_regex(p) for p in ps if p is not None])


def allowed_by(path_: Column, include: Column, exclude: Column) -> Column:
    """Path bounds: some include must match (none or an empty list is no bound) and no exclude may."""
    some = lambda rx: F.exists(rx, lambda r: F.rlike(path_, r))
    free = F.coalesce(F.size(include), F.lit(0)) <= 0
    return (free | F.coalesce(some(include), F.lit(False))) & ~F.coalesce(some(exclude), F.lit(False))


_SAFE_PATH = set("!$%&'()*+,-./:;=@[]\\^_|~") | set(map(chr, range(48, 58))) | set(map(chr, range(65, 91))) | set(map(chr, range(97, 123)))
_PORT = {"http": "80", "https": "443"}


def _encode(s: str, also: str = "") -> str:
    return "".join(c if c in _SAFE_PATH or c in also else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s)


def _dots(p: str) -> str:
    out: list[str] = []
    parts = p.split("/")
    for i, seg in enumerate(parts):
        low = seg.lower().replace("%2e", ".")
        if low == "..":
            if len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        elif low == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(seg)
    return "/".join(out)


def resolve(base: str | None, href: str | None) -> str | None:
    """Absolute http(s) form of href against base as a browser serialises it, fragment dropped; None if it has none."""
    if not href or not base:
        return None
    href = re.sub(r"[\t\r\n]", "", href.strip("".join(map(chr, range(33)))))
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", href)
    try:
        b = urlsplit(base)
        if not b.hostname or b.scheme.lower() not in _PORT:
            return None
        kind = scheme.group(1).lower() if scheme else b.scheme.lower()
        if kind not in _PORT:
            return None
        rest = href[scheme.end() :] if scheme else href
        rest, _, _ = rest.partition("#")
        rest, mark, query = rest.partition("?")
        rest = rest.replace("\\", "/")
        if rest.startswith("//") or (scheme and kind != b.scheme.lower()):
            authority, _, p = rest.lstrip("/").partition("/")
            p = "/" + p
        else:
            authority = b.netloc
            if rest.startswith("/"):
                p = rest
            elif rest:
                p = (b.path.rpartition("/")[0] or "") + "/" + rest
            else:
                p = b.path or "/"
                if not mark:
                    mark, query = ("?", b.query) if b.query else ("", "")
        parts = urlsplit(f"{kind}://{authority}")
        name = (parts.hostname or "").encode("idna").decode() if not (parts.hostname or "").isascii() else parts.hostname
        if not name or re.search(r"[\s<>^|%\\]", name):
            return None
        port = parts.port
        at = authority.rpartition("@")[0]
        net = (at + "@" if at else "") + (f"[{name}]" if ":" in name else name) + ("" if port is None or str(port) == _PORT[kind] else f":{port}")
        return f"{kind}://{net}{_dots(_encode(p))}" + (("?" + _encode(query, '?/`{}')) if mark and (query or mark) else "")
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)
