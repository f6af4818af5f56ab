"""Predicates of policies as columns: globs, media types, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions import paths


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression: ``*`` and ``?`` stop at a slash, ``**`` does not; classes and braces as usual."""
    out, k, braces = "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                raise ValueError(f"unclosed class in {pattern!r}")
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            k = end
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        else:
            out += re.escape(c)
        k += 1
    if braces:
        raise ValueError(f"unclosed braces in {pattern!r}")
    return "(?s)^" + out + "$"


def glob(path: Column, pattern: str) -> Column:
    """A pattern without a slash is held against the name, else against the path."""
    return (path if "/" in pattern else paths.name(path)).rlike(glob_regex(pattern))


def _matches(pattern: str):
    return lambda x: glob(x, pattern)


def under_any(path: Column, patterns: list[str]) -> Column:
    """The first pattern that a path or one of its ancestors matches; null if none."""
    places = F.concat(F.array(path), paths.ancestors(path))
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(F.exists(places, _matches(p)), F.lit(p)).otherwise(out)
    return out


def mime(value: Column, patterns: list[str]) -> Column:
    """``*``, ``type/*`` or a whole type; an unknown type matches nothing."""
    out = F.lit(False)
    for p in patterns:
        out = out | (F.lit(True) if p in ("*", "*/*") else F.lower(value).startswith(p[:-1].lower()) if p.endswith("/*") else F.lower(value) == p.lower())
    return F.coalesce(out & value.isNotNull(), F.lit(False))


def extensions(path: Column, wanted: list[str]) -> Column:
    return F.lower(paths.ext(paths.name(path))).isin([x.lower().lstrip(".") for x in wanted])


_GROUP = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


def regex(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern in Java's dialect, and the number of each named group."""
    if re.search(r"\(\?(<?[=!])", pattern) or re.search(r"\\[1-9]", pattern):
        raise ValueError("look-around and back references are not supported")
    compiled = re.compile(_GROUP.sub(r"(?P<\1>", pattern))
    return _GROUP.sub("(", pattern), dict(compiled.groupindex)
