"""Globs as Java regular expressions, so that rules match inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError

SPECIAL = set("\\.^$|+()[]{}*?")


def _quote(c: str) -> str:
    return f"\\{c}" if c in SPECIAL else c


def to_regex(glob: str) -> str:
    """A regular expression for the whole path: ** between separators spans folders (none, too), * and ? match any characters, separators as
    well, [..] and [!..] classes, {a,b} alternatives, and a backslash takes the next character literally."""
    out, i, n, depth = [], 0, len(glob), 0
    while i < n:
        c = glob[i]
        if c == "*":
            stars = i
            while i < n and glob[i] == "*":
                i += 1
            whole = i - stars == 2 and (stars == 0 or glob[stars - 1] == "/") and (i == n or glob[i] == "/")
            if not whole:
                out.append(".*")
            elif i == n:
                # x/** matches what is below x, not x itself; ** alone matches all
                out.append(".*")
            elif stars == 0:
                out.append("(?:/?|.*/)")
                i += 1
            else:
                out[-1:] = ["(?:/|/.*/)"]
                i += 1
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise ConfigError(f"class without an end in {glob!r}")
            body = glob[i + 1 : end]
            no = body[:1] in ("!", "^")
            body = (body[1:] if no else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' if no else ''}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(_quote(glob[i]))
        else:
            out.append(_quote(c))
        i += 1
    if depth:
        raise ConfigError(f"alternatives without an end in {glob!r}")
    return f"(?s)^{''.join(out)}$"


def matches_any(globs: list[str], *columns: Column) -> Column:
    """Whether any of the columns matches any of the globs; null counts as no match."""
    if not globs:
        return F.lit(False)
    tests = [F.coalesce(F.rlike(c, F.lit(to_regex(g))), F.lit(False)) for g in globs for c in columns]
    return reduce(lambda a, b: a | b, tests)
