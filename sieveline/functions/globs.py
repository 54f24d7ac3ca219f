"""Path globs: * and ? cross /, [...] and [!...] are classes, ** stands alone between slashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class InvalidGlob(ValueError):
    pass


def to_regex(glob: str) -> str:
    """A pattern that means the same in Java, Python and RE2, for a search in the whole path."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            if j - i > 2 or j - i == 2 and not ((i == 0 or glob[i - 1] == "/") and (j == len(glob) or glob[j] == "/")):
                raise InvalidGlob(f"** must be a whole component: {glob!r}")
            if j - i == 2 and j < len(glob):
                out += "(?:.*/)?"
                j += 1
            else:
                out += ".*"
            i = j
            continue
        if c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 3 if glob[i + 1 : i + 2] == "!" else i + 2)
            if end < 0:
                raise InvalidGlob(f"unclosed [ in {glob!r}")
            body = glob[i + 1 : end]
            negated = body.startswith("!")
            body = body[1:] if negated else body
            out += "[" + ("^" if negated else "") + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]"
            i = end
        else:
            out += re.escape(c) if not c.isalnum() and c not in "_/-" else c
        i += 1
    return rf"(?s)^(?:{out})$"


def matches(path: Column, globs: list[str]) -> Column:
    """Whether the path matches one of the globs."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(to_regex(g).replace("$", r"\z") if g else r"^\z")
    return hit


def admitted(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Any include glob, if there is one, and no exclude glob."""
    ok = matches(path, list(include)) if include else F.lit(True)
    return ok & ~matches(path, list(exclude)) if exclude else ok
