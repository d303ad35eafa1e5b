"""Glob patterns and range arithmetic as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, stop: str = "") -> str:
    """Anchored regex of a glob with `*`, `?`, `[...]` and backslash escapes; `stop` characters end a `*`."""
    if not pattern:
        raise ValueError("empty pattern")
    any_one, out, i = (f"[^{stop}]" if stop else "[\\s\\S]"), "", 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 1)
        if c == "*":
            out += any_one + "*"
        elif c == "?":
            out += any_one
        elif c == "[" and end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "^!" else body) + "]"
            i = end
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out += re.escape(c)
        i += 1
    return f"^{out}$"


#: One element of a glob: an escaped character, a class, or any one character.
_ELEMENT = r"(\\[\s\S]|\[\^?(?:\\[\s\S]|[^\]\\])+\]|[\s\S])"


def glob_regex_column(pattern: Column) -> Column:
    """The same for a pattern column, by the rules of path globs: `*` and `?` stop at a slash, `[^...]` negates, a
    backslash quotes the next character. A pattern that is no glob (an open class, a backslash at the end) matches nothing."""
    elements = F.regexp_extract_all(pattern, F.lit(_ELEMENT), F.lit(1))

    def one(e: Column) -> Column:
        quoted = F.regexp_replace(F.when(F.startswith(e, F.lit("\\")), F.substring(e, 2, 1)).otherwise(e), r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")
        inside = F.regexp_replace(F.regexp_replace(e, r"([&~])", r"\\$1"), r"(?<!^)(?<!\\)\[", r"\\[")
        return F.when(e == "*", "[^/]*").when(e == "?", "[^/]").when(F.startswith(e, F.lit("[")) & (F.length(e) > 1), inside).otherwise(quoted)

    broken = F.exists(elements, lambda e: e.isin("[", "\\"))
    return F.when(broken, "(?!)").otherwise(F.concat(F.lit("^(?:"), F.array_join(F.transform(elements, one), ""), F.lit(")\\z")))


def glob_prefix_column(pattern: Column) -> Column:
    """The literal characters that any match of a glob begins with: those before its first metacharacter."""
    return F.regexp_extract(pattern, r"^([^*?\[\\]*)", 1)


def slice_bounds(start: int, stop: int, n: Column) -> tuple[Column, Column]:
    """Inclusive, negative-from-end indexes as 0-based bounds within n elements."""
    low = F.greatest(F.lit(start) + (n if start < 0 else 0), F.lit(0))
    high = F.least(F.lit(stop) + (n if stop < 0 else 0), n - 1)
    return low, high
