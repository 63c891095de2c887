"""String expressions with Python's meaning, all of them native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``d``: only \n ends a line; ``U``: \w and \s know Unicode; ``m``: ^ and $ at lines.
FLAGS, LINE_FLAGS = "(?dU)", "(?mdU)"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_chars(x: Column, chars: str) -> Column:
    return F.regexp_replace(x, f"^[{re.escape(chars)}]+|[{re.escape(chars)}]+$", "")


def lstrip_chars(x: Column, chars: str) -> Column:
    return F.regexp_replace(x, f"^[{re.escape(chars)}]+", "")


def is_upper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


def found(x: Column, pattern: str, group: int = 1, lines: bool = False) -> Column:
    """All matches of a group, in order."""
    return F.regexp_extract_all(x, F.lit((LINE_FLAGS if lines else FLAGS) + pattern), F.lit(group))


def prefixed(items: Column, before: str = "", after: str = "") -> Column:
    if not before and not after:
        return items
    return F.transform(items, lambda i: F.concat(F.lit(before), i, F.lit(after)))


def lines(x: Column) -> Column:
    return F.split(x, "\n", -1)


def first_n(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def empty_strings() -> Column:
    return F.expr("cast(array() as array<string>)")


def truncated(x: Column, limit: Column | int, marker: Column | str) -> Column:
    """The first ``limit`` characters and a marker, where there are more."""
    limit, marker = (F.lit(v) if not isinstance(v, Column) else v for v in (limit, marker))
    return F.when(F.char_length(x) > limit, F.concat(F.substring(x, F.lit(1), limit.cast("int")), marker)).otherwise(x)


def glob(pattern: str) -> str:
    """The regular expression of a shell glob (``*`` crosses slashes)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            close = pattern.find("]", i + 1 + (pattern[i : i + 1] in ("!", "^")))
            if close < 0:
                out += r"\["
            else:
                inner = pattern[i:close].replace("\\", "\\\\").replace("[", r"\[").replace("&&", r"&\&")
                out += "[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] == "^" else inner) + "]"
                i = close + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def matches_glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob(pattern)) if re.search(r"[*?\[]", pattern) else x == pattern


