"""Path expressions on relative paths with forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def suffix(name: Column) -> Column:
    """The last dot and what follows, if something stands on both its sides."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def joined(base: Column, path: Column) -> Column:
    """``base``/``path``; an absolute ``path`` starts anew, an empty ``base`` adds nothing."""
    return (
        F.when(F.startswith(path, F.lit("/")) | (base == ""), path)
        .when(F.endswith(base, F.lit("/")), F.concat(base, path))
        .otherwise(F.concat(base, F.lit("/"), path))
    )


def walk_key(path: Column) -> Column:
    """Sorts as a depth-first walk with sorted listings: by components, not by characters."""
    return F.split(path, "/")
