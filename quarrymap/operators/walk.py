"""Which listed files are indexed: predicates on (relative_path, size_bytes), in a walk's order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.paths import basename, suffix, walk_key
from quarrymap.functions.text import matches_glob
from quarrymap.operators.numbering import numbered
from quarrymap.settings import Settings


def ignored(path: Column, parts: Column, patterns: list[str]) -> Column:
    """Whether a path matches an ignore pattern.

    A pattern that ends with a slash names any one component; others are globs
    on the whole path or the base name, or, after a leading slash, on the path.
    """
    tests = []
    for p in patterns:
        if p.endswith("/"):
            tests.append(F.array_contains(parts, p.rstrip("/")))
            continue
        test = matches_glob(path, p) | matches_glob(F.element_at(parts, -1), p)
        tests.append(test | matches_glob(path, p.lstrip("/")) if p.startswith("/") else test)
    return reduce(Column.__or__, tests, F.lit(False))


def pruned(path: Column, patterns: list[str], settings: Settings) -> Column:
    """Whether a directory on the way to the file is excluded or ignored (as ``dir/``)."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    out = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in settings.excluded_dirs]))
    if patterns:
        ancestors = F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
        ancestors = F.when(F.size(dirs) > 0, ancestors).otherwise(F.expr("cast(array() as array<string>)"))
        # a directory's path ends with a slash, so its last component is empty
        out = out | F.exists(ancestors, lambda a: ignored(a, F.split(a, "/"), patterns))
    return out


def typed(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``file_type`` and ``category``; null where the extension is unknown. Code types win."""
    known = {e: (t, "document") for e, t in settings.document_types.items()} | {e: (t, "code") for e, t in settings.code_types.items()}
    ext = F.lower("extension")
    look = lambda i: F.element_at(F.create_map(*[F.lit(x) for e, v in known.items() for x in (e, v[i])]), ext)
    return files.withColumn("file_type", look(0)).withColumn("category", look(1))


def indexable(files: DataFrame, patterns: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """The files that are indexed, with name, extension, type and category."""
    patterns = list(patterns or []) if settings.use_ignore_file else []
    path, name = F.col("relative_path"), F.col("name")
    parts = F.split(path, "/")
    rows = files.withColumn("name", basename(path)).withColumn("extension", suffix(F.col("name")))
    rows = rows.where(F.col("size_bytes").between(1, settings.max_file_bytes)).where(~name.isin(*settings.excluded_files)).where(~pruned(path, patterns, settings))
    for g in settings.excluded_globs:
        rows = rows.where(~matches_glob(name, g))
    if patterns:
        rows = rows.where(~ignored(path, parts, patterns))
    return typed(rows, settings).where("file_type IS NOT NULL")


def in_walk_order(files: DataFrame) -> DataFrame:
    """Adds ``walk_ord``: the place of each file in a depth-first walk with sorted listings, from 0."""
    return numbered(files, [walk_key(F.col("relative_path"))], "walk_ord")


def tree_entries(files: DataFrame) -> DataFrame:
    """(parent, name, depth, is_dir) of every directory and file on the way to ``files``."""
    parts = F.split("relative_path", "/")
    each = files.select(parts.alias("parts"), F.posexplode(parts).alias("depth", "name"))
    return each.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("parent"), "name", "depth", (F.col("depth") < F.size("parts") - 1).alias("is_dir")).distinct()
