"""Typed edges between files: ordered candidates met with the known paths, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.paths import basename, dirname, joined
from quarrymap.functions.text import FLAGS, found, lstrip_chars

# What an import of a module may stand for, in order.
MODULE_ENDINGS = (".py", "/__init__.py", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.ts")
RUBY_ENDING, GO_ENDING = ".rb", "/main.go"
# Quoted paths in any text.
QUOTED_PATH = r"""['"]([a-zA-Z0-9_/\\.-]+\.(?:py|js|ts|json|yaml|yml|toml|md|css|html))['"]"""
# Test file names and the name of what they test ($n: a group), in order.
TEST_NAMES = (
    (r"^test_(.+)\.py$", "$1.py"),
    (r"^(.+)_test\.py$", "$1.py"),
    (r"^(.+)\.test\.(js|ts|jsx|tsx)$", "$1.$2"),
    (r"^(.+)\.spec\.(js|ts|jsx|tsx)$", "$1.$2"),
    (r"^Test(.+)\.java$", "$1.java"),
    (r"^(.+)Test\.java$", "$1.java"),
    (r"^(.+)_test\.go$", "$1.go"),
    (r"^(.+)_test\.rb$", "$1.rb"),
)
# What a README documents, in order.
README_TARGETS = ("__init__.py", "main.py", "index.js", "index.ts", "mod.rs", "lib.rs")

#: Kinds of edges in the order in which a file's are listed.
KINDS = ("imports", "references", "tests", "documents")


def _with_ending(stem: Column, ending: Column) -> Column:
    """The ending after the stem; one that starts with a slash is a file below it."""
    below = F.startswith(ending, F.lit("/")) & ((stem == "") | F.endswith(stem, F.lit("/")))
    return F.concat(stem, F.when(below, F.substring(ending, F.lit(2), F.lit(99))).otherwise(ending))


def import_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``candidates``: the paths that ``module`` may name in a file of ``folder``, best first."""
    module, rest = F.col("module"), lstrip_chars(F.col("module"), ".")
    level = F.char_length(module) - F.char_length(rest)
    up = F.split(F.col("folder"), "/")
    base = F.array_join(F.slice(up, F.lit(1), F.greatest(F.size(up) - (level - 1), F.lit(0))), "/")
    inner = F.replace(rest, F.lit("."), F.lit("/"))
    near = F.startswith(module, F.lit("."))
    relative = F.when(rest == "", base).otherwise(joined(base, inner))
    # one stem a module; the endings come in a step of their own, so that it isn't worked out for each
    rows = rows.withColumn("near", near).withColumn("stem", F.when(near, relative).otherwise(F.replace(module, F.lit("."), F.lit("/"))))
    plain = F.transform(F.array(*[F.lit(e) for e in MODULE_ENDINGS]), lambda e: _with_ending(F.col("stem"), e))
    more = F.array(module, F.concat(module, F.lit(RUBY_ENDING)), _with_ending(F.col("stem"), F.lit(GO_ENDING)))
    made = F.when(F.col("near"), plain).otherwise(F.concat(plain, more))
    return rows.withColumn("candidates", F.transform(made, lambda x: F.replace(x, F.lit("\\"), F.lit("/")))).drop("near", "stem")


def first_existing(rows: DataFrame, key: list[str], paths: DataFrame) -> DataFrame:
    """``rows`` (key columns, candidates) -> the first candidate of each key that is a known path."""
    each = rows.select(*key, F.posexplode("candidates").alias("rank", "candidate"))
    known = paths.select(F.col("path").alias("target"))
    # the least rank first: numbers aggregate by hash, and the winner is looked up again
    best = each.join(known, F.col("candidate") == F.col("target"), "left_semi").groupBy(*key).agg(F.min(F.struct("rank", "candidate")).alias("best"))
    return best.select(*key, F.col("best.candidate").alias("target"))


def import_edges(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, target, relation_type, details, pos) of code files (path, category, imports, import_sources).

    What a module names depends on the module, and on the file's folder if it is
    relative: each such pair is resolved once, however many files import it.
    """
    each = files.where("category = 'code'").select(F.col("path").alias("source"), "imports", F.posexplode("import_sources").alias("pos", "module"))
    text = F.get(F.filter("imports", lambda i: F.contains(i, F.col("module"))), F.lit(0))
    folder = F.when(F.startswith("module", F.lit(".")), dirname(F.col("source"))).otherwise(F.lit(""))
    rows = each.select("source", "pos", "module", folder.alias("folder"), F.coalesce(text, F.concat(F.lit("imports from "), F.col("module"))).alias("details"))
    known = first_existing(import_candidates(rows.select("module", "folder").distinct()), ["module", "folder"], paths)
    met = rows.join(known, ["module", "folder"]).where("target <> source")
    return met.select("source", "target", F.lit("imports").alias("relation_type"), "details", "pos")


def reference_edges(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges to files that a document links to, or whose quoted path stands in any text (path, content, references)."""
    links = F.transform(F.filter("references", lambda r: ~r.rlike("^https?://")), lambda r: lstrip_chars(r, "./"))
    quoted = F.transform(found(F.col("content"), QUOTED_PATH), lambda r: lstrip_chars(F.replace(r, F.lit("\\"), F.lit("/")), "./"))
    said = F.transform(links, lambda t: F.struct(t.alias("target"), F.concat(F.lit("references "), t).alias("details")))
    seen = F.transform(quoted, lambda t: F.struct(t.alias("target"), F.concat(F.lit("references path '"), t, F.lit("'")).alias("details")))
    each = files.select(F.col("path").alias("source"), F.posexplode(F.concat(said, seen)).alias("pos", "r")).select("source", F.col("r.target").alias("target"), F.lit("references").alias("relation_type"), F.col("r.details").alias("details"), "pos")
    return each.where("target <> source").join(paths.select(F.col("path").alias("known")), F.col("target") == F.col("known"), "left_semi")


def test_edges(files: DataFrame, paths: DataFrame) -> DataFrame:
    """An edge from each test file to what it tests."""
    path, name = F.col("path"), F.col("name")
    named = files.select(path.alias("source"), basename(path).alias("name")).where(name.rlike("|".join(FLAGS + p for p, _ in TEST_NAMES)))
    tested = F.filter(F.array(*[F.when(name.rlike(FLAGS + p), F.regexp_replace(name, FLAGS + p, t)) for p, t in TEST_NAMES]), lambda x: x.isNotNull())
    each = named.select("source", dirname(F.col("source")).alias("here"), F.posexplode(tested).alias("pattern", "tested")).withColumn("up", dirname(F.col("here")))
    here, up, target = F.col("here"), F.col("up"), F.col("tested")
    places = F.array(joined(here, target), joined(up, target), joined(up, F.concat(F.lit("src/"), target)), F.concat(F.lit("src/"), target), target)
    places = F.transform(places, lambda x: F.replace(x, F.lit("\\"), F.lit("/")))
    # the patterns a name fits, in order, each with its places
    rows = each.groupBy("source").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pattern", places.alias("places")))), lambda p: p["places"])).alias("candidates"))
    met = first_existing(rows, ["source"], paths)
    return met.select("source", "target", F.lit("tests").alias("relation_type"), F.concat(F.lit("test file for "), F.col("target")).alias("details"), F.lit(0).alias("pos"))


def document_edges(files: DataFrame, paths: DataFrame) -> DataFrame:
    """An edge from each README to the main file beside it."""
    path = F.col("path")
    here = dirname(path)
    rows = files.where(F.startswith(F.lower(basename(path)), F.lit("readme"))).select(path.alias("source"), F.array(*[joined(here, F.lit(t)) for t in README_TARGETS]).alias("candidates"))
    met = first_existing(rows, ["source"], paths)
    here = dirname(F.col("source"))
    details = F.concat(F.lit("README for "), F.when(here == "", F.lit("project root")).otherwise(here))
    return met.select("source", "target", F.lit("documents").alias("relation_type"), details.alias("details"), F.lit(0).alias("pos"))


def deduplicated(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation_type): the first listed."""
    return edges.groupBy("source", "target", "relation_type").agg(F.min(F.struct("pos", "details")).alias("first")).select("source", "target", "relation_type", F.col("first.details").alias("details"), F.col("first.pos").alias("pos"))


#: Paths that are broadcast at most.
FEW_PATHS = 10_000


def touching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges with a target (path) at either end; targets are broadcast only if a count shows that they are few."""
    ends = targets.select(F.col("path").alias("end_path")).distinct()
    few = ends.limit(FEW_PATHS + 1).count() <= FEW_PATHS
    out = edges
    for side in ("source", "target"):
        own = ends.withColumnRenamed("end_path", f"{side}_end")
        out = out.join(F.broadcast(own) if few else own, F.col(side) == F.col(f"{side}_end"), "left")
    return out.where("source_end IS NOT NULL OR target_end IS NOT NULL").drop("source_end", "target_end")


def all_edges(files: DataFrame, paths: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """All edges of analysed files (path, category, content, imports, import_sources, references), first of equals.

    With ``targets`` (path) those that touch one of them, chosen before equal edges are met.
    """
    paths = files.select("path") if paths is None else paths
    made = [f(files, paths) for f in (import_edges, reference_edges, test_edges, document_edges)]
    union = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    return deduplicated(union if targets is None else touching(union, targets))
