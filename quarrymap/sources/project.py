"""Project trees as DataFrames: listings, also as a Python data source, and contents.

Spark's own file listings leave out names that start with ``_`` or ``.``, which
source trees are full of. Trees are opened from the top until there are partitions
enough, so that one large folder is many tasks; excluded and
ignored directories are not entered, files beyond the size bounds not returned.
Listings don't read files: contents are a second source, asked only for what is
indexed.
"""

from __future__ import annotations

import fnmatch
import itertools
import operator
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from quarrymap.settings import Settings

IGNORE_FILE = ".gitignore"


def ignore_patterns(root: str) -> list[str]:
    """The patterns of the root's ignore file, without blanks and comments."""
    try:
        with open(os.path.join(root, IGNORE_FILE), encoding="utf-8", errors="ignore") as f:
            return [p for p in map(str.strip, f) if p and not p.startswith("#")]
    except OSError:
        return []


def path_ignored(path: str, patterns: list[str]) -> bool:
    """Whether a path, with a slash at its end if it is a directory, matches: the same dialect as ``operators.walk.ignored``."""
    parts, name = path.split("/"), path.rpartition("/")[2]

    def one(p: str) -> bool:
        if p.endswith("/"):
            return p.rstrip("/") in parts
        return any(fnmatch.fnmatchcase(x, y) for x, y in ((path, p), (name, p), *([(path, p.lstrip("/"))] if p.startswith("/") else [])))

    return any(map(one, patterns))


class _Entry(InputPartition):
    """A file or a whole tree, or the files right in a directory (``flat``)."""

    def __init__(self, name: str, flat: bool = False):
        super().__init__(name)
        self.name, self.flat = name, flat


#: Partitions that the driver looks for, level by level, before it leaves the rest to tasks.
PARTITIONS = 64
#: Files that a task returns at a time.
LISTED = 10_000
_BOUNDS = {LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge", EqualTo: "eq"}


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["path"])
        settings = Settings()
        self.excluded = set(options["excluded_dirs"].split("\n")) if "excluded_dirs" in options else set(settings.excluded_dirs)
        self.patterns = [p for p in options.get("ignore", "").split("\n") if p]
        #: (comparison, number) that sizes must stand.
        self.sizes: list[tuple[str, int]] = [("le", int(options["most_bytes"]))] if "most_bytes" in options else []

    def _names(self, relative: str) -> list[str]:
        try:
            return [f"{relative}/{n}" if relative else n for n in sorted(os.listdir(os.path.join(self.root, relative)))]
        except OSError:  # what can't be looked at isn't there
            return []

    def _enters(self, relative: str) -> bool:
        return os.path.isdir(os.path.join(self.root, relative)) and not (os.path.basename(relative) in self.excluded or path_ignored(relative + "/", self.patterns))

    def partitions(self) -> list[_Entry]:
        """Trees of about one level: directories are opened from the top until there are enough."""
        done, trees = [_Entry("", flat=True)], [n for n in self._names("") if self._enters(n)]
        while trees and len(done) + len(trees) < PARTITIONS:
            inner = [(t, [n for n in self._names(t) if self._enters(n)]) for t in trees]
            done += [_Entry(t, flat=True) for t, _ in inner]
            trees = [n for _, below in inner for n in below]
        return done + [_Entry(t) for t in trees]

    def read(self, partition: _Entry) -> Iterator[tuple]:
        if not os.path.isdir(self.root):  # else a tree that only the driver sees would be an empty one
            raise FileNotFoundError(f"not a directory where this task runs: {self.root}")
        todo = self._names(partition.name)[::-1]
        while todo:
            relative = todo.pop()
            full = os.path.join(self.root, relative)
            try:
                if os.path.isdir(full):
                    if not partition.flat and self._enters(relative):
                        todo += self._names(relative)[::-1]
                elif os.path.isfile(full):
                    size = os.stat(full).st_size
                    if all(getattr(operator, op)(size, bound) for op, bound in self.sizes):
                        yield full, relative, size
            except OSError:
                continue


class PushingReader(ListingReader):
    """A reader that takes filters, for sessions that push them to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of size_bytes are taken; Spark applies the rest."""
        for f in filters:
            if type(f) in _BOUNDS and f.attribute == ("size_bytes",) and isinstance(f.value, int):
                self.sizes.append((_BOUNDS[type(f)], f.value))
            else:
                yield f


class ProjectListing(DataSource):
    """``spark.read.format("project_files").load(root)``: (abs_path, relative_path, size_bytes)."""

    @classmethod
    def name(cls) -> str:
        return "project_files"

    def schema(self) -> str:
        return "abs_path string, relative_path string, size_bytes bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("push") == "true" else ListingReader)(self.options)


def listing(spark: SparkSession, root: str, settings: Settings = Settings(), patterns: list[str] | None = None) -> DataFrame:
    """(abs_path, relative_path, size_bytes) of a tree, a task for each of the reader's partitions.

    Spark plans a Python source in six Python processes beside the driver, about
    200 MB. So it is asked only in sessions that push filters, which need it.
    """
    options = {"path": root, "excluded_dirs": "\n".join(settings.excluded_dirs), "ignore": "\n".join(patterns or []), "most_bytes": str(settings.max_file_bytes)}
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        spark.dataSource.register(ProjectListing)
        return spark.read.format("project_files").options(**options, push="true").load()
    import pyarrow as pa

    reader = ListingReader(options)
    entries = reader.partitions()
    types = pa.schema([("abs_path", pa.string()), ("relative_path", pa.string()), ("size_bytes", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                found = reader.read(entries[i])
                while rows := list(itertools.islice(found, LISTED)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

    return spark.range(0, len(entries), 1, len(entries)).mapInArrow(run, ProjectListing({}).schema())


def with_bytes(files: DataFrame) -> DataFrame:
    """Adds ``data``: the bytes of each ``abs_path``, null where it can't be read. Arrow batches of a few files."""
    import pyarrow as pa

    names = files.columns

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 16):
                part, data = batch.slice(at, 16), []
                for path in part.column("abs_path").to_pylist():
                    try:
                        with open(path, "rb") as f:
                            data.append(f.read())
                    except OSError:
                        data.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*names, "data"])

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", data binary")


def read_now(root: str, path: str) -> str:
    """The text of a file as on disk at this moment; what can't be read says so."""
    try:
        with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError as e:
        return f"[Error reading file {path}: {e}]"


def texts_now(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of each ``path``, read where the row lies."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([read_now(root, path)], pa.string())], names=["path", "content"])

    return files.select("path").mapInArrow(run, "path string, content string")
