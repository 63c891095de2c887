"""WARC: records, files, and a Merkle fixity audit of replicas.

A page becomes a WARC/1.0 resource record. Records are ordered by page id, cut
into files of a fixed number of records, and placed by prefix sums of their
lengths. Where a replica's records lie is a manifest: page, file, offset, length
and digest of every record.

A tree is built over each manifest on its own. A leaf is the hash of a record's
offset, length and digest; a node above the leaves covers an ordered range of
``RANGE`` offsets of a file and hashes its leaves in order, with its own bounds;
a file hashes its ranges; then each node hashes up to ``FAN`` files, groups of
files and so on to the root. Replicas are compared at the root, and only below
nodes that differ is anything looked at, down to the records of a few ranges.

What is found there has a name: ``rotten`` (another record lies at the place),
``moved`` (nothing lies there, but the same bytes lie elsewhere), ``missing``,
and, for records that only the replica has, ``moved_to`` (the bytes of a moved
record) or ``extra``.

Only digests and lengths are shuffled, never pages. Records that claim the same
place with the same bytes are counted first, so a group is what fits a range of
offsets, or ``FAN`` children.

Defined results: null urls and pages are empty; pages without an id come first,
in the order of their digests; repeated rows are records each; empty manifests
are equal.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, stage

FAN, FILE_RECORDS, RANGE = 64, 1024, 1 << 16
#: The date of records whose pages have none.
NO_DATE = "1970-01-01T00:00:00Z"


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """The whole record as text (its UTF-8 bytes are the record)."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"\r\nWARC-Date: {NO_DATE}\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def digests(pages: DataFrame, *more: str) -> DataFrame:
    """(page_id, length, digest, and the columns ``more``) of every page's record: one pass, no shuffle."""
    record = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select("page_id", record.alias("record"), *more).select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *more)


def placed(records: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """Adds ``file`` and ``offset``: two-pass prefix sums over range partitions."""
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal records may lie in any order, so their row number spreads them over ranges
    order = ["page_id", "digest", "row"]
    dealt = records.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    staged = stage(dealt.withColumn("place", F.monotonically_increasing_id()), "records")
    part = F.shiftright("place", 33)
    # one row a partition
    counts = staged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    bases, total = {}, 0
    for r in counts:
        bases[r["part"]], total = total, total + r["n"]
    base = F.broadcast(spark.createDataFrame(list(bases.items()), "base_part bigint, base bigint"))  # one row a partition
    inside = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)  # a file's records
    return (
        staged.join(base, part == F.col("base_part"))
        .withColumn("ordinal", F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1))
        .withColumn("file", F.floor(F.col("ordinal") / file_records).cast("long"))
        .withColumn("offset", F.sum("length").over(inside) - F.col("length"))
        .drop("place", "base_part", "base", "ordinal")
    )


def _hashed(node: list[Column], children: Column) -> Column:
    """A node's hash: its own bounds, then its children in order."""
    return F.sha2(F.concat_ws("\n", *[n.cast("string") for n in node], F.array_join(children, "\n")), 256)


def _in_order(key: str, value: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda c: c[value])


def tree(manifest: DataFrame) -> list[DataFrame]:
    """The levels of a manifest's tree, from ranges (file, range, hash) and files (node, hash) up to the root."""
    # equal claims on a place are counted, so that they are one leaf
    leaves = manifest.groupBy("file", "offset", "length", "digest").agg(F.count("*").alias("n"))
    leaf = F.sha2(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("offset", "length", "digest", "n")]), 256)
    own = leaves.select("file", F.floor(F.col("offset") / RANGE).cast("long").alias("range"), "offset", leaf.alias("leaf"))
    ranges = own.groupBy("file", "range").agg(_in_order("offset", "leaf").alias("below")).select("file", "range", _hashed([F.col("file"), F.col("range") * RANGE, (F.col("range") + 1) * RANGE], F.col("below")).alias("hash"))
    levels = [stage(ranges, "ranges")]
    files = levels[0].groupBy("file").agg(_in_order("range", "hash").alias("below")).select(F.col("file").alias("node"), _hashed([F.col("file")], F.col("below")).alias("hash"))
    levels.append(stage(files, "files"))
    top = levels[-1].agg(F.max("node")).collect()[0][0]
    while top:
        top //= FAN
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(_in_order("node", "hash").alias("below"))
        levels.append(stage(up.select(F.col("up").alias("node"), _hashed([F.col("up")], F.col("below")).alias("hash")), "level"))
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys under which the two sides don't have the same hash."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    met = both.groupBy(*keys).agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.count_distinct("side").alias("sides"))
    return met.where("low <> high OR sides < 2").select(*[F.col(k).alias(f"bad_{k}") for k in keys])


def differing_ranges(a: list[DataFrame], b: list[DataFrame]) -> DataFrame | None:
    """(bad_file, bad_range) of the ranges at which the trees differ, found from the root down; None if the roots are equal."""
    while len(a) != len(b):  # the lower tree's root is the first child of a root as high as the other's
        low = a if len(a) < len(b) else b
        up = low[-1].groupBy(F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(_in_order("node", "hash").alias("below"))
        low.append(stage(up.select(F.col("up").alias("node"), _hashed([F.col("up")], F.col("below")).alias("hash")), "level"))
    bad = None
    for level in range(len(a) - 1, -1, -1):
        sides, keys = (a[level], b[level]), ["node"] if level else ["file", "range"]
        if bad is not None:  # only below nodes that differ
            parent = F.col("file") if not level else F.floor(F.col("node") / FAN).cast("long")
            sides = [s.join(bad, parent == F.col("bad_node"), "left_semi") for s in sides]
        bad = stage(_differing(*sides, keys), "differing")
        if bad.isEmpty():
            return None
    return bad


_PLACE = ("file", "offset", "length", "digest")


def audit(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, file, offset, length, sha256, intact, status) of every record of the archive's manifest, and of those only the replica has.

    Both are manifests: page_id, file, offset, length and digest of records.
    """
    trees = tree(archive), tree(replica)
    bad = differing_ranges(*trees)
    shown = [F.col(c) for c in ("page_id", "file", "offset", "length")] + [F.col("digest").alias("sha256")]
    if bad is None:
        forget(*trees[0], *trees[1])
        return archive.select(*shown, F.lit(True).alias("intact"), F.lit("intact").alias("status"))
    forget(*trees[0], *trees[1])

    def suspects(manifest: DataFrame) -> DataFrame:
        return manifest.join(bad, (F.col("file") == F.col("bad_file")) & (F.floor(F.col("offset") / RANGE).cast("long") == F.col("bad_range")), "left_semi")

    ours, theirs = (stage(suspects(m).select("page_id", *_PLACE), "suspects") for m in (archive, replica))
    lost = stage(ours.join(theirs.select(*_PLACE).distinct(), list(_PLACE), "left_anti"), "lost")
    # more claims on a place than the archive has are records of the replica only
    claims = lambda m, n: m.groupBy(*_PLACE).agg(F.count("*").alias(n))
    spare = claims(theirs.withColumn("page_id", F.lit(None)), "b").join(claims(ours, "a"), list(_PLACE), "left").select(*_PLACE, F.greatest(F.col("b") - F.coalesce("a", F.lit(0)), F.lit(0)).alias("spare")).where("spare > 0")
    whose = theirs.groupBy(*_PLACE).agg(F.min("page_id").alias("page_id"))
    places = lost.select(F.col("file").alias("l_file"), F.col("offset").alias("l_offset")).distinct()
    at_lost = (F.col("file") == F.col("l_file")) & (F.col("offset") == F.col("l_offset"))
    alien = stage(spare.join(whose, list(_PLACE)), "alien")
    # what lies where a record was lost is that record's rot
    taken = alien.join(places, at_lost, "left_semi").select(F.col("file").alias("t_file"), F.col("offset").alias("t_offset")).distinct()
    added = alien.join(places, at_lost, "left_anti")
    free = lost.join(taken, (F.col("file") == F.col("t_file")) & (F.col("offset") == F.col("t_offset")), "left_anti")
    digests_of = lambda m, name: m.select(F.col("digest").alias(name)).distinct()
    found = free.join(digests_of(added, "f_digest"), F.col("digest") == F.col("f_digest"), "left").select(*_PLACE, F.when(F.col("f_digest").isNotNull(), "moved").otherwise("missing").alias("why"))
    rotten = lost.join(taken, (F.col("file") == F.col("t_file")) & (F.col("offset") == F.col("t_offset")), "left_semi").select(*_PLACE, F.lit("rotten").alias("why"))
    known = stage(found.unionByName(rotten).distinct(), "known")
    moved = digests_of(known.where("why = 'moved'"), "m_digest")
    more = added.join(moved, F.col("digest") == F.col("m_digest"), "left").select("page_id", *_PLACE, "spare", F.when(F.col("m_digest").isNotNull(), "moved_to").otherwise("extra").alias("status"))
    more = more.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("spare")))).drop("copy", "spare")
    named = known.select(*[F.col(c).alias(f"k_{c}") for c in _PLACE], "why")
    same = (F.col("file") == F.col("k_file")) & (F.col("offset") == F.col("k_offset")) & (F.col("digest") == F.col("k_digest")) & (F.col("length") == F.col("k_length"))
    own = archive.join(named, same, "left").select("page_id", *_PLACE, F.coalesce("why", F.lit("intact")).alias("status"))
    return own.unionByName(more).select(*shown, (F.col("status") == "intact").alias("intact"), "status")


# --- files --------------------------------------------------------------------


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of a WARC file, plain or gzipped record by record."""
    at = 0
    while at < len(data):
        start = at
        if data[at : at + 2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            raw = z.decompress(data[at:]) + z.flush()
            at = len(data) - len(z.unused_data)
            _, _, headers, block = next(parse(raw))
        else:
            head_end = data.find(b"\r\n\r\n", at)
            if not data.startswith(b"WARC/", at) or head_end < 0:
                raise ValueError(f"no WARC record at byte {at}")
            lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
            headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(headers.get("Content-Length", 0))
            block = data[head_end + 4 : head_end + 4 + size]
            if len(block) < size:
                raise ValueError(f"the record at byte {start} is cut short")
            at = head_end + 4 + size + 4
        yield start, at - start, headers, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, uri, type, digest, block) of the WARC files under a path Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for at, n, head, block in parse(data):
                    row = [name, at, n, head.get("WARC-Target-URI"), head.get("WARC-Type"), head.get("WARC-Block-Digest"), block]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["file", "offset", "length", "uri", "type", "digest", "block"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset bigint, length bigint, uri string, type string, digest string, block binary")


def write(pages: DataFrame, uri: str, compress: bool = False) -> DataFrame:
    """One WARC file a partition, under ``uri`` (a place all executors share: file:, hdfs:, s3:); returns (file, records, bytes).

    A file gets its name when it is whole, so a task that runs again leaves no parts.
    """
    record = record_text(F.col("page_id"), F.col("url"), F.col("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(uri)
        system.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.warc" + ".gz" * compress
        part, n, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0, 0
        with system.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for text in batch.column("record").to_pylist():
                    raw = gzip.compress(text.encode(), mtime=0) if compress else text.encode()
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
        system.move(part, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return pages.select(record.alias("record")).mapInArrow(run, "file string, records bigint, bytes bigint")
