"""Exact top-k inner products by norm-bucketed retrieval.

Vectors stand for integers, floor(1024 x) of each component. All vectors are
range-partitioned by falling length and packed into buckets, so a bucket holds
vectors of nearly one length, and equal vectors in any number fill as many
buckets as they need. Buckets stay where they lie. Queries go to them in blocks
of at most ``QUERY_BYTES``, one block after the other, each sent to all tasks;
nothing but results above a query's floor is shuffled.

A block meets the buckets in waves, longest vectors first, each wave ``STEP``
times the one before. After a wave the k-th best of each query so far is its
floor (score and id), so a later wave returns about ``STEP`` times k rows a
query, whatever the number of vectors. In a bucket each query has a local cosine
threshold t = floor / (|q| max|p|): above 1 the bucket is skipped; below
``coordinate_from`` only vectors shorter than floor / |q| are cut (length
pruning), and what is left is multiplied for many queries at once; else vectors
whose unit coordinates lie outside what cosine t allows on the query's largest
coordinates go too (coordinate pruning). Products are verified as integers of
any size.

Defined results: null vectors, and vectors with a null or non-finite component,
are neither queries nor candidates; so is an empty vector and a null id. Vectors
of different widths have no product and never meet. A repeated row is a candidate
by each of its rows; the distinct vectors of a repeated query id are asked
together, and an own id never answers. Fewer candidates than k: all of them.
Scores of any size are ranked as they are; one that a 64-bit number can't hold
is shown as the nearest that it can.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, named, release, stage

SCALE, BUCKET, BUCKET_BYTES, QUERY_BYTES, STEP = 1024, 4096, 8 << 20, 32 << 20, 16
#: Buckets that a task holds one after the other, where there are enough for all tasks.
BUCKETS_A_TASK = 16
#: Slack on floating-point bounds, far above their rounding.
_SLACK = 1e-9
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """(vec_id, x, asked, width, norm) of the vectors that take part."""
    x = named(vector_col)
    ok = named(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    x = x if kind in ("float", "double") else x.cast("array<double>")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    rows = vectors.where(ok).select(named(id_col).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    return rows.withColumn("width", F.size("x")).withColumn("norm", norm)


_PACKED = "width int, n int, wide boolean, ids binary, matrix binary"


def packed(rows: DataFrame, size: int, most_bytes: int) -> DataFrame:
    """Rows in the order of their partition, of one width to a record: ``size`` of them, or what ``most_bytes`` hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(width: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(part) for part in zip(*held.pop(width)))
            wide = x.dtype == np.float64
            return pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([wide]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8" if wide else "<f4").tobytes()], pa.binary())],
                names=["width", "n", "wide", "ids", "matrix"],
            )

        for batch in batches:
            widths = np.asarray(batch.column("width"))
            for width in np.unique(widths).tolist():
                most = max(1, min(size, most_bytes // (8 * width)))
                own = batch.filter(pa.array(widths == width))
                ids, x = np.asarray(own.column("vec_id")), np.asarray(own.column("x").flatten()).reshape(-1, width)
                at = 0
                while at < len(ids):
                    had = held.setdefault(width, [])
                    room = most - sum(len(part[0]) for part in had)
                    had.append((ids[at : at + room], x[at : at + room]))
                    at += room
                    if sum(len(part[0]) for part in had) == most:
                        yield out(width)
        for width in list(held):
            yield out(width)
        release()

    return rows.select("vec_id", "x", "width").mapInArrow(run, _PACKED)


def matrix_of(width: int, wide: bool, matrix: bytes) -> np.ndarray:
    return np.frombuffer(matrix, "<f8" if wide else "<f4").reshape(-1, width).astype(np.float64)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) in float64: exact but for what overflows."""
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def _integer(x: float) -> int:
    """floor(1024 x), exactly."""
    top, bottom = x.as_integer_ratio()
    return SCALE * top // bottom


def exact_product(a: np.ndarray, b: np.ndarray) -> int:
    """The integer product of two vectors as they are stored."""
    return sum(_integer(x) * _integer(y) for x, y in zip(a.tolist(), b.tolist()))


def _sortable(score: int) -> bytes:
    """Bytes in the order of the integers."""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + raw if score >= 0 else b"\0" + bytes(255 - c for c in raw)


class Queries:
    """A block's queries of one width with the floors they have so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.q = ids, x, scaled(x)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.q**2).sum(1))
        self.most = np.abs(self.q).max(1, initial=0)
        self.floor, self.floor_id = np.full(len(ids), -np.inf), np.full(len(ids), _MOST)

    def raise_floors(self, known: dict[int, tuple[int, int, bytes | None]]) -> None:
        for i, q in enumerate(self.ids.tolist()):
            if q in known:
                score, vec_id, big = known[q]
                # never above the true floor; equal scores are told apart by id only where they are exact
                low = float(score)
                exact = low == score and abs(score) < 1 << 53 and big is None
                self.floor[i] = low if exact else -np.inf if score == _LEAST else np.nextafter(low, -np.inf)
                self.floor_id[i] = vec_id if exact else _MOST


class Bucket:
    """A bucket's vectors, longest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        p = scaled(x)
        with np.errstate(over="ignore"):
            norm = np.sqrt((p**2).sum(1))
        order = np.argsort(-norm, kind="stable")
        self.ids, self.x, self.p, self.norm = ids[order], x[order], p[order], norm[order]
        self.most = float(np.abs(p).max(initial=0))
        self._columns: dict[int, np.ndarray] = {}

    def column(self, f: int) -> np.ndarray:
        """Coordinate ``f`` of the unit vectors."""
        if f not in self._columns:
            self._columns[f] = self.p[:, f] / np.maximum(self.norm, 1e-300)
        return self._columns[f]

    def thresholds(self, qs: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(local cosine thresholds, number of vectors long enough) of every query; no vectors where the bucket is skipped."""
        top = self.norm[0]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            bounded = (qs.floor > 0) & np.isfinite(qs.norm) & np.isfinite(top)
            t = np.where(bounded, qs.floor / (qs.norm * top), 0.0)
            reach = np.where(bounded, qs.floor / qs.norm, 0.0)
        t[np.isnan(t)] = np.inf  # a floor above zero that nothing reaches
        reach[np.isnan(reach)] = np.inf
        live = np.where(bounded, np.searchsorted(-self.norm, -reach * (1 - _SLACK), side="right"), len(self.ids))
        return t, np.where(t > 1 + _SLACK, 0, live)

    def within(self, qs: Queries, i: int, t: float, live: int, focus: int) -> np.ndarray:
        """Positions whose unit coordinates allow cosine ``t`` on the query's largest coordinates."""
        unit, t = qs.q[i] / qs.norm[i], min(t, 1.0)
        keep = np.ones(live, bool)
        for f in np.argsort(-np.abs(unit))[:focus].tolist():
            middle, reach = unit[f] * t, np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - t * t)))
            # cosines from t to 1 allow the unit coordinate from the lower end to the upper
            low = middle - reach if unit[f] >= -t else -1.0
            high = middle + reach if unit[f] <= t else 1.0
            column = self.column(f)[:live]
            keep &= (column >= low - _SLACK) & (column <= high + _SLACK)
        return np.flatnonzero(keep)

    def rounding(self, qs: Queries, i: int) -> tuple[bool, float]:
        """Whether float products with a query are exact, and by how much they can be off if not."""
        width = self.p.shape[1]
        with np.errstate(over="ignore"):
            size = width * self.most * float(qs.most[i])
        return size < 2.0**53, 0.0 if size < 2.0**53 else size * width * 2.0**-50

    def chosen(self, qs: Queries, i: int, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        """(vec_ids, scores, bytes of scores that 64 bits can't hold) of the best k of the positions ``at``, given float products."""
        exact, slack = self.rounding(qs, i)
        if slack == np.inf:
            score, slack = np.full(len(at), np.inf), 0.0  # all are verified
        keep = (self.ids[at] != qs.ids[i]) & (score >= qs.floor[i] - slack)
        if exact:
            keep &= (score > qs.floor[i]) | (self.ids[at] <= qs.floor_id[i])
        at, score = at[keep], score[keep]
        if len(at) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k] - 2 * slack
            at, score = at[keep], score[keep]
        if exact:
            whole = score.astype(np.int64)
            order = np.lexsort((self.ids[at], ~whole))[:k]
            return self.ids[at[order]], whole[order], [None] * len(order)
        found = sorted((-exact_product(self.x[a], qs.x[i]), int(self.ids[a])) for a in at.tolist())[:k]
        shown = [max(_LEAST, min(_MOST, -s)) for s, _ in found]
        return np.array([v for _, v in found], np.int64), np.array(shown, np.int64), [_sortable(-s) if v in (_LEAST, _MOST) else None for (s, _), v in zip(found, shown)]

    def best(self, qs: Queries, k: int, coordinate_from: float, focus: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """(query's place, vec_ids, scores, bytes) for each query that this bucket may have something for."""
        t, live = self.thresholds(qs)
        asked = np.flatnonzero(live > 0)
        many = asked[t[asked] < coordinate_from]
        for at in range(0, len(many), 64):
            own = many[at : at + 64]
            length = int(live[own].max())
            with np.errstate(over="ignore", invalid="ignore"):
                products = self.p[:length] @ qs.q[own].T
            products[np.isnan(products)] = np.inf
            for j, i in enumerate(own.tolist()):
                near = np.flatnonzero(~(products[: live[i], j] < qs.floor[i] - self.rounding(qs, i)[1]))
                yield i, *self.chosen(qs, i, near, products[near, j], k)
        for i in asked[t[asked] >= coordinate_from].tolist():
            near = self.within(qs, i, float(t[i]), int(live[i]), focus)
            with np.errstate(over="ignore", invalid="ignore"):
                products = self.p[near] @ qs.q[i]
            products[np.isnan(products)] = np.inf
            yield i, *self.chosen(qs, i, near, products, k)


_FOUND = "query_id bigint, vec_id bigint, score bigint, big binary"


def _meeting(block, k: int, coordinate_from: float, focus: int):
    """The function that meets a task's buckets with a block of queries (a broadcast of width -> queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def reduced() -> None:
            """Of what is held the best k of each query."""
            query, ids, score, big = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((ids, ~score, query))
            if all(b is None for b in big):
                first = np.concatenate([[True], np.diff(query[order]) != 0])
                place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                order = order[place < k]
            held[:] = [(query[order], ids[order], score[order], big[order])]

        for batch in batches:
            for at in range(len(batch)):
                r = batch.slice(at, 1).to_pylist()[0]
                qs = block.value.get(r["width"])
                if qs is None:
                    continue
                bucket = Bucket(np.frombuffer(r["ids"], "<i8"), matrix_of(r["width"], r["wide"], r["matrix"]))
                for i, ids, score, big in bucket.best(qs, k, coordinate_from, focus):
                    if len(ids):
                        held.append((np.full(len(ids), qs.ids[i]), ids, score, np.array(big, object)))
                if held:
                    reduced()
        if held:
            query, ids, score, big = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64()), pa.array(big.tolist(), pa.binary())], names=["query_id", "vec_id", "score", "big"])
        release()

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("big").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def waves(parts: int) -> list[tuple[int, int]]:
    """Ranges of partitions, longest vectors first, each about ``STEP`` times the one before."""
    ends = [parts]
    while ends[-1] > 1:
        ends.append(-(-ends[-1] // STEP))
    ends = [0, *reversed(ends)]
    return list(zip(ends, ends[1:]))


def _blocks(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Record numbers in groups of at most ``QUERY_BYTES`` (a record at least)."""
    out: list[list[int]] = []
    room = 0
    for record, size in sizes:
        if not out or size > room:
            out.append([])
            room = QUERY_BYTES
        out[-1].append(record)
        room -= size
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", coordinate_from: float = 0.3, focus: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` of all other rows for each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_col, vector_col, is_query), "vectors")
    full = -(-rows.count() // BUCKET)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(full, tasks), full // BUCKETS_A_TASK)
    order = (F.col("width"), F.col("norm").desc(), F.col("vec_id"))
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))  # a row repeated without end fills many ranges
    dealt = salted.repartitionByRange(parts, *order, "salt").sortWithinPartitions(*order)
    buckets = stage(packed(dealt, BUCKET, BUCKET_BYTES).withColumn("part", F.spark_partition_id()), "buckets")
    asked = rows.where("asked").dropDuplicates(["vec_id", "x"])
    records = stage(packed(asked, BUCKET, QUERY_BYTES // 32).withColumn("record", F.monotonically_increasing_id()), "queries")
    # a few numbers for each megabyte of queries
    sizes = [(r["record"], 8 * r["n"] * r["width"]) for r in records.select("record", "n", "width").orderBy("record").collect()]
    steps = waves(buckets.agg(F.coalesce(F.max("part") + 1, F.lit(0))).collect()[0][0])
    done = []
    for own in _blocks(sizes):
        by_width: dict[int, list] = {}
        for r in records.where(F.col("record").isin(own)).collect():  # QUERY_BYTES at most
            by_width.setdefault(r["width"], []).append((np.frombuffer(r["ids"], "<i8"), matrix_of(r["width"], r["wide"], r["matrix"])))
        block = {w: Queries(*(np.concatenate(part) for part in zip(*got))) for w, got in by_width.items()}
        best = None
        for low, high in steps:
            shared = spark.sparkContext.broadcast(block)
            found = buckets.where((F.col("part") >= low) & (F.col("part") < high)).select("width", "wide", "ids", "matrix").mapInArrow(_meeting(shared, k, coordinate_from, focus), _FOUND)
            found = found if best is None else found.unionByName(best.drop("rank"))
            before, best = best, stage(_ranked(found, k), "best")
            if before is not None:
                forget(before)
            if high < steps[-1][1]:
                # one row a query of the block
                known = {r["query_id"]: (r["score"], r["vec_id"], r["big"]) for r in best.where(F.col("rank") == k).collect()}
                for qs in block.values():
                    qs.raise_floors(known)
            shared.destroy()
        if best is not None:
            done.append(best.select("query_id", "rank", "vec_id", "score"))
    forget(rows)
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
