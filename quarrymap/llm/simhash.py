"""SimHash near-duplicates: bit-sliced comparison inside pigeonhole blocks.

Fingerprints: the majority bits of the XXH64 of a text's word shingles. Equal
fingerprints are collapsed first (pre-aggregated), so copies cost nothing more.
Fingerprints at ``radius`` or fewer bits agree wholly on at least ``agree`` of
``radius + agree`` bit groups; each choice of ``agree`` groups is a block key, so
linked fingerprints always meet in a block (two groups are about 26 bits at
radius 3; three, 32 bits, for more than some billions of fingerprints). A block
that outgrows a tile is cut into sides by a hash; a task of its own compares the
fingerprints of a side, or those of one side with those of another.

In a tile the fingerprints stand as bit planes (one word holds a bit of 64
fingerprints). Distances of many queries to all lanes after them are counted at
once by carry-save counters over the planes. A cell (a query and 64 lanes) is
abandoned when all its lanes are over the radius, so most are given up after a
third of the planes; planes on which a tile agrees are not looked at. A tile
returns a spanning set of links, never all pairs. Components come from alternating
large-star and small-star rounds on the links, each round staged.

Defined results: a text without words (null, empty, blank) has fingerprint 0,
linked like any other; repeated rows are returned each; a row with a null doc_id
has a fingerprint and links like any other, but names no component (a component
of only such rows has a null id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, forget, map_columns, release, stage, tidy

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    n = len(hashes)
    by_byte = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    if n < 400:
        ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = np.array([fingerprint(t, shingle) for t in byte_texts(batch.column("text"))], np.uint64)
        return {"fp": pa.array(made.view(np.int64))}

    return map_columns(documents.select("doc_id", "text"), run, ["doc_id"], "fp bigint")


class Counter:
    """Carry-save counters of set bits, one for each bit position of ``shape`` words; exact up to ``radius``, then only ``over``.

    A level holds one bit of every count; a second word of the same weight waits
    until a third comes, and the three make one of the level and one of the next.
    """

    def __init__(self, radius: int, shape: int):
        self.radius = radius
        self.levels = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.waiting: list[np.ndarray | None] = [None] * len(self.levels)
        self.beyond = np.zeros(shape, np.uint64)

    def add(self, bits: np.ndarray) -> None:
        for j in range(len(self.levels)):
            if self.waiting[j] is None:
                self.waiting[j] = bits
                return
            a, b = self.levels[j], self.waiting[j]
            either = a ^ b
            self.levels[j], self.waiting[j], bits = either ^ bits, None, (a & b) | (either & bits)
        self.beyond |= bits

    def over(self) -> np.ndarray:
        """1 where the count so far is more than the radius (what waits is left out: never too many)."""
        more, same = self.beyond.copy(), ~self.beyond
        for j in reversed(range(len(self.levels))):
            if self.radius >> j & 1:
                same &= self.levels[j]
            else:
                more |= same & self.levels[j]
                same &= ~self.levels[j]
        return more

    def close(self) -> None:
        """Count what waits."""
        for j, bits in enumerate(self.waiting):
            if bits is not None:
                self.waiting[j] = None
                for level in range(j, len(self.levels)):
                    self.levels[level], bits = self.levels[level] ^ bits, self.levels[level] & bits
                self.beyond |= bits

    def keep(self, at: np.ndarray) -> None:
        self.levels = [x[at] for x in self.levels]
        self.waiting = [None if x is None else x[at] for x in self.waiting]
        self.beyond = self.beyond[at]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(bits, ceil(n / 64)) words: each bit of all fingerprints (n, words) side by side."""
    n, words = fps.shape
    width = -(-n // 64)
    bits = np.zeros((64 * words, width * 64), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


#: Planes between two looks at which cells can be abandoned, as a share of all.
CHECKS = (1 / 4, 3 / 8, 1 / 2, 3 / 4)


def near_cells(queries: np.ndarray, lanes: np.ndarray, radius: int, after: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, lane) numbers at most ``radius`` bits apart, block by block of queries.

    ``queries`` and ``lanes`` are (n, words) fingerprints. With ``after``, query i
    stands at lane ``after`` + i and is compared with the lanes after it only.
    """
    planes = bit_planes(lanes)
    n, width = len(lanes), planes.shape[1]
    whole = np.full(width, _ALL)
    if n % 64:
        whole[-1] = _ALL >> np.uint64(64 - n % 64)
    wanted = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").T.astype(np.uint64) * _ALL
    # planes on which all agree tell nothing
    telling = np.flatnonzero(((planes & whole).any(1) | wanted.any(1)) & ((~planes & whole).any(1) | (wanted != _ALL).any(1)))
    looks = {int(len(telling) * share) for share in CHECKS}
    block = max(1, 8192 // max(1, width))
    for start in range(0, len(queries), block):
        q = np.arange(start, min(start + block, len(queries)))
        first = (q + after) // 64 if after is not None else np.zeros(len(q), int)
        count = width - first
        cell_q = np.repeat(q, count)
        cell_w = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        counter = Counter(radius, len(cell_q))
        for done, b in enumerate(telling, 1):
            counter.add(planes[b][cell_w] ^ wanted[b][cell_q])
            if done in looks:
                counter.close()
                live = np.flatnonzero(~counter.over() & whole[cell_w])
                if not len(live):
                    cell_q = cell_q[:0]
                    break
                if len(live) < len(cell_q):
                    cell_q, cell_w = cell_q[live], cell_w[live]
                    counter.keep(live)
        if not len(cell_q):
            continue
        counter.close()
        near = ~counter.over() & whole[cell_w]
        cell, bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, lane = cell_q[cell], cell_w[cell] * 64 + bit
        if after is not None:
            own = lane > i + after
            i, lane = i[own], lane[own]
        yield i, lane


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Numbers of the pairs (rows of ``a`` and ``b``, (n, words) fingerprints) at most ``radius`` bits apart: 64 pairs to a word."""
    out = [np.empty(0, np.int64)]
    for start in range(0, len(a), 1 << 16):
        x = a[start : start + (1 << 16)] ^ b[start : start + (1 << 16)]
        n = len(x)
        raw = np.full((-(-n // 64) * 64, 8 * x.shape[1]), 255, np.uint8)  # what fills the last word is far off
        raw[:n] = np.ascontiguousarray(x).view(np.uint8).reshape(n, -1)
        raw = raw.reshape(-1, 64, raw.shape[1])  # cell, pair, byte
        cells, counter = np.arange(len(raw)), Counter(radius, len(raw))
        looks = {max(1, int(raw.shape[2] * share)) for share in CHECKS}
        for byte in range(raw.shape[2]):
            bits = np.unpackbits(raw[:, :, byte : byte + 1], axis=2, bitorder="little")  # cell, pair, bit
            for plane in np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little"):
                counter.add(np.ascontiguousarray(plane).view(np.uint64).ravel())
            if byte + 1 in looks:
                counter.close()
                live = np.flatnonzero(~counter.over())
                cells, raw = cells[live], raw[live]
                counter.keep(live)
                if not len(cells):
                    break
        counter.close()
        cell, bit = np.nonzero(np.unpackbits((~counter.over()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        at = cells[cell] * 64 + bit
        out.append(start + at[at < n])
    return np.concatenate(out)


def least_along(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least that is reached along the links (a, b)."""
    out = np.arange(n)
    while len(a):
        low = np.minimum(out[a], out[b])
        new = out.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == out).all():
            break
        out = new
    return out


#: Fingerprints of a tile side; blocks up to ``SMALL`` are compared many at once.
TILE, SMALL = 1024, 32


def small_block_pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the small blocks of lanes that stand side by side; ``first`` and ``size``: the block of each lane."""
    after = first + size - np.arange(len(first)) - 1
    a = np.repeat(np.arange(len(first)), after)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)


def tiles(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns ``names`` of a partition sorted by the first of them, in runs that hold whole tiles; a tile may run across batches."""
    rest: list[list[np.ndarray]] = []

    def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*parts)]

    for batch in batches:
        if not len(batch):
            continue
        now = [np.asarray(batch.column(c)) for c in names]
        cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
        if cut == 0 and (not rest or rest[-1][0][-1] == now[0][0]):
            rest.append(now)
            continue
        yield joined([*rest, [c[:cut] for c in now]])
        rest = [[c[cut:] for c in now]]
    if rest:
        yield joined(rest)


def near_in_tiles(key: np.ndarray, second: np.ndarray, lanes: np.ndarray, radius: int, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of near pairs within the tiles of a run: small tiles all at once, then each large one.

    Of a tile of two sides only pairs across them; with ``root`` only pairs of different roots.
    """
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    little = np.flatnonzero(np.repeat(size <= SMALL, size))
    if len(little):
        sizes = size[size <= SMALL]
        begins = np.cumsum(sizes) - sizes
        i, j = small_block_pairs(np.repeat(begins, sizes), np.repeat(sizes, sizes))
        two = np.repeat(np.maximum.reduceat(second[little], begins), sizes)
        wanted = (two[i] == 0) | (second[little[i]] != second[little[j]])
        i, j = little[i[wanted]], little[j[wanted]]
        if root is not None:
            wanted = root[i] != root[j]
            i, j = i[wanted], j[wanted]
        near = near_pairs(lanes[i], lanes[j], radius)
        yield i[near], j[near]
    for e, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist()):
        if root is not None and (root[e : e + n] == root[e]).all():
            continue
        left, right = (e + np.flatnonzero(second[e : e + n] == s) for s in (0, 1))
        if len(right):
            found = [(left[x], right[y]) for x, y in near_cells(lanes[left], lanes[right], radius)]
        else:
            found = [(e + x, e + y) for x, y in near_cells(lanes[e : e + n], lanes[e : e + n], radius, 0)]
        if found:
            yield tuple(np.concatenate(c) for c in zip(*found))


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (u > v) of every tile in a partition sorted by tile."""
    for key, fp, second in tiles(batches, ("tile", "fp", "second")):
        for i, j in near_in_tiles(key, second, fp.view(np.uint64)[:, None], radius):
            at, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            root = least_along(len(at), place[: len(i)], place[len(i) :])
            own = np.flatnonzero(root != np.arange(len(at)))
            a, b = fp[at[own]], fp[at[root[own]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])
    release()


def _keys(radius: int, agree: int) -> list:
    """Block keys of ``fp``: each choice of ``agree`` of its ``radius + agree`` bit groups."""
    groups = radius + agree
    edges = [round(i * 64 / groups) for i in range(groups + 1)]
    part = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(groups)]
    return [F.xxhash64(F.lit(t), *[part[i] for i in own]) for t, own in enumerate(combinations(range(groups), agree))]


def in_tiles(blocks: DataFrame, counts: DataFrame, spread, *columns: str, across: bool = True) -> DataFrame:
    """Rows of shared blocks (key, columns) -> (tile, second, columns).

    ``counts`` (key, sides) says how many sides a block has, ``spread`` is a hash
    that deals its rows over them. A tile holds one side (``second`` is 0), or two
    if sides meet (``across``).
    """
    met = blocks.join(counts, "key").withColumn("side", F.pmod(spread, F.col("sides")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1) if across else F.array("side")).alias("other")
    low, high = F.least("side", "other"), F.greatest("side", "other")
    return met.select("key", "side", other, *columns).select(F.xxhash64("key", low, high).alias("tile"), ((F.col("side") == high) & (low != high)).cast("int").alias("second"), *columns)


def by_tile(rows: DataFrame) -> DataFrame:
    """Rows dealt and sorted by tile."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile").sortWithinPartitions("tile")


def links(fps: DataFrame, radius: int = 3, agree: int = 2) -> DataFrame:
    """Spanning links (u > v) between distinct fingerprints (fp) at most ``radius`` bits apart."""
    if not (0 <= radius and 1 <= agree and radius + agree <= 64):
        raise ValueError("radius and agreeing groups don't fit 64 bits")
    blocks = fps.select("fp", F.explode(F.array(*_keys(radius, agree))).alias("key"))
    shared = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("sides"))
    return by_tile(in_tiles(blocks, shared, F.xxhash64("fp"), "fp")).mapInArrow(lambda b: _linked(b, radius), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node u of ``edges`` (u, v) but the roots: the smallest node of its component.

    Large-star and small-star rounds: each is an aggregation to the least
    neighbour and a join, so no node's neighbours are ever gathered; a round's
    links are staged, and a star that a round leaves as it was is the end.
    """
    edges = stage(edges, "links")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every node's lower neighbours, itself included, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        new = stage(small, "links")
        old_sum, new_sum = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0] for x in (edges, new))
        forget(edges)
        edges = new
        if old_sum == new_sum:
            out = edges.select("u", F.col("v").alias("root"))
            out._quarrymap_staged = edges._quarrymap_staged
            return out


def near_duplicates(documents: DataFrame, radius: int = 3, shingle: int = 3, agree: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the smallest doc_id reachable."""
    spark = documents.sparkSession
    fps = stage(fingerprints(documents, shingle), "fingerprints")
    reps = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    found = components(links(reps, radius, agree))
    tidy(spark)
    # linked fingerprints with the least doc_id of their component
    members = found.select("u", "root").union(found.select("root", "root")).distinct()
    least = members.join(reps, F.col("u") == F.col("fp")).groupBy("root").agg(F.min("rep").alias("least"))
    named = members.join(least, "root").select(F.col("u").alias("m_fp"), "least")
    each = reps.join(named, F.col("fp") == F.col("m_fp"), "left").select(F.col("fp").alias("r_fp"), F.when(F.col("m_fp").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    each = stage(each, "names")  # a table of its own, so that Spark can split the join of a hot fingerprint
    forget(reps, found)
    return fps.join(each, F.col("fp") == F.col("r_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """The documents, columns as they were, one of each component: those with the smallest doc_id.

    Of rows that repeat that id the one with the least text stays (one of them,
    where texts are equal); a row without an id stays.
    """
    groups = near_duplicates(documents.select("doc_id", "text"), radius, shingle)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    least = documents.groupBy(F.col("doc_id").alias("l_id")).agg(F.min(F.coalesce("text", F.lit(""))).alias("l_text"))
    kept = kept.join(least, F.col("kept_id") == F.col("l_id")).select("kept_id", F.xxhash64("l_text").alias("kept_hash"))
    same = (documents["doc_id"] == kept["kept_id"]) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))).bitwiseXOR(kept["kept_hash"]) == 0)
    return documents.join(kept, same, "left_semi").dropDuplicates(["doc_id"]).unionByName(documents.where("doc_id IS NULL"))
