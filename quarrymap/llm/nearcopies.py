"""SimHash near-dedup at a shingle similarity: wide fingerprints compared bit-sliced, whole sets decide.

A text is the set of its five-word shingles (lower case, white space runs to one
space; a shorter text is one shingle). Texts are near copies where the Jaccard
similarity of their sets is ``percent`` or more; of each component of such links
one document stays.

Three bits of 64, the limit of the 64-bit operator, stand for a similarity of
about 0.98. At 0.8 two fingerprints differ in 15 % of their bits, so here they
have 256 bits and may differ in ``RADIUS`` of them (a similar pair is further
apart with a chance of 6 in a million), and they meet in blocks whose keys survive such a
distance: the ``WIDTH`` least hashes of a shingle set under each of ``BANDS``
families (a pair at 0.8 shares no block with a chance of 7 in a million, at 0.85 of
2 in a hundred million). The rest is the operator of ``simhash``: bit planes,
carry-save counters, abandoned cells, tiles, spanning links, large-star and
small-star components.

Equal sets are collapsed first. Then every side of a block gives a spanning
forest of its near fingerprints, nearest first, and the whole sets of each link
decide, so a large group of copies collapses by about as many decisions as it has
members. Last, all sides of the blocks that still hold more than one component
meet, with their sets: a tile decides its near pairs across components itself,
each in the first block that a pair shares, and again returns spanning links only.

Defined results: texts without words are equal; of rows equal in id and text one
stays; rows with one id and different texts are documents of their own; rows
without an id stay; an empty table gives no rows; other columns are as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, forget, map_columns, release, sliced, stage, tidy
from .simhash import TILE, by_tile, components, in_tiles, near_in_tiles, tiles

SHINGLE, PERCENT = 5, 80
BANDS, WIDTH = 30, 5
BITS, RADIUS = 256, 64
#: Bytes of the sets on a side of a tile that decides by sets.
SIDE_BYTES = 2 << 20

_RNG = np.random.default_rng(42)
#: A random number for each byte value, and odd numbers: of the rolling hash, of the families and of the fingerprint's words.
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64, endpoint=False)
_BASE = int(_RNG.integers(0, 2**64, dtype=np.uint64, endpoint=False)) | 5
_FAMILY = _RNG.integers(0, 2**32, (BANDS * WIDTH, 2), np.uint32, endpoint=False) | np.array([1, 0], np.uint32)
_WORD = _RNG.integers(0, 2**64, BITS // 64, np.uint64, endpoint=False) | np.uint64(1)
_WRAP = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), by doubling."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def _mixed_bits(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: Words of a text, and bytes, that are hashed at a time.
SEGMENT, CHUNK = 1 << 16, 1 << 21


def _hashed(parts: list[list[bytes]], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, hash) of every shingle of some lists of words, none of them empty."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b" ".join(map(b" ".join, parts)), np.uint8)
    # a rolling hash: of bytes a to b it is (total[b] - total[a]) / base ** a
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(data))
    space = np.flatnonzero(data == 32)
    begin, end = np.concatenate([[0], space + 1]), np.concatenate([space, [len(data)]])
    count = np.maximum(1, size - shingle + 1)
    part = np.repeat(np.arange(len(parts)), count)
    word = (np.cumsum(size) - size)[part] + np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(word + shingle, np.cumsum(size)[part]) - 1
    return part, _mixed_bits((total[end[last]] - total[begin[word]]) * inverse[begin[word]])


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of every text's shingles one after the other, their number for each text)."""
    owners, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    parts: list[list[bytes]] = []
    of: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        part, h = _hashed(parts, shingle)
        owners.append(np.array(of, np.int64)[part])
        hashes.append(h)
        parts.clear(), of.clear()
        held = 0

    for i, text in enumerate(texts):
        words = text.decode("utf-8", "replace").lower().encode().split()
        for at in range(0, len(words), SEGMENT):
            part = words[at : at + SEGMENT + shingle - 1]
            if at and len(part) < shingle:  # the segment before has them
                continue
            parts.append(part), of.append(i)
            held += len(text) if len(words) <= SEGMENT else sum(map(len, part))
            if held > CHUNK:
                flush()
    if parts:
        flush()
    text, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(texts))


def band_keys(hashes: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """The key of each band of every set, as signed numbers; an empty set has none."""
    full = np.flatnonzero(size)
    out: list[list[int]] = [[] for _ in size]
    if not len(full):
        return out
    begin = (np.cumsum(size) - size)[full]
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(full), BANDS * WIDTH), np.uint32)
    for f, (times, plus) in enumerate(_FAMILY):
        least[:, f] = np.minimum.reduceat(low * times + plus, begin)
    for i, row in zip(full.tolist(), least):
        raw = row.tobytes()
        keys = [xxhash.xxh64_intdigest(raw[4 * WIDTH * b : 4 * WIDTH * (b + 1)], b) for b in range(BANDS)]
        out[i] = np.array(keys, np.uint64).view(np.int64).tolist()
    return out


def fingerprints(hashes: np.ndarray, size: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """(texts, BITS / 8) bytes: the majority bits of each set, nothing for an empty one."""
    ones = np.zeros((len(size), BITS), np.int32)
    owner = np.repeat(np.arange(len(size)), size)
    for at in range(0, len(hashes), chunk):
        wide = _mixed_bits(hashes[at : at + chunk, None] * _WORD)
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        own = owner[at : at + chunk]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little")


def _sketched(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, digest, n, keys) of every row with an id."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        hashes, size = shingle_sets(byte_texts(batch.column("text")))
        ends = np.cumsum(size).tolist()
        digest = [xxhash.xxh3_128_digest(hashes[e - n : e].tobytes()) for e, n in zip(ends, size.tolist())]
        return {"digest": pa.array(digest, pa.binary()), "n": pa.array(size, pa.int64()), "keys": pa.array(band_keys(hashes, size), pa.list_(pa.int64()))}

    rows = documents.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_columns(rows, run, ["doc_id", "text_hash"], "digest binary, n bigint, keys array<bigint>")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, keys, fp, hashes) of the sets in ``wanted`` (node, rep: id and hash of a text, n, keys)."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        hashes, size = shingle_sets(byte_texts(batch.column("text")))
        fp = fingerprints(hashes, size)
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(hashes.view(np.int64)))
        return {"fp": pa.array([f.tobytes() for f in fp], pa.binary()), "hashes": parts}

    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    each = wanted.select("node", "n", "keys", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"))
    # rows equal in id and text lie together already
    met = texts.join(each, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("node", "n", "keys", "text")
    return map_columns(met, run, ["node", "n", "keys"], "fp binary, hashes array<bigint>")


def _near(key, node, n, root, second, fp, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the near pairs of a run of tiles that are in different components and of sizes that can be similar enough."""
    lanes = np.frombuffer(b"".join(fp.tolist()), np.uint64).reshape(-1, BITS // 64)
    for i, j in near_in_tiles(key, second, lanes, RADIUS, root):
        fits = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[fits], j[fits]
        if len(i):
            yield i, j, np.bitwise_count(lanes[i] ^ lanes[j]).sum(1)


def _links(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j]), pa.int64()), pa.array(np.minimum(node[i], node[j]), pa.int64())], names=["u", "v"])


_TILED = ("tile", "node", "n", "root", "second", "fp")


def _forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(u, v) of a spanning forest of the near pairs of every tile, nearest first."""
    for key, node, n, root, second, fp in tiles(batches, _TILED):
        for i, j, distance in _near(key, node, n, root, second, fp, percent):
            yield _links(node, *spanning(i, j, distance, root))
    release()


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(u, v) of links that span what the near pairs of every tile connect, decided by their sets."""
    for key, node, n, root, second, fp, band, keys, sets in tiles(sliced(batches, 256), (*_TILED, "band", "keys", "hashes")):
        shared = np.stack(keys.tolist())
        for i, j, _ in _near(key, node, n, root, second, fp, percent):
            first = ~((shared[i] == shared[j]) & (np.arange(BANDS) < band[i][:, None])).any(1)
            yield _links(node, *similar(i[first], j[first], n, root, sets, percent))
    release()


def similar(i: np.ndarray, j: np.ndarray, n: np.ndarray, root: np.ndarray, sets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) enough similar ones to connect, over components ``root``, all that any of them connects."""
    if not len(i):
        return i, j
    rows = np.unique(np.concatenate([i, j]))
    _, ids = np.unique(np.concatenate(sets[rows].tolist()), return_inverse=True)
    ends = np.cumsum(n[rows])
    own = dict(zip(rows.tolist(), np.split(ids, ends[:-1])))
    mark = np.zeros(int(ids.max()) + 1, bool)
    _, label = np.unique(root, return_inverse=True)
    label = label.copy()
    kept: list[tuple[int, int]] = []
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])).tolist()
    for a, b in zip(edge, [*edge[1:], len(i)]):
        x, others = int(i[a]), j[a:b]
        others = others[label[others] != label[x]]
        if not len(others):
            continue
        mark[own[x]] = True
        inside = mark[np.concatenate([own[y] for y in others.tolist()])]
        both = np.add.reduceat(inside, np.cumsum(n[others]) - n[others], dtype=np.int64)
        mark[own[x]] = False
        for y in others[(100 + percent) * both >= percent * (n[x] + n[others])].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                kept.append((x, y))
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def spanning(i: np.ndarray, j: np.ndarray, distance: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (i, j) those of a spanning forest over components ``root``, nearest first."""
    _, at = np.unique(root, return_inverse=True)
    parent = list(range(int(at.max()) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept, open_ = [], len(parent) - 1
    order = np.lexsort((j, i, distance))
    for k, a, b in zip(order.tolist(), at[i[order]].tolist(), at[j[order]].tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            kept.append(k)
            open_ -= 1
            if not open_:
                break
    return i[kept], j[kept]


def _decided(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, near) of pairs, by whole sets."""
    u, v = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_hashes")) for x in "uv")
    both, size = F.size(F.array_intersect("u_hashes", "v_hashes")), F.size("u_hashes") + F.size("v_hashes")
    return pairs.join(u, "u").join(v, "v").select("u", "v", ((100 + percent) * both >= percent * size).alias("near"))


def _open_blocks(met: DataFrame, found: DataFrame) -> DataFrame:
    """(key, band, node, n, fp, root) of the blocks that hold more than one component."""
    rooted = met.join(found, met["node"] == found["u"], "left").select("key", "band", "node", "n", "fp", F.coalesce("root", "node").alias("root"))
    return rooted.join(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "key")


def components_of(reps: DataFrame, documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, root) of the nodes of ``reps`` (node, rep, n, keys) that are near copies of a smaller one, directly or by others."""
    spark = reps.sparkSession
    bands = reps.select("node", F.explode("keys").alias("key"))
    shared = stage(bands.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shared")
    wanted = bands.join(shared, "key", "left_semi").select("node").distinct()
    sets = stage(_sets(documents, reps.join(wanted, "node", "left_semi")), "sets")
    met = stage(sets.select("node", "n", "fp", F.posexplode("keys").alias("band", "key")).join(shared.select("key"), "key", "left_semi"), "blocks")
    tidy(spark)

    sides = shared.select("key", F.ceil(F.col("held") / TILE).cast("int").alias("sides"))
    dealt = by_tile(in_tiles(met.withColumn("root", F.col("node")), sides, F.xxhash64("node"), "node", "n", "root", "fp", across=False))
    forest = dealt.mapInArrow(lambda b: _forest(b, percent), "u bigint, v bigint").distinct()
    links = stage(_decided(forest, sets, percent).where("near").select("u", "v"), "forest")
    forget(shared)
    found = components(links)
    tidy(spark)

    own = stage(_open_blocks(met, found), "open")
    forget(met)
    if not own.isEmpty():
        # sides of so many sets, and of so many bytes of them
        size = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") * 8 / SIDE_BYTES)).cast("int").alias("sides")
        dealt = in_tiles(own, own.groupBy("key").agg(size), F.xxhash64("node"), "node", "n", "root", "fp", "band")
        dealt = by_tile(dealt.join(sets.select("node", "keys", "hashes"), "node"))
        more = stage(dealt.mapInArrow(lambda b: _verified(b, percent), "u bigint, v bigint").distinct(), "verified")
        forget(found)
        found = components(links.union(more))
        forget(more)
        tidy(spark)
    forget(sets, own, links)
    return found


def keep_one(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, columns as they were, one of each component of near copies: the one with the smallest doc_id (then the smallest hash of its text)."""
    sketched = stage(_sketched(documents), "sketches")
    reps = sketched.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    reps = stage(reps.drop("digest").withColumn("node", F.monotonically_increasing_id()), "representatives")
    forget(sketched)
    found = components_of(reps, documents, percent)
    tidy(documents.sparkSession)
    named = reps.join(found, reps["node"] == found["u"], "left").select("rep", F.coalesce("root", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.doc_id").alias("kept_id"), F.col("rep.text_hash").alias("kept_hash"))
    # joined by id alone, so that equal rows lie together already
    same = (documents["doc_id"] == kept["kept_id"]) & (F.xxhash64(documents["text"]).bitwiseXOR(kept["kept_hash"]) == 0)
    ided = documents.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return ided.unionByName(documents.where("doc_id IS NULL"))
