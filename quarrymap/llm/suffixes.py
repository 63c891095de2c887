"""Suffix-array dedup: remove bytes of passages that an earlier document holds.

A byte goes if it is covered by a ``length``-byte string (50) that also starts
in a document with a smaller doc_id. All strings are judged on the input, byte
for byte, and never across documents.

1. Copies of whole texts are found by digest: all but the first go whole, and
   take no further part.
2. Anchors: each window of ``length`` bytes picks the least of its k-gram
   hashes; equal windows pick the same one, so a shared window has a shared
   anchor. Anchors (about one in 16 bytes) are reduced per task to one record
   a hash, packed by bucket, and met with those of all other tasks.
3. The windows of each shared anchor are cut out as one string (the windows
   that picked it and no others), equal strings of a batch once, packed by
   bucket of the anchor and met. An anchor with one string needs no comparison;
   the strings of the others are indexed by a Burrows-Wheeler transform, where
   backward extension, breadth first, finds the places where common prefixes of
   0, 1, 2 ... bytes end and stops at ``length``: rows between such places
   share ``length`` bytes, and get the least doc_id among them. Very frequent
   anchors, of which there can be a bounded number only, are met window by
   window instead, so that their many different neighbours spread over all
   buckets.
4. The answers go back to the batch that asked, where runs are merged and cut.

No stage holds more than a batch or a bucket; nothing is dropped or capped.

Defined results: a null text is empty; a document with a null doc_id is neither
cut nor held against others; rows that repeat a doc_id are not earlier than
each other, so they are cut only by smaller ids (they lie in one batch); an
empty table gives no rows; other columns, of any name, are as they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import ROWS, byte_texts, forget, loose, named, nullable, release, sliced, stage

LENGTH, GRAM = 50, 20
#: Bytes that are hashed at a time, and bytes of a batch of documents on average.
CHUNK, PACK = 1 << 20, 8 << 20
#: An anchor is hot if it has more than this share of all records, and ``HOT_LEAST`` at least: there are at most 1 / share of them.
HOT_SHARE, HOT_LEAST = 1 / 65536, 1000
_MULT = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
_PLACE_BITS = 28


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from each position on, by doubling."""
    power, size, result, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    while True:
        if k & size:
            if result is None:
                result = power.copy()
            else:
                m = len(data) - done - size + 1
                result = result[:m] * np.uint64(pow(_MULT, size, 1 << 64)) + power[done : done + m]
            done += size
        if done == k:
            break
        m = len(power) - size
        power = power[:m] * np.uint64(pow(_MULT, size, 1 << 64)) + power[size : size + m]
        size *= 2
    h = result[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def picks(data: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the position of its anchor, and the k-gram hashes.

    Of equal least hashes the last counts; it depends on the window's bytes only.
    The hashes are returned in 48 bits.
    """
    h = gram_hashes(data, k)
    span = length - k + 1
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), h >> np.uint64(16)
    # the last bits of the hash make room for the place, counted down: ties go to the last
    bits = np.uint64(_PLACE_BITS)
    room = np.uint64((1 << _PLACE_BITS) - 1)
    low, size = ((h >> bits) << bits) | (room - (np.arange(len(h), dtype=np.uint64) & room)), 1
    while 2 * size <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = span - size
    low = np.minimum(low[:n], low[rest : rest + n])
    start = np.arange(n, dtype=np.int64)
    place = (room - (low & room)).astype(np.int64)
    return start + ((place - start) & int(room)), h >> np.uint64(16)


class _Chunk:
    """Some documents end to end, and the window runs of their anchors.

    A run: consecutive windows of one document that picked the same anchor.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        pick, h = picks(self.data, length)
        # windows that lie in one document
        ok = np.zeros(len(pick), bool)
        whole = np.flatnonzero(sizes >= length)
        if len(pick):
            step = np.zeros(len(pick) + 1, np.int8)
            step[self.starts[whole]] += 1
            np.add.at(step, self.ends[whole] - length + 1, -1)
            ok = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        head = ok.copy()
        head[1:] &= ~ok[:-1] | (pick[1:] != pick[:-1])
        head[self.starts[whole]] = True
        self.first = np.flatnonzero(head)  # first window of each run
        stop = ok.copy()
        stop[:-1] &= ~ok[1:] | head[1:]
        self.count = np.flatnonzero(stop) - self.first + 1
        self.anchor = pick[self.first]
        self.hash = h[self.anchor] if len(self.first) else np.empty(0, np.uint64)
        self.doc = np.searchsorted(self.ends, self.first, side="right")


def _chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(bucket[own[0]]), [c[own] for c in columns]


# --- step 2: which anchors are shared --------------------------------------

_ANCHORS = "bucket int, fresh binary, known binary"


def _packed(h: np.ndarray, d: np.ndarray, n: np.ndarray | None = None) -> bytes:
    """Hashes (6 bytes), doc_ids (from the least on) and counts, one after the other."""
    base = int(d.min())
    wide = int(d.max()) - base >= 1 << 32
    head = np.array([len(h), base, wide, n is not None], "<i8").tobytes()
    ids = d.astype("<i8") if wide else (d - base).astype("<u4")
    return head + h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + ids.tobytes() + (b"" if n is None else n.astype("<u4").tobytes())


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hs, ds, ns = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for blob in blobs:
        if not blob:
            continue
        m, base, wide, counted = np.frombuffer(blob, "<i8", 4).tolist()
        h = np.zeros((m, 8), np.uint8)
        h[:, :6] = np.frombuffer(blob, np.uint8, 6 * m, 32).reshape(m, 6)
        d = np.frombuffer(blob, "<i8" if wide else "<u4", m, 32 + 6 * m).astype(np.int64)
        hs.append(h.view("<u8").ravel()), ds.append(d if wide else d + base)
        if counted:
            ns.append(np.frombuffer(blob, "<u4", m, len(blob) - 4 * m).astype(np.int64))
    return np.concatenate(hs), np.concatenate(ds), np.concatenate(ns)


def _anchor_records(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per task and bucket: ``fresh`` (hash, doc, records) one a hash, ``known`` (hash, doc) of those already seen twice."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: dict[bytes, int] = {}
    size = 0

    def packed() -> pa.RecordBatch:
        h, d = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, d = h[new], d[new]  # one of a document
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.concatenate([edge, [len(h)]]))
        twice = np.repeat(n > 1, n)
        out: dict[int, list[bytes]] = {}
        for b, columns in _by_bucket((h[edge] % np.uint64(buckets)).astype(np.int64), h[edge], d[edge], n):
            out.setdefault(b, [b"", b""])[0] = _packed(*columns)
        # shared already: any bucket will do, so they go where their document's id says
        where = (d[twice].view(np.uint64) * np.uint64(_MULT) >> np.uint64(33)) % np.uint64(buckets)
        for b, columns in _by_bucket(where.astype(np.int64), h[twice], d[twice]):
            out.setdefault(b, [b"", b""])[1] = _packed(*columns)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(out), pa.int32()), pa.array([x[0] for x in out.values()], pa.binary()), pa.array([x[1] for x in out.values()], pa.binary())], names=["bucket", "fresh", "known"]
        )

    for batch in sliced(batches, 4 * ROWS):  # so that chunks are filled
        ids, texts = np.asarray(batch.column("doc_id")), byte_texts(batch.column("text"))
        for a, b in _chunks(texts):
            own = []
            for i in range(a, b):
                digest, d = xxhash.xxh3_128_digest(texts[i]), int(ids[i])
                # step 1 has the copies: a text counts again only under a smaller id
                if len(texts[i]) >= LENGTH and d < seen.get(digest, d + 1):
                    seen[digest] = d
                    own.append(i)
            if not own:
                continue
            c = _Chunk([texts[i] for i in own])
            held.append((c.hash, ids[own][c.doc].astype(np.int64)))
            size += len(c.hash)
            if size > (1 << 20):
                yield packed()
                held, size = [], 0
            if len(seen) > (1 << 18):
                seen.clear()
    if size:
        yield packed()
    release()


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, anchor, 0) of every shared anchor in a partition of buckets; once a hash also its number of records."""
    fresh, known = [], []
    for batch in batches:
        fresh += batch.column("fresh").to_pylist()
        known += batch.column("known").to_pylist()
    h, d, n = _unpacked(fresh)
    known_h, known_d, _ = _unpacked(known)
    del fresh, known
    order = np.lexsort((d, h))
    h, d, n = h[order], d[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.concatenate([edge, [len(h)]]))
    total = np.add.reduceat(n, edge) if len(edge) else n
    many = np.repeat(size > 1, size)
    out_h = np.concatenate([h[many], known_h, h[edge[total > 1]]])
    out_d = np.concatenate([d[many], known_d, d[edge[total > 1]]])
    out_n = np.concatenate([np.zeros(many.sum() + len(known_h), np.int64), total[total > 1]])
    for at in range(0, len(out_h), 1 << 16):
        s = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(out_d[s]), pa.array(out_h[s].view(np.int64)), pa.array(out_n[s])], names=["doc_id", "anchor", "n"])
    release()


# --- step 3: which windows of them are ---------------------------------------

_ASKED = "bucket int, batch int, ask binary"


def _runs(texts: list[bytes], anchors: np.ndarray, hot: np.ndarray) -> Iterator[tuple[_Chunk, int, np.ndarray, np.ndarray]]:
    """Of the chunks of a batch: (chunk, its first text, runs of shared ``anchors`` (sorted), cold: not hot)."""
    for a, b in _chunks(texts):
        c = _Chunk(texts[a:b])
        place = np.minimum(np.searchsorted(anchors, c.hash), len(anchors) - 1)
        at = np.flatnonzero(anchors[place] == c.hash) if len(anchors) else np.empty(0, np.int64)
        if len(at):
            yield c, a, at, ~np.isin(c.hash[at], hot)


def _keys(c: _Chunk, at: np.ndarray, cold: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, first window, windows, key): a cold run's key is its anchor, the anchor's place and the string; a hot run has a key a window."""
    raw = c.data.tobytes()
    firsts, counts = c.first[at].tolist(), c.count[at].tolist()
    heads, places = c.hash[at].astype("<u8").tobytes(), (c.anchor[at] - c.first[at]).tolist()
    for k, (f, n, is_cold) in enumerate(zip(firsts, counts, cold.tolist())):
        if is_cold:
            yield k, f, n, heads[8 * k : 8 * k + 8] + _PLACES[places[k]] + raw[f : f + n + LENGTH - 1]
        else:
            for w in range(f, f + n):
                yield k, w, 1, raw[w : w + LENGTH]


_PLACES = [bytes([i]) for i in range(256)]


def _ask(ids: np.ndarray, texts: list[bytes], anchors: np.ndarray, hot: np.ndarray) -> dict[bytes, int]:
    """The distinct questions of a batch and the least doc_id that has each."""
    asked: dict[bytes, int] = {}
    for c, a, at, cold in _runs(texts, anchors, hot):
        docs = ids[a + c.doc[at]].tolist()
        for k, _, _, key in _keys(c, at, cold):
            d = asked.get(key)
            if d is None or docs[k] < d:
                asked[key] = docs[k]
    return asked


def _bucket_of(key: bytes, buckets: int) -> int:
    part = key[:8] if len(key) != LENGTH else xxhash.xxh3_64_digest(key)
    return (int.from_bytes(part, "little") * _MULT >> 17 & _WRAP) % buckets


def _questions(batch: int, asked: dict[bytes, int], buckets: int) -> pa.Table:
    by: dict[int, list] = {}
    for item in asked.items():
        by.setdefault(_bucket_of(item[0], buckets), []).append(item)
    blobs = []
    for own in by.values():
        own.sort()  # strings of one anchor side by side
        docs, sizes = np.array([d for _, d in own], "<i8"), np.array([len(k) for k, _ in own], "<u1")
        blobs.append(_squeezed(np.array([len(own)], "<u4").tobytes() + docs.tobytes() + sizes.tobytes() + b"".join(k for k, _ in own)))
    return pa.table({"bucket": pa.array(list(by), pa.int32()), "batch": pa.array([batch] * len(by), pa.int32()), "ask": pa.array(blobs, pa.binary())})


def _squeezed(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(blob)


def _unsqueezed(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _opened(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    blob = _unsqueezed(blob)
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    docs = np.frombuffer(blob, "<i8", n, 4)
    ends = np.cumsum(np.frombuffer(blob, "<u1", n, 4 + 8 * n).astype(np.int64)) + 4 + 9 * n
    at, keys = 4 + 9 * n, []
    for e in ends.tolist():
        keys.append(blob[at:e])
        at = e
    return docs, keys


def order_of_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more (doubling)."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # symbols are under 512: seven fit a word
        key = key << np.uint64(9) | padded[i : i + n]
    size = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if size >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:] + 1
        key = (rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        size *= 2


def prefix_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, class of each row): rows of a class share their first ``length`` symbols.

    Common prefixes by increasing value on the Burrows-Wheeler transform: the
    border between rows LF(i) and LF(j), i and j being consecutive places of
    one symbol in the transform, has value v + 1 just when a border of value v,
    and none of a lower value, lies in (i, j]. Borders are set breadth first,
    value by value, and the search stops at ``length``: what has no border then
    shares at least that many symbols.
    """
    n = len(text)
    order = order_of_suffixes(text, length)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt.astype(np.uint16), kind="stable")  # row LF(i) has its transform place i here
    first = bwt[by_symbol]
    border = np.concatenate([[True], first[1:] != first[:-1]])  # value 0
    rows = np.flatnonzero(~border)  # still open
    low, high = by_symbol[rows - 1] + 1, by_symbol[rows] + 1
    for _ in range(1, length):
        before = np.concatenate([[0], np.cumsum(border, dtype=np.int32)])
        hit = before[high] > before[low]
        if not hit.any():
            break
        border[rows[hit]] = True
        rows, low, high = rows[~hit], low[~hit], high[~hit]
    return order, np.cumsum(border) - 1


#: Symbols that one transform indexes: groups of strings are put together up to this many.
INDEX = 1 << 19


def least_documents(strings: list[tuple[bytes, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each (string, doc_id) the least doc_id that holds each of its windows."""
    sizes = np.fromiter((len(s) + 1 for s, _ in strings), np.int64, len(strings))
    text = np.frombuffer(b"\0".join(s for s, _ in strings) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    text[ends - 1] = 0
    order, group = prefix_classes(text, length)
    owner = np.repeat(np.arange(len(strings)), sizes)
    inside = np.arange(len(text)) + length < np.repeat(ends, sizes)
    docs = np.fromiter((d for _, d in strings), np.int64, len(strings))
    rows = inside[order]
    at, group = order[rows], group[rows]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs[owner[at]])
    found = np.empty(len(text), np.int64)
    found[at] = least[group]
    return [found[e - s : e - length] for e, s in zip(ends.tolist(), sizes.tolist())]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to the batch: the key of a question and the least doc_id for each of its windows."""
    asked: list[tuple[int, bytes]] = []
    least: dict[bytes, int] = {}
    for rb in batches:
        for batch, blob in zip(rb.column("batch").to_pylist(), rb.column("ask").to_pylist()):
            asked.append((batch, blob))
            docs, keys = _opened(blob)
            for k, d in zip(keys, docs.tolist()):
                known = least.get(k)
                if known is None or d < known:
                    least[k] = d
    groups: dict[bytes, list[bytes]] = {}
    for k in least:
        if len(k) != LENGTH:
            groups.setdefault(k[:8], []).append(k)
    answer: dict[bytes, np.ndarray] = {}
    held: list[bytes] = []

    def index() -> None:
        for k, found in zip(held, least_documents([(k[9:], least[k]) for k in held])):
            answer[k] = found
        held.clear()

    size = 0
    for own in groups.values():
        if len(own) > 1:
            held += own
            size += sum(map(len, own))
            if size > INDEX:
                index()
                size = 0
    if held:
        index()
    for batch, blob in asked:
        docs, keys = _opened(blob)
        parts = []
        for k, d in zip(keys, docs.tolist()):
            n = 1 if len(k) == LENGTH else len(k) - 8 - LENGTH
            found = answer.get(k)
            parts.append(found if found is not None else np.full(n, least[k]))
        flat = np.concatenate(parts)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        heads = np.unique(np.frombuffer(b"".join(k[:8] for k in keys if len(k) != LENGTH), "<u8"))
        # a digest of the key names it
        names = b"".join(map(xxhash.xxh3_128_digest, keys))
        back = np.array([len(keys), len(heads)], "<u4").tobytes() + heads.tobytes() + n.astype("<u1").tobytes() + names + flat.astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int32()), pa.array([_squeezed(back)], pa.binary())], names=["batch", "answer"])
    release()


# --- step 4: cut ----------------------------------------------------------


def _known(blobs: list[bytes]) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
    """Answers of a batch: (cold anchors, name of a question -> its first place in, the least doc_ids)."""
    heads, at_name, flat, base = [np.empty(0, np.uint64)], {}, [np.empty(0, np.int64)], 0
    for blob in map(_unsqueezed, blobs):
        n, m = np.frombuffer(blob, "<u4", 2).tolist()
        at = 8 + 8 * m
        heads.append(np.frombuffer(blob, "<u8", m, 8))
        counts = np.frombuffer(blob, "<u1", n, at).astype(np.int64)
        names = blob[at + n : at + 17 * n]
        least = np.frombuffer(blob, "<i8", -1, at + 17 * n)
        firsts = (base + np.cumsum(counts) - counts).tolist()
        at_name.update((names[16 * i : 16 * i + 16], f) for i, f in enumerate(firsts))
        flat.append(least)
        base += len(least)
    return np.unique(np.concatenate(heads)), at_name, np.concatenate(flat)


def removed_spans(ids: np.ndarray, texts: list[bytes], hot: np.ndarray, blobs: list[bytes]) -> list[np.ndarray]:
    """For each text the maximal runs [start, end) of removed bytes, as an array of shape (runs, 2)."""
    cold_anchors, at_name, least = _known(blobs)
    out = [np.empty((0, 2), np.int64)] * len(texts)
    digest, look = xxhash.xxh3_128_digest, at_name.get
    for c, first_text, at, cold in _runs(texts, np.union1d(cold_anchors, hot), hot):
        told = [(w, n, f) for _, w, n, key in _keys(c, at, cold) if (f := look(digest(key))) is not None]
        if not told:
            continue
        start, length, source = np.array(told, np.int64).T
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        windows = np.repeat(start, length) + step
        earlier = least[np.repeat(source, length) + step]
        gone = windows[earlier < ids[first_text + np.searchsorted(c.ends, windows, side="right")]]
        if not len(gone):
            continue
        size = len(c.data)
        mark = np.bincount(gone, minlength=size + 1) - np.bincount(gone + LENGTH, minlength=size + 1)
        covered = np.cumsum(mark[:-1]) > 0
        for k in np.unique(np.searchsorted(c.ends, gone, side="right")).tolist():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[c.starts[k] : c.ends[k]].view(np.int8), [0]])))
            out[first_text + k] = edge.reshape(-1, 2)
    return out


def cut_text(text: bytes, spans: np.ndarray) -> bytes:
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def remove_repeats(documents: DataFrame, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans: removed runs [start, end), kept: the remaining bytes, rest: all other columns) of every row.

    With ``as_text`` kept is text: a cut may fall inside a character, and what is left of it goes.
    """
    spark = documents.sparkSession
    own = [c for c in documents.columns if c not in ("doc_id", "text")]
    rest = (F.struct(*[named(c) for c in own]) if own else F.struct(F.lit(None).cast("int").alias("none"))).alias("rest")
    texts = documents.select("doc_id", "text", rest)
    ided = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")

    # 1. copies of whole texts
    digests = stage(ided.where(F.octet_length("text") >= LENGTH).select("doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest")), "digests")
    data_bytes = digests.agg(F.sum("size")).collect()[0][0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), data_bytes // (24 << 20) + 1)
    buckets = 4 * tasks
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id")
    copies = stage(digests.join(firsts, "digest").where("doc_id > first_id").select("doc_id", "digest"), "copies")
    forget(digests)

    # 2. shared anchors
    records = ided.select("doc_id", "text").mapInArrow(lambda b: _anchor_records(b, buckets), _ANCHORS)
    shared = records.repartition(tasks, "bucket").mapInArrow(_shared_anchors, "doc_id bigint, anchor bigint, n bigint")
    shared = stage(shared, "anchors", compression="zstd")
    limit = max(HOT_LEAST, (shared.agg(F.sum("n")).collect()[0][0] or 0) * HOT_SHARE)
    hot = [r["anchor"] for r in shared.where(F.col("n") > limit).select("anchor").collect()]  # at most 1 / HOT_SHARE
    known_hot = spark.sparkContext.broadcast(np.sort(np.array(hot, np.int64).view(np.uint64)))

    # 3. what each batch of documents asks, and the answers
    batches = max(tasks, data_bytes // PACK + 1)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    nothing = {"anchor": "bigint", "c_id": "bigint", "digest": "string", "answer": "binary"}

    def said(rows: DataFrame, **columns) -> DataFrame:
        return rows.select("batch", *[columns.get(c, F.lit(None).cast(t)).alias(c) for c, t in nothing.items()])

    of_copies = said(copies.select(batch, "doc_id", "digest"), c_id=F.col("doc_id"), digest=F.col("digest"))
    of_anchors = said(shared.where("n = 0").select(batch, "anchor"), anchor=F.col("anchor"))
    rows = ided.select(batch, "doc_id", "text", "rest")

    def opened(rows: pa.Table, told: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Ids and texts of a batch, and which are copies: they have no text any more."""
        ids, data = np.asarray(rows.column("doc_id").combine_chunks()), byte_texts(rows.column("text").combine_chunks())
        copied = {(c, d) for c, d in zip(told.column("c_id").to_pylist(), told.column("digest").to_pylist()) if c is not None} if told.column("c_id").null_count < len(told) else set()
        known = {c for c, _ in copied}
        return ids, data, np.array([i in known and (i, hashlib.sha256(t).hexdigest()) in copied for i, t in zip(ids.tolist(), data)], bool)

    def ask(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        ids, data, copy = opened(rows, told)
        anchors = np.unique(np.asarray(told.column("anchor").drop_null()).view(np.uint64))
        return _questions(key[0].as_py(), _ask(ids, [b"" if c else t for t, c in zip(data, copy)], anchors, known_hot.value), buckets)

    asked = rows.drop("rest").groupBy("batch").cogroup(of_anchors.union(of_copies).groupBy("batch")).applyInArrow(ask, _ASKED)
    answered = stage(asked.repartition(tasks, "bucket").mapInArrow(_answers, "batch int, answer binary"), "answers")
    forget(shared)

    # 4. every batch with its answers
    def cut(rows: pa.Table, told: pa.Table) -> pa.Table:
        ids, data, copy = opened(rows, told)
        spans = removed_spans(ids, [b"" if c else t for t, c in zip(data, copy)], known_hot.value, told.column("answer").drop_null().to_pylist())
        for i in np.flatnonzero(copy).tolist():
            spans[i] = np.array([[0, len(data[i])]])
        kept = [cut_text(t, s) for t, s in zip(data, spans)]
        out = pa.table({
            "doc_id": rows.column("doc_id"),
            "n_bytes": pa.array([len(t) for t in data], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in spans], _SPANS),
            "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
            "rest": rows.column("rest").cast(nullable(rows.schema.field("rest").type)),
        })
        del data, kept
        release()
        return out

    kind = StructType.fromDDL("doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>")
    kind = StructType([*kind.fields, StructField("kept", StringType() if as_text else BinaryType()), StructField("rest", loose(texts.schema["rest"].dataType))])
    done = rows.groupBy("batch").cogroup(said(answered, answer=F.col("answer")).union(of_copies).groupBy("batch")).applyInArrow(cut, kind)
    whole = F.coalesce(F.col("text"), F.lit(""))
    left = texts.where("doc_id IS NULL OR text IS NULL").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"), (whole if as_text else whole.cast("binary")).alias("kept"), "rest"
    )
    return done.union(left)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def repeat_report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(documents.select("doc_id", "text")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents, columns as they were, with repeated passages cut out of ``text`` and ``n_chars`` recounted. No row goes."""
    made = remove_repeats(documents, as_text=True)
    each = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    for f in documents.schema.fields:
        if f.name not in each:
            each[f.name] = F.char_length("kept").cast(f.dataType) if f.name == "n_chars" else F.col("rest").getField(f.name)
    return made.select(*[each[c].alias(c) for c in documents.columns])
