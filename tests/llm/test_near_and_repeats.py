"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrymap.llm import simhash, suffixes

SCHEMA = "doc_id long, text string, lang string"


def brute_fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 60, 700):
        text = " ".join(rng.choice(["A", "bé", "c d", "Ee\t", "ff"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def scattered(rng, count, words, flips):
    base = rng.integers(0, 2**63, (5, words), dtype=np.uint64)
    fps = base[rng.integers(0, 5, count)].copy()
    for _ in range(flips):
        where = rng.integers(0, words, count)
        fps[np.arange(count), where] ^= np.where(rng.random(count) < 0.6, np.uint64(1) << rng.integers(0, 64, count).astype(np.uint64), np.uint64(0))
    return fps


def brute_pairs(a, b, radius):
    return {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if int(np.bitwise_count(x ^ y).sum()) <= radius}


@pytest.mark.parametrize(("words", "radius", "flips"), [(1, 0, 2), (1, 3, 4), (1, 5, 8), (4, 64, 90), (4, 10, 9)])
@pytest.mark.parametrize("count", [1, 2, 63, 64, 65, 200])
def test_cells_and_pairs_are_exact(words, radius, flips, count):
    rng = np.random.default_rng(count)
    fps, other = scattered(rng, count, words, flips), scattered(rng, 70, words, flips)
    other[:1] = fps[:1]
    got = [(i, j) for x, y in simhash.near_cells(fps, fps, radius, 0) for i, j in zip(x.tolist(), y.tolist())]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in brute_pairs(fps, fps, radius) if i < j}
    got = [(i, j) for x, y in simhash.near_cells(fps, other, radius) for i, j in zip(x.tolist(), y.tolist())]
    assert set(got) == brute_pairs(fps, other, radius)
    a, b = np.divmod(np.arange(count * 70), 70)
    near = simhash.near_pairs(fps[a], other[b], radius)
    assert {(int(a[k]), int(b[k])) for k in near} == brute_pairs(fps, other, radius)


def test_cells_are_abandoned(monkeypatch):
    """Most cells of unrelated fingerprints are given up before half of the planes, though each query is a lane itself."""
    left, keep = [], simhash.Counter.keep
    monkeypatch.setattr(simhash.Counter, "keep", lambda self, at: (left.append(len(at) / len(self.beyond)), keep(self, at))[1])
    fps = np.random.default_rng(5).integers(0, 2**63, (1024, 1), dtype=np.uint64)
    assert not [x for x, _ in simhash.near_cells(fps, fps, 3, 0) if len(x)]
    assert left and min(left) < 0.5
    left.clear()
    assert not len(simhash.near_pairs(fps[:512], fps[512:], 3)) and min(left) < 0.5


def near_corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(150)) for _ in range(12)]
    rows = [(i, t, "x") for i, t in enumerate(base)]
    for i in range(60):
        words = base[i % 4].split()
        words[rng.randrange(150)] = word()
        rows.append((100 + i, " ".join(words), "y"))
    rows += [(300 + i, base[0].upper(), None) for i in range(5)]
    linked = base[7].split()
    rows += [(None, " ".join(linked[:149] + ["other"]), None)]
    rows += [(400, None, None), (401, "", None), (402, " \n", None), (403, "one two", None), (403, "one two", None), (None, "one two", None), (None, "lonely words here", None)]
    return rows


def test_near_duplicates(spark, monkeypatch):
    rows = near_corpus()
    monkeypatch.setattr(simhash, "TILE", 8)  # blocks are cut into tiles
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    root = brute_components(fps)
    least = {}
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, "%016x" % f, least.get(r)) for (i, _, _), f, r in zip(rows, fps, root)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    three = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), agree=3).collect()
    assert sorted((tuple(r) for r in three), key=str) == want
    kept = [r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({c for _, _, c in want if c is not None}) and kept.count(None) == 3


def test_a_row_without_an_id_links(spark, monkeypatch):
    """Two documents that only meet over a row without an id are one component."""
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.select("doc_id", F.expr("CASE text WHEN 'a' THEN 0L WHEN 'b' THEN 7L ELSE 63L END").alias("fp")))
    rows = [(1, "a", None), (None, "b", None), (3, "c", None)]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (None, 1), (3, 1)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert suffixes.repeat_report(empty).count() == 0


def brute_repeats(rows):
    first = {}
    for i, text, _ in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49) if i is not None else ():
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], i), i)
    out = []
    for i, text, _ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49) if i is not None else ():
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def repeat_corpus():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [some(n) for n in (49, 50, 51, 90, 400)]
    rows = [(i, some(rng.randint(0, 60)) + rng.choice(passages) + some(rng.randint(0, 60)) + rng.choice(passages), "x") for i in range(80, 0, -1)]
    rows += [(200 + i, rows[0][1], None) for i in range(4)] + [(7, rows[3][1], None), (7, rows[3][1], None), (300, "a" * 200, None), (301, "b" + "a" * 120, None), (302, None, None), (303, "", None), (None, rows[0][1], None), (304, passages[4][100:149], None), (305, passages[4][100:150], None)]
    return rows


@pytest.mark.parametrize("hot", [10**9, 5])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_LEAST", hot)
    rows = repeat_corpus()
    got = suffixes.repeat_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


def test_repeats_cut_keeps_columns(spark):
    rows = [(1, "é" * 60, "x"), (2, "zz" + "é" * 60, "y")]
    made = suffixes.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert made.columns == ["doc_id", "text", "lang"]
    assert sorted(map(tuple, made.collect())) == [(1, "é" * 60, "x"), (2, "zz", "y")]


def test_very_long_texts_and_odd_columns(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, passage, "x"), (2, "before " + passage[1000:400_000] + " after", "y"), (3, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"my col": F.lit(1), "a.b": F.lit("z"), "tick`s": F.array(F.lit(2)), "rest": F.lit(0), "kept": F.lit(0)})
    made = suffixes.keep_first(docs)
    assert made.columns == docs.columns
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[1]["text"] == passage and got[2]["text"] == "before  after" and got[3]["text"] == "" and got[2]["my col"] == 1 and got[2]["a.b"] == "z" and got[2]["tick`s"] == [2]


def test_prefix_classes_are_exact():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 900)
    text[-1] = 0
    order, group = suffixes.prefix_classes(text, 7)
    key = [tuple(text[i : i + 7]) for i in order]
    for a in range(1, len(order)):
        if len(key[a]) == 7 == len(key[a - 1]) and 0 not in key[a] + key[a - 1]:
            assert (group[a] == group[a - 1]) == (key[a] == key[a - 1])


def test_equal_windows_pick_equal_anchors():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 3, 80).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(0, 3, n).astype(np.uint8), shared, rng.integers(0, 3, n).astype(np.uint8)]) for n in (33, 71))
    pa, pb = suffixes.picks(a)[0], suffixes.picks(b)[0]
    assert (pa[33 : 33 + 31] - 33 == pb[71 : 71 + 31] - 71).all()
