"""Near copies of the pipeline's stage against brute-force shingle similarity."""

import random

import numpy as np
import pytest

from quarrymap.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string, lang string"


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similarity(a, b):
    a, b = brute_set(a), brute_set(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("segment", "chunk"), [(1 << 16, 1 << 21), (7, 40)])
def test_sets_keys_and_fingerprints(monkeypatch, segment, chunk):
    monkeypatch.setattr(nearcopies, "SEGMENT", segment), monkeypatch.setattr(nearcopies, "CHUNK", chunk)
    rng = random.Random(4)
    texts = ["", " ", "a", "a b c d", "a b c d e", "A  b\tc d E f"] + [" ".join(rng.choice(["a", "bé", "ccc", "d"]) for _ in range(n)) for n in (5, 6, 11, 12, 13, 60, 300)]
    hashes, size = nearcopies.shingle_sets([t.encode() for t in texts])
    assert size.tolist() == [len(brute_set(t)) if t.split() else 0 for t in texts]
    ends = np.cumsum(size)
    sets = [hashes[e - n : e] for e, n in zip(ends, size)]
    for t, own in zip(texts, sets):
        assert (np.diff(own.astype(object)) > 0).all()
        for i in range(len(texts)):
            both = brute_set(t) & brute_set(texts[i]) if t.split() and texts[i].split() else set()
            assert len(np.intersect1d(own, sets[i])) == len(both)
    keys = nearcopies.band_keys(hashes, size)
    fps = nearcopies.fingerprints(hashes, size, chunk=16)
    for own, k, fp in zip(sets, keys, fps):
        assert len(k) == (nearcopies.BANDS if len(own) else 0)
        alone = np.array([len(own)])
        assert k == nearcopies.band_keys(own, alone)[0]
        wide = [int(x) for h in own for x in [int.from_bytes(nearcopies._mixed_bits(np.array([h], np.uint64)[:, None] * nearcopies._WORD).tobytes(), "little")]]
        want = sum(1 << b for b in range(nearcopies.BITS) if 2 * sum(w >> b & 1 for w in wide) > len(wide))
        assert int.from_bytes(fp.tobytes(), "little") == want


def test_similar_sets_are_within_the_radius():
    """Of pairs at a similarity of 0.8 and a little more none is further apart than the radius."""
    rng = np.random.default_rng(3)
    for n in (9, 45, 200, 900):
        common = rng.integers(0, 2**63, (200, n), dtype=np.uint64)
        more = rng.integers(0, 2**63, (200, 2, max(1, n // 8)), dtype=np.uint64)
        for c, (a, b) in zip(common, more):
            x, y = (nearcopies.fingerprints(np.sort(np.concatenate([c, o])), np.array([len(c) + len(o)]))[0].view(np.uint64) for o in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= nearcopies.RADIUS


def test_forest_spans_what_is_near():
    rng = np.random.default_rng(9)
    i, j = np.triu_indices(40, 1)
    keep = rng.random(len(i)) < 0.08
    i, j, root = i[keep], j[keep], np.arange(40) // 2
    a, b = nearcopies.spanning(i, j, rng.integers(0, 9, len(i)), root)
    whole = simhash.least_along(40, np.concatenate([i, np.arange(0, 40, 2)]), np.concatenate([j, np.arange(1, 40, 2)]))
    forest = simhash.least_along(40, np.concatenate([a, np.arange(0, 40, 2)]), np.concatenate([b, np.arange(1, 40, 2)]))
    assert (whole == forest).all() and len(a) == len(np.unique(root)) - len(np.unique(whole))


def test_similar_connects_what_is_similar():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**62, (4, 60))
    sets = np.empty(50, object)
    for k in range(50):
        fresh = rng.integers(0, 2**62, rng.integers(0, 9))
        sets[k] = np.unique(np.concatenate([base[k % 4][len(fresh) :], fresh]))
    n, root = np.array([len(x) for x in sets]), np.arange(50) // 2
    i, j = np.triu_indices(50, 1)
    near = [(a, b) for a, b in zip(i, j) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    pairs = np.arange(0, 50, 2)
    a, b = nearcopies.similar(i, j, n, root, sets, 80)
    want = simhash.least_along(50, np.concatenate([[x for x, _ in near], pairs]), np.concatenate([[y for _, y in near], pairs + 1]))
    got = simhash.least_along(50, np.concatenate([a, pairs]), np.concatenate([b, pairs + 1]))
    assert (want == got).all() and len(a) == 25 - len(np.unique(got)) and set(zip(a, b)) <= set(near)


def test_a_group_that_is_near_but_not_similar(spark, monkeypatch):
    """Hundreds of texts that differ by a little too much: decided in tiles of few sets, and all of them stay."""
    monkeypatch.setattr(nearcopies, "SIDE_BYTES", 9000)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base), None)]
    for i in range(1, 150):
        words = list(base)
        for at in rng.sample(range(2, 98), 5 if i < 140 else 1):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words), None))
    kept = [r["doc_id"] for r in nearcopies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kept) == brute_kept(rows) and len(kept) > 100


def planted():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(40):
        words = [word() for _ in range(rng.choice([40, 120, 400, 1500]))]
        rows.append((i, " ".join(words), "x"))
        for turn in range(3):
            copy, share = list(words), rng.uniform(0.0, 0.05)
            for _ in range(max(1, int(share * len(copy)))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 + 10 * i + turn, ("  " if turn else " ").join(copy).upper(), "y"))
    rows += [(900, None, None), (901, " \n", None), (902, "one two", None), (903, "One  two", None), (904, "one three", None)]
    return rows


def brute_kept(rows):
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a, _ in rows:
        for j, b, _ in rows:
            if j < i and similarity(a, b) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(i for i in root if find(i) == i)


def test_near_copies_go(spark):
    import corpus_pipeline

    rows = planted()
    near = [similarity(rows[4 * i][1], rows[4 * i + k][1]) for i in range(40) for k in (1, 2, 3)]
    assert sum(0.8 <= s < 0.95 for s in near) > 30 and sum(s < 0.8 for s in near) > 20
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted(r["doc_id"] for r in got.collect()) == brute_kept(rows)


def test_a_large_group_and_a_chain(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):  # each differs from the one before in a word: the ends are far apart
        words = list(words)
        words[5 * i] = f"new{i}"
        rows.append((i, " ".join(words), None))
    rng.shuffle(rows)
    assert similarity(min(rows)[1], max(rows)[1]) < 0.8
    assert [r["doc_id"] for r in nearcopies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f", "x"), (5, "A b c d e f", "x"), (5, "q r s t u v", "x"), (5, "q r s t u v", "y"), (None, "a b c d e f", None)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in nearcopies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "a b c d e f"), (1, "a b c d e f"), (5, "q r s t u v")]
    assert nearcopies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
