"""Ids equal the libraries', packing is gapless, giant texts scan exactly."""

import random
import zlib

import numpy as np
import pytest

from quarrymap.llm import packing, pieces, tokens

TEXTS = ["", " ", "\n", "a  b", "it's  John's 5 ½ ²³ ªº µ _x_ __ <|endoftext|> x", "İstanbul ΣΑΣ", "日本語 テキスト🙂", "a\x00b", "x y", "é", "ÀÉ ß ÿ Ÿ", "\ta\n\nb ", "a _b_ c__d 12ab34 $$%% ab$c", "don't 'll 'S", "€uro", "▁▁a▁", "x" * 300, "Word " * 500, "the quick brown fox, jumped over 2 lazy dogs!\nÜber Straße"]


@pytest.fixture(scope="module")
def word():
    return tokens.word_bpe(tokens.tokenizer_file("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def piece():
    return tokens.piece_bpe(tokens.tokenizer_file("piece_bpe_32k.model"))


def test_word_ids(word):
    for t in TEXTS + TEXTS:
        assert np.frombuffer(word.encode(t), "<u2").tolist() == word.library.encode(t, add_special_tokens=False).ids, t


def test_piece_ids(piece):
    for t in TEXTS:
        ids = piece.encode(t)
        assert np.frombuffer(ids, "<u2").tolist() == piece.library.encode(t), t
        assert piece.decode(ids) == piece.library.decode(piece.library.encode(t)), t


@pytest.mark.parametrize("chunk", [5, 16, 33])
def test_scan_is_exact(piece, chunk):
    seg, rng = pieces.Segmenter(piece), random.Random(chunk)
    texts = [t for t in TEXTS if len(t) > chunk] + ["internationalization" * 6, "".join(rng.choice("ab c\n") for _ in range(200)), " " * 80 + "y"]
    for t in texts:
        shown = " " + t.replace("▁", " ")
        n = -(-len(shown) // chunk)
        paths = []
        for i in range(n):
            low = max(0, i * chunk - pieces.AROUND)
            paths.append(pieces.ChunkPaths(seg, shown[low : (i + 1) * chunk + pieces.AROUND], i * chunk - low, min(len(shown), (i + 1) * chunk) - low, i == 0, i == n - 1))
        states = pieces.border_states([p.matrix() for p in paths])
        ids = [i for p, a, b in zip(paths, states, states[1:]) for i in p.backtrace(a, b)]
        assert ids == piece.library.encode(t), t


def test_combination_is_associative():
    a, b, c = {("s", 1): 0.0, ("s", 2): -1.0}, {(1, 3): -2.0, (2, 3): 0.0}, {(3, 4): 0.5}
    assert pieces.combined(pieces.combined(a, b), c) == pieces.combined(a, pieces.combined(b, c)) == {("s", 4): -0.5}


def test_a_text_of_many_real_chunks(spark, piece, monkeypatch):
    """Over the real chunk size, in several segments of the scan, without a space for a chunk and more."""
    monkeypatch.setattr(pieces, "SEGMENT", 2)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(14_000)), "x" * 16_384, "ab" * 8_191 + " c", "".join(word() for _ in range(4_000)), " ".join(word() for _ in range(3_270))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    got = pieces.decode(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    for i, t in enumerate(texts):
        own = sorted({(r["chunk"], bytes(r["ids"]), r["text"]) for r in got if r["doc_id"] == i})
        assert [x for _, ids, _ in own for x in np.frombuffer(ids, "<u2").tolist()] == piece.library.encode(t) and "".join(x for _, _, x in own) == " " + t
    assert max(r["chunk"] for r in got) >= 3
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0 == pieces.report(spark.createDataFrame([], "doc_id long, text string")).count()


def test_encoded_documents(spark, piece):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (50, None), (51, "word " * 90 + "<"), (51, "word " * 90 + "<")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pieces.decode(pieces.encode(docs, chunk=40)).orderBy("doc_id", "chunk").collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], {}).setdefault(r["chunk"], r)
    for i, t in rows:
        parts = [by_id[i][k] for k in sorted(by_id[i])]
        assert [x for p in parts for x in np.frombuffer(p["ids"], "<u2").tolist()] == piece.library.encode(t or "")
        assert "".join(p["text"] for p in parts) == ((" " + t.replace("▁", " ")) if t else "")
    report = pieces.report(docs, chunk=40).collect()
    assert len(report) == len(got) and all(r["round_trip"] for r in report)


def test_packing(spark, word):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (60, "many words " * 3000), (60, "many words " * 3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=64).collect()
    at = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in got)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    assert all(r["offset"] + r["length"] <= 64 for r in got)
    for i, t in rows:
        want = word.library.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        if i == 60:
            assert sum(r["length"] for r in own) == 2 * len(want)
            continue
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(want)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
