"""Toxicity, quality and line rules: small fixtures, brute force and held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymap.llm import lines, quality, toxicity

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def corpus(n=600):
    rng = random.Random(2)
    syllables = ["an", "er", "in", "th", "on", "re", "st", "ou", "le", "wi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 200))]
        toxic, bad = rng.random() < 0.25, rng.random() < 0.3
        if bad:
            words = [w + rng.choice(["***", "%%%"]) for w in words]
        if toxic:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["vexgrum", "blorkid", "zukfaz"])
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad), int(toxic)))
    odd = [(9001, None, None), (9002, "", "s"), (None, "thing", "s"), (9003, "vexgrumm blorkidd " * 6, "s"), (9003, "vexgrumm blorkidd " * 6, "s")]
    return docs + odd, labels + [(None, 1, 1), (5, None, None), (9002, None, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t in labels if q is not None}


def test_toxicity(tables):
    docs, labels, truth = tables
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.95
    assert all(r["predicted"] == 1 for r in got if r["doc_id"] == 9003)  # never seen so spelt


def brute_bag(text, p):
    """Bucket -> share, word by word and n-gram by n-gram."""
    words = Counter(toxicity.word_of(w) for w in text.lower().encode().split())
    total, out = sum(words.values()), Counter()
    for word, count in words.items():
        marked = b"<" + word + b">"
        buckets = [zlib.crc32(marked) % p.buckets]
        for n in range(p.min_n, p.max_n + 1):
            for at in range(len(marked) - n + 1):
                h = n
                for c in marked[at : at + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) % (1 << 64)
                buckets.append((h >> 20) % p.buckets)
        for b in buckets:
            out[b] += count / len(buckets) / (total + p.padding)
    return out


def test_averaged_bags_and_scores():
    p, rng = toxicity.ToxicityParams(buckets=512), np.random.default_rng(1)
    model = toxicity.ToxicityModel(rng.normal(0, 9, 512), 0.3, p)
    for text in ("", "a", "one two, two THREE! é", "word " * 5000 + "x"):
        buckets, shares = toxicity.averaged(text.encode(), p)
        want = brute_bag(text, p)
        assert dict(zip(buckets.tolist(), shares.tolist())) == pytest.approx(want, rel=1e-5)
        odds = 0.3 + sum(model.bucket_odds[b] * s for b, s in want.items())
        assert model.scores([text.encode()], {})[0] == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-9)


def test_slopes_are_those_of_the_loss():
    """The joint slopes of vectors and softmax weights against differences of the loss itself."""
    rng = np.random.default_rng(2)
    mean, vectors, soft, bias = rng.random((6, 5)), rng.normal(0, 1, (5, 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2)
    y, cost = np.array([0, 1, 1, 0, 1, 0]), rng.random(6)

    def loss(vectors, soft, bias):
        z = mean @ vectors @ soft + bias
        return float((cost * (np.log(np.exp(z).sum(1)) - z[np.arange(6), y])).sum())

    wrong, hidden = toxicity.slopes(mean, vectors, soft, bias, y, cost)
    for k, slope in enumerate((mean.T @ (wrong @ soft.T), hidden.T @ wrong, wrong.sum(0))):
        for at in np.ndindex(slope.shape):
            ends = []
            for d in (1e-6, -1e-6):
                own = [vectors.copy(), soft.copy(), bias.copy()]
                own[k][at] += d
                ends.append(loss(*own))
            assert slope[at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5)


def test_rare_words_keep_their_vectors():
    """A toxic word in 2 % of the sample is caught, one in 0.5 % stands far above plain texts, and so do spellings that were never seen."""
    p, rng = toxicity.ToxicityParams(), random.Random(3)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    with_word = lambda word: [(plain() + f" {word}" * 2).encode() for _ in range(40)]
    texts = [(plain(), 0) for _ in range(500)] + [(t.decode(), 1) for word, n in (("grombulated", 12), ("quixelorn", 3), ("vexatious", 85)) for t in (with_word(word) + with_word(word) + with_word(word))[:n]]
    model = toxicity.train([toxicity.averaged(t.encode(), p) for t, _ in texts], np.array([y for _, y in texts]), 100 / 600, p)
    score = lambda word: model.scores(with_word(word), {})
    clean = model.scores([plain().encode() for _ in range(200)], {})
    assert (clean < p.threshold).all() and (score("vexatiouss") >= p.threshold).all()
    assert (score("grombulated") >= p.threshold).mean() > 0.5 and np.median(score("grombulatedd")) > 30 * clean.max()
    assert np.median(score("quixelorn")) > 10 * clean.max() and np.median(score("quixelornn")) > 5 * clean.max()


def test_repeated_rows_and_empty_tables_of_toxicity(spark, tables):
    docs, labels, _ = tables
    again = docs.union(docs.where("doc_id < 100")).union(docs.where("doc_id < 50").withColumn("text", F.concat("text", F.lit(" zz"))))
    a, b = (toxicity.fit(x, labels) for x in (docs, again))
    assert a.bias == b.bias and (a.bucket_odds == b.bucket_odds).all()
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), labels).count() == 0
    assert toxicity.keep_clean(spark.createDataFrame([], DOCS), labels).count() == 0


def test_toxicity_without_labels(spark, tables):
    none = spark.createDataFrame([], LABELS)
    assert all(r["score"] < 0.01 for r in toxicity.toxicity(tables[0].limit(20), none).collect())


def test_held_out_labels_do_not_matter(spark, tables):
    docs, labels, _ = tables
    from quarrymap.llm.common import held_out
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality(spark, tables):
    docs, labels, truth = tables
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in held]) > 0.95
    one_kind = quality.quality(docs.limit(10), spark.createDataFrame([(i, 1, 0) for i in range(10)], LABELS)).collect()
    assert all(r["score"] == 1 for r in one_kind)
    assert quality.quality(spark.createDataFrame([], DOCS), labels).count() == 0


def test_isotonic():
    got = quality.isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert got.tolist() == [0, 0.5, 0.5, 1]


def test_the_fit_is_the_direct_solution(spark, tables):
    """Weights against a least-squares solution over all rows at once, levels against isotonic means by definition."""
    docs, labels, truth = tables
    p = quality.QualityParams()
    rows = [(quality.statistics((t or "").encode()), truth[i][0]) for i, t, _ in docs.collect() if i in truth]
    model = quality.fit(spark.createDataFrame(rows, "stats array<double>, y int").repartition(5), p)
    stats, y = np.array([s for s, _ in rows]), np.array([y for _, y in rows], float)
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.sd, np.maximum(stats.std(0), 1e-6))
    x = model.features(stats)
    free = np.sqrt(p.ridge * len(y) / x.shape[1]) * np.eye(x.shape[1])
    free[-1, -1] = 0
    direct = np.linalg.lstsq(np.vstack([x, free]), np.concatenate([y, np.zeros(x.shape[1])]), rcond=None)[0]
    assert np.allclose(x @ model.weights, x @ direct, atol=1e-6)
    bins = np.clip((model.raw(stats) + 0.5) / 2 * p.bins, 0, p.bins - 1).astype(int)
    used = np.unique(bins)
    weight, share = np.array([(bins == b).sum() for b in used], float), np.array([y[bins == b].sum() for b in used])
    mean = lambda a, b: share[a : b + 1].sum() / weight[a : b + 1].sum()
    n = len(used)
    want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]  # the least of the greatest means
    assert np.allclose(model.knots, -0.5 + (used + 0.5) * 2 / p.bins) and np.allclose((model.levels - 0.005 * (model.knots + 0.5) / 2) / 0.995, want)


def test_statistics_of_odd_and_very_long_texts(spark, tables):
    texts = ["", " ", "a", "A B\nc", "é " * 9, "word and more\n" * 100_000]
    assert all(len(s) == len(quality.STATISTICS) and np.isfinite(s).all() for s in map(quality.statistics, map(str.encode, texts)))
    got = quality.quality(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS), tables[1]).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(spark.createDataFrame([], DOCS), tables[1]).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines_ = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines_) - len(set(lines_)), len(covered)


def test_base_counts():
    rng = random.Random(7)
    texts = ["", "\n\n", "a b c d e a b c d e", "x " * 12, "é ü #*\nline\nline\n line"] + [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    for t in texts:
        assert lines.base_counts(t.encode(), 5) == brute_base(t), t


def brute_lines(rows, p=lines.LineRules()):
    """The verdicts by counting documents, host by host and line by line."""
    key = lambda k, i: ("row", k) if i is None else i
    normal = lambda text: [" ".join(w) for x in (text or "").lower().split("\n") if (w := re.findall(r"[^\x20\x09-\x0D]+", x))]
    holders, documents, out = {}, {}, []
    for k, (i, text, host) in enumerate(rows):
        documents.setdefault(host, set()).add(key(k, i))
        for line in normal(text):
            holders.setdefault((host, line), set()).add(key(k, i))
    for i, text, host in rows:
        n, *rest = brute_base(text or "")
        removed = sum(len(x.split(" ")) for x in normal(text) if (held := len(holders[host, x])) > 1 and held - 1 > p.max_share * (len(documents[host]) - 1))
        failed = n < 10 or 100 * rest[-1] > 20 * n
        out.append((i, n, *rest, failed, not failed and n - removed >= 10 and n - removed >= 0.3 * n, removed))
    return sorted(out, key=str)


def test_line_frequency(spark):
    text = lambda i, n=4: "\n".join(" ".join(f"{w}{i}x{k}" for w in ("own", "line", "of", "many", "words")) for k in range(n))
    rows = [(i, "Shared  footer line\n" + text(i) if i % 2 else text(i), "h" if i % 3 else "g") for i in range(300)]
    boiler = "a boilerplate line of ten words that stands in many documents"
    rows += [(1000 + i, "\n".join([boiler, "shared footer line", f"tail{i} here{i}"]), "h") for i in range(60)]
    rows += [(5000, None, "h"), (5001, "", None), (5002, text(5002), None), (5003, text(5003), None)]
    rows += [(6000, text(6000), "h")] * 90  # one document, however often it is repeated
    rows += [(None, text(6001), "t")] * 3 + [(6002, text(6002), "t")] + [(6003, text(6004), "u"), (6003, text(6005), "u"), (6004, text(6004), "u")]
    rows += [(7000, "very long line of words\n" * 60_000 + text(7000), "v")]
    got = lines.quality_rules(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[1]["kept"] and by_id[1]["removed_words"] == 3 and by_id[2]["removed_words"] == 0
    assert not by_id[1000]["kept"] and not by_id[1000]["base_failed"] and by_id[1000]["removed_words"] == len(boiler.split()) + 3
    assert by_id[6000]["kept"] and by_id[6000]["removed_words"] == 0 and not by_id[5000]["kept"] and by_id[5002]["kept"]
    assert lines.quality_rules(spark.createDataFrame([], DOCS)).count() == 0
