"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

One pass turns every text into a fixed set of statistics (staged: a few dozen
numbers a document). Random Fourier features of the standardised statistics
approximate a Gaussian kernel; every partition adds up its part of the normal
equations where its rows lie, the parts are summed per row of the matrix, and
one small system is solved. A histogram of the raw scores, again summed over all
labelled rows, gives the isotonic fit. All usable labels count: nothing is
sampled, and what reaches the driver has a fixed size.

Defined results: a null or empty text has the statistics of no words and is
scored like any other; repeated rows are scored each, and each counts in the fit;
with no usable labels, or labels of one kind only, every score is the share of
label 1 (1 if there are none); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, column_of, held_out, labelled, map_columns, release, stage


@dataclass(frozen=True)
class QualityParams:
    features: int = 256
    bandwidth: float = 4.0
    ridge: float = 1e-2
    #: Parts of a matrix row that are summed together first, by this many groups of partitions.
    groups: int = 64
    bins: int = 1000
    threshold: float = 0.5
    seed: int = 11


#: Character classes counted by byte value.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~=+_\\",
    "pipe": b"|",
    "bang": b"!?",
    "stop": b".,;:",
    "bracket": b"()[]{}\"'/-",
    "newline": b"\n",
    "space": b" \t",
    "wide": bytes(range(128, 256)),
}
_MATRIX = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _MATRIX[list(_bytes), _i] = 1
STATISTICS = [*_CLASSES, "log_words", "mean_word", "sd_word", "distinct", "top_word", "top3_words", "distinct_pairs", "caps_words", "words_a_line", "distinct_lines", "long_words"]


def statistics(text: bytes) -> list[float]:
    """Document statistics of one whole text, all of them finite."""
    size = len(text)
    by_class = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MATRIX / max(1, size)
    words = text.split()
    n = len(words)
    if not n:
        return [*by_class.tolist(), 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0]
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = counts.most_common(3)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        *by_class.tolist(),
        math.log1p(n),
        min(60.0, float(lengths.mean())),
        min(60.0, float(lengths.std())),
        len(counts) / n,
        top[0][1] / n,
        sum(c for _, c in top) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        sum(map(bytes.isupper, words)) / n,
        math.log1p(n / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        float((lengths > 30).mean()),
    ]


#: A column of statistics of a text column, and of scores of a column of statistics.
STATS = "__quarrymap_statistics"
statistics_of = column_of(lambda texts: pa.array([statistics(t) for t in byte_texts(texts)], pa.list_(pa.float64())), "array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    sd: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    #: Calibration: raw scores and the share of label 1 there, both rising.
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -8, 8)
        out = np.cos(z @ self.omega + self.phase) * math.sqrt(2 / len(self.phase))
        return np.hstack([out, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def isotonic(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: rising shares of ``positive`` in ``weight``, one for each bin."""
    blocks: list[list[float]] = []
    for w, s in zip(weight, positive):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in blocks]) if blocks else np.empty(0)


def fit(rows: DataFrame, p: QualityParams = QualityParams()) -> QualityModel:
    """Fit on all of ``rows`` (stats, y)."""
    width = len(STATISTICS)
    each = [F.get("stats", F.lit(i)) for i in range(width)]
    first = rows.select(
        F.count("*").alias("n"), F.sum("y").alias("s"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(each)]
    ).collect()[0]
    n, positive = first["n"], first["s"] or 0
    rng = np.random.default_rng(p.seed)
    omega, phase = rng.normal(0, 1 / p.bandwidth, (width, p.features)), rng.uniform(0, 2 * math.pi, p.features)
    if n == 0 or positive in (0, n):
        level = np.full(1, positive / n if n else 1.0)
        return QualityModel(np.zeros(width), np.ones(width), omega, phase, np.zeros(p.features + 1), np.zeros(1), level)
    mean = np.array([first[f"m{i}"] for i in range(width)])
    sd = np.maximum([first[f"d{i}"] for i in range(width)], 1e-6)
    model = QualityModel(mean, sd, omega, phase, np.zeros(p.features + 1), np.zeros(1), np.zeros(1))
    size = p.features + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        seen = 0
        for batch in batches:
            x = model.features(_matrix(batch.column("stats"), width))
            gram += x.T @ x
            right += x.T @ np.asarray(batch.column("y"), float)
            seen += len(batch)
        release()
        if not seen:
            return
        # one row of the matrix a record, with its part of the right side at the end
        both = np.hstack([gram, right[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array([b.tobytes() for b in both], pa.binary())], names=["row", "part"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, float) for b in group.column("part").to_pylist())
        return pa.table({"row": group.column("row").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("stats", "y").mapInArrow(partial, "row int, part binary")
    some = parts.groupBy("row", F.pmod(F.spark_partition_id(), F.lit(p.groups))).applyInArrow(lambda _, g: added(g), "row int, part binary")
    system = some.groupBy("row").applyInArrow(added, "row int, part binary").orderBy("row").toArrow()
    both = np.stack([np.frombuffer(b, float) for b in system.column("part").to_pylist()])
    penalty = p.ridge * n / size * np.eye(size)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(both[:, :-1] + penalty, both[:, -1])

    low, high, bins = -0.5, 1.5, p.bins

    def binned(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        raw = model.raw(_matrix(batch.column("stats"), width))
        return {"bin": pa.array(np.clip((raw - low) / (high - low) * bins, 0, bins - 1).astype(np.int32))}

    histogram = map_columns(rows.select("stats", "y"), binned, ["y"], "bin int").groupBy("bin").agg(F.count("*").alias("w"), F.sum("y").alias("s")).orderBy("bin").collect()
    weight, share = np.array([r["w"] for r in histogram], float), np.array([r["s"] for r in histogram], float)
    model.knots = low + (np.array([r["bin"] for r in histogram]) + 0.5) * (high - low) / bins
    model.levels = isotonic(weight, share)
    # a little of the raw score keeps the order within a pooled block
    model.levels = 0.995 * model.levels + 0.005 * (model.knots - low) / (high - low)
    return model


def _fitted(staged: DataFrame, labels: DataFrame, p: QualityParams) -> QualityModel:
    """The model of all labelled rows of (doc_id, statistics, ...)."""
    stats = staged.select("doc_id", F.col(STATS).alias("stats"))
    return fit(stage(stats.join(labelled(labels, "quality"), "doc_id").select("stats", "y"), "quality-labelled"), p)


def _scores(model: QualityModel):
    width = len(STATISTICS)
    return column_of(lambda stats: pa.array(model.score(_matrix(stats, width)), pa.float64()), "double")


def quality(documents: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    staged = stage(documents.select("doc_id", statistics_of("text").alias(STATS)), "quality-statistics")
    scored = staged.select("doc_id", _scores(_fitted(staged, labels, p))(STATS).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The documents, columns as they were, without those predicted bad: only texts, then statistics, go to Python."""
    staged = stage(documents.withColumn(STATS, statistics_of("text")), "quality-statistics")
    return staged.where(_scores(_fitted(staged, labels, p))(STATS) >= p.threshold).drop(STATS)
