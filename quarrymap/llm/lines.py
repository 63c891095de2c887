"""Quality rules: cross-document line frequency, after base rules on each text.

Lines are normalised (lower case, white space runs to one space) and hashed. A
host's distinct documents (doc_ids) are counted for each line hash. A line that
more than ``max_share`` of the other documents of its host hold too is
boilerplate and removed; a document left with less than ``min_left`` of its
words, or with fewer than ``min_words``, is depleted and rejected. The limit is a
share of the others, so it means the same for a host of any size, and a line
that no other document has always stays.

A host's lines above the limit are at most (lines a document) / ``max_share``:
a small table, joined by Spark's own choice of join.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; rows that repeat a doc_id are one document when
documents are counted (a row without an id is one by itself), and each is
returned with its own verdict; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, map_columns, stage


@dataclass(frozen=True)
class LineRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_share: float = 0.10
    min_left: float = 0.30


_SYMBOLS = re.compile(rb"[#*$%&|<>]")


def base_counts(text: bytes, window: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - (len(text) - sum(map(len, words)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = 0
    if n >= window:
        grams = list(zip(*(words[i:] for i in range(window))))
        counts = Counter(grams)
        if len(counts) < len(grams):
            reach = 0  # words covered so far end here
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeats += i + window - max(reach, i)
                    reach = i + window
    return n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats


def line_words(text: bytes) -> dict[int, int]:
    """Words under each distinct normalised line, by its signed 64-bit hash."""
    out: dict[int, int] = {}
    for line in text.decode("utf-8", "replace").lower().encode().split(b"\n"):
        words = line.split()
        if words:
            h = xxhash.xxh64_intdigest(b" ".join(words))
            h -= (h >> 63) << 64
            out[h] = out.get(h, 0) + len(words)
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(documents: DataFrame, host: str = "source", rules: LineRules = LineRules()) -> DataFrame:
    """One row a document: the base counts, words in boilerplate lines, and the verdict."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = byte_texts(batch.column("text"))
        counts = list(zip(*(base_counts(t, rules.window) for t in texts))) or [()] * 5
        lines = [line_words(t) for t in texts]
        return {c: pa.array(v, pa.int64()) for c, v in zip(_COUNTS, counts)} | {
            "lines": pa.array([list(x) for x in lines], pa.list_(pa.int64())),
            "line_words": pa.array([list(x.values()) for x in lines], pa.list_(pa.int32())),
        }

    schema = ", ".join(f"{c} bigint" for c in _COUNTS) + ", lines array<bigint>, line_words array<int>"
    texts = documents.select("doc_id", F.col(host).alias("host"), "text")
    staged = stage(map_columns(texts, run, ["doc_id", "host"], schema).withColumn("row", F.monotonically_increasing_id()), "line-rules", compression="zstd")

    held = (F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("held")
    each = staged.select("row", "doc_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "doc_id", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    hosts = staged.groupBy(F.col("host").alias("h_host")).agg(held.alias("documents"))
    others = F.col("held") - 1
    frequent = each.groupBy("host", "line").agg(held).where(others > 0)
    frequent = frequent.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).where(others > rules.max_share * (F.col("documents") - 1)).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    removed = each.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line"))).groupBy("row").agg(F.sum("words").alias("removed"))
    left = F.col("n_words") - F.col("removed_words")
    base_failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return (
        staged.drop("lines", "line_words")
        .join(removed.withColumnRenamed("row", "r_row"), F.col("row") == F.col("r_row"), "left")
        .withColumn("removed_words", F.coalesce("removed", F.lit(0)))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= rules.min_words) & (left >= rules.min_left * F.col("n_words")))
        .select("doc_id", *_COUNTS, "base_failed", "kept", "removed_words")
    )
