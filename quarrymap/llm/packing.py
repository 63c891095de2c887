"""Packing: concatenate all documents and cut fixed windows.

Pass one tokenizes every text once, in its own input partition, and stages the
ids with each document's token offset inside the partition. The partition
totals (one number each) are prefix-summed; pass two adds a partition's base
and cuts every document at the window boundaries. No shuffle, no sort, no
group: a hot source or a giant text is only its own tokens. Cut documents are
continued in the next sequence by a boundary record (``start`` > 0).

All sequences but the last hold exactly ``window`` tokens.

What reaches the driver is one number for each input partition.

Defined results: a null or empty text is the end token alone; repeated rows are
packed each; an empty table gives no rows; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, sliced, stage
from .tokens import tokenizer_file, word_bpe

WINDOW, END_ID = 2048, 1
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def tokenized(documents: DataFrame, file: str, end_id: int) -> DataFrame:
    """(doc_id, ids as uint16, tokens, first: tokens before it in its partition, place: partition and row)."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, so_far = word_bpe(file), 0
        try:
            for batch in sliced(batches):
                ids = [bpe.encode(t or "") + end for t in batch.column("text").to_pylist()]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
                first = so_far + np.cumsum(n) - n
                so_far += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array(first)], names=["doc_id", "ids", "tokens", "first"])
        finally:
            bpe.cache.clear()
            release()

    made = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary, tokens bigint, first bigint")
    return made.withColumn("place", F.shiftright(F.monotonically_increasing_id(), 33))


def pack(documents: DataFrame, window: int = WINDOW, end_id: int = END_ID, file: str | None = None) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, its ids and their checksum."""
    staged = stage(tokenized(documents, file or tokenizer_file("word_bpe_49k.json"), end_id), "packing-ids", compression="zstd")
    totals = staged.groupBy("place").agg(F.sum("tokens").alias("n")).orderBy("place").collect()  # one row an input partition
    ends = np.cumsum([r["n"] for r in totals])
    base = {r["place"]: int(e - r["n"]) for r, e in zip(totals, ends)}
    shared = documents.sparkSession.sparkContext.broadcast(base)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            doc, start, length, crc, total, seq, off, part = out = [[] for _ in range(8)]
            for d, raw, n, first, place in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "tokens", "first", "place"))):
                at, wide = shared.value[place] + first, np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                done = 0
                while done < n:
                    size = min(n - done, window - (at + done) % window)
                    doc.append(d), start.append(done), length.append(size), total.append(n)
                    crc.append(zlib.crc32(wide[4 * done : 4 * (done + size)]))
                    seq.append((at + done) // window), off.append((at + done) % window)
                    part.append(raw[2 * done : 2 * (done + size)])
                    done += size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:7]] + [pa.array(part, pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        release()

    return staged.mapInArrow(cut, _PIECES)
