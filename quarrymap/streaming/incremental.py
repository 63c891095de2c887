"""Extension: an index kept up to date by a stream of file versions.

Each micro-batch of (path, content, file_type, category, size_bytes, version) is
reduced to the newest version of each path, compared with the stored snapshot by
content hash, and written as a new snapshot generation; the generation is named
only when it is whole, so a batch that runs again does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymap.operators import diff, extract

_KEPT = ["path", "file_type", "category", "content_hash", "line_count", "exports", "version"]


def newest(versions: DataFrame) -> DataFrame:
    """One row a path, the one of the highest version."""
    names = [c for c in versions.columns if c != "path"]
    return versions.groupBy("path").agg(F.max_by(F.struct(*names), "version").alias("row")).select("path", *[F.col(f"row.{c}").alias(c) for c in names])


def merged(snapshot: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the new snapshot, what the batch changed: path and status)."""
    rows = extract.analysed(newest(batch).withColumnRenamed("path", "relative_path")).withColumnRenamed("relative_path", "path").select(*_KEPT)
    if snapshot is None:
        return rows, rows.select("path", F.lit("added").alias("status"))
    status = diff.compared(snapshot, rows).where("status IN ('added', 'changed')")
    return snapshot.join(rows.select(F.col("path").alias("new_path")), F.col("path") == F.col("new_path"), "left_anti").unionByName(rows), status


def keep_indexed(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start the stream; snapshots are ``folder``/generation=N."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{folder}/generation={n - 1}") if n else None
        merged(old, batch)[0].write.mode("overwrite").parquet(f"{folder}/generation={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
