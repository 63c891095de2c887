"""Row numbers over a whole table in two passes, and results that are made once."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors share, with its scheme.

    Where a session that runs in one process has no such folder, one is set.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + os.path.join(tempfile.gettempdir(), "quarrymap-checkpoints"))
    return context.getCheckpointDir()


def made_once(rows: DataFrame) -> DataFrame:
    """The rows, written to the session's checkpoint folder: not computed again, whatever reads them."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... in ``order``, without bringing the rows to one task.

    Ranges are sorted where they lie; only the number of rows of each range
    reaches the driver, to tell it where the next one begins.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    held = made_once(dealt)
    part = F.shiftright("__place", 33)
    bases, total = [], 0
    for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        bases.append((r["part"], total))
        total += r["n"]
    base = F.broadcast(spark.createDataFrame(bases, "__part bigint, __base bigint"))  # one row a range
    return held.join(base, part == F.col("__part")).withColumn(name, F.col("__base") + F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place", "__part", "__base")
