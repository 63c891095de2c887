"""What changed between a stored snapshot and the files now, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status: added | changed | unchanged | deleted) from (path, content_hash) of either side."""
    a = old.select(F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash"))
    b = new.select("path", F.col("content_hash").alias("new_hash"))
    status = (
        F.when(F.col("old_path").isNull(), F.lit("added"))
        .when(F.col("path").isNull(), F.lit("deleted"))
        .when(F.col("old_hash") == F.col("new_hash"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return b.join(a, F.col("path") == F.col("old_path"), "full").select(F.coalesce("path", "old_path").alias("path"), status.alias("status"))


def to_process(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose content is new under their path: an anti join, nothing of ``old`` is carried."""
    return new.join(old.select(F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash")), (F.col("path") == F.col("old_path")) & (F.col("content_hash") == F.col("old_hash")), "left_anti")


def deleted(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("path").join(new.select(F.col("path").alias("new_path")), F.col("path") == F.col("new_path"), "left_anti")


def change_ratio(status: DataFrame) -> DataFrame:
    """(to_process, files, ratio) of the files there are now."""
    now = status.where("status <> 'deleted'")
    return now.agg(F.count_if(F.col("status") != "unchanged").alias("to_process"), F.count("*").alias("files")).withColumn("ratio", F.col("to_process") / F.greatest(F.lit(1), F.col("files")))
