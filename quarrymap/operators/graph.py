"""One-hop neighbourhoods of the edge table, read in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other) for each edge from both ends, the edges read once."""
    ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other")))
    return edges.select(F.explode(ends).alias("e")).select("e.node", "e.other")


def incident(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges that touch a target (path), those between two targets once."""
    ends = targets.select(F.col("path").alias("end_path")).distinct()
    each = edges.select(*edges.columns, F.explode(F.array("source", "target")).alias("either_end"))
    return each.join(ends, F.col("either_end") == F.col("end_path"), "left_semi").drop("either_end").distinct()


def neighbours(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, neighbour): the distinct files one edge away from each target."""
    ends = targets.select("path").distinct()
    return undirected(edges).join(ends, F.col("node") == F.col("path")).select("path", F.col("other").alias("neighbour")).distinct()


def connected(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(path) of the neighbours of all targets that are no targets themselves."""
    near = neighbours(edges, targets).select(F.col("neighbour").alias("near_path")).distinct()
    return near.join(targets.select("path"), F.col("near_path") == F.col("path"), "left_anti").select(F.col("near_path").alias("path"))
