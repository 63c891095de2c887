"""The corpus pipeline: toxic, bad, near-duplicate and repeated text goes, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all
but the last return the columns of ``documents``. Labels come from the tables
under ``sf_dir``. Stage results are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymap.llm import nearcopies, packing, quality, suffixes, toxicity
from quarrymap.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rows whose text is predicted toxic go. A null or empty text has the score of no words and stays as others do; repeated rows are judged each."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows whose text is predicted bad go. A null or empty text is scored by the statistics of no words; without labels all stay; repeated rows are judged each."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 at five words and a similarity of 0.8: one document of each group stays, the one with the smallest doc_id. Texts without words are one group; rows without an id stay; of rows equal in id and text one stays."""
    return nearcopies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: passages of 50 bytes or more that an earlier document holds are cut out; no row goes. A null text becomes empty; rows without an id are left alone."""
    return suffixes.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: all rows packed into sequences; a null or empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_bad),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: Trained models can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
