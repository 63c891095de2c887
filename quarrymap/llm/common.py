"""Helpers the operators share: tables, staged results, Arrow texts, schemas of any column names."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

#: Labels of rows with this remainder are held out; no operator learns from them.
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 3, 1


#: Rows whose texts are Python objects at the same time.
ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables under ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


# --- staged results -------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where a session that runs in one process has none (tests), one is set; on a
    cluster there is no folder to guess, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "quarrymap-checkpoints")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_STAGED: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session is gone: whoever owns the folder clears it
        pass


@atexit.register
def _delete_all() -> None:
    for path, spark in _STAGED.items():
        _delete(spark, path)


_CLEAN, _LOCK = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", threading.Lock()
_WRITING: dict[str, list] = {}


@contextmanager
def _shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """While writes of the session run, their shuffle files go when they end; the last write puts the setting back."""
    key = spark.sparkContext.applicationId + str(id(spark._jsparkSession))
    with _LOCK:
        held = _WRITING.setdefault(key, [0, spark.conf.get(_CLEAN, "false")])
        held[0] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(_CLEAN, held[1])
                del _WRITING[key]


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation. The
    files go with ``forget``, or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarrymap-{uuid.uuid4().hex}/{name}"
    with _shuffle_files_dropped(spark):
        df.write.options(**options).parquet(path)
    _STAGED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrymap_staged = path
    return out


def forget(*staged: DataFrame) -> None:
    """Delete the files of staged results that nothing reads any more."""
    for df in staged:
        path = getattr(df, "_quarrymap_staged", None)
        if path in _STAGED:
            _delete(_STAGED.pop(path), path)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages now."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


# --- labels ---------------------------------------------------------------------


def held_out(doc_id):
    """True for rows whose labels may only be used to measure."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_MODULUS)) == HELD_OUT_REMAINDER


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from, one a document.

    Null ids and labels are left out; of repeated rows the larger label counts.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max((F.col(column) > 0).cast("int")).alias("y"))
    )


# --- Arrow ----------------------------------------------------------------------


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows: what is made of their texts is held for one slice only."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def release() -> None:
    """At the end of a task: return freed memory to the system, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def nullable(kind: pa.DataType) -> pa.DataType:
    """The Arrow type with nulls allowed at every level."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(nullable(kind.value_type))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, nullable(kind.item_type))
    return kind


def loose(kind: DataType) -> DataType:
    """The Spark type with nulls allowed at every level: what Arrow functions return."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, loose(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(loose(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(loose(kind.keyType), loose(kind.valueType))
    return kind


def schema_of(df: DataFrame, keep: list[str], more: str) -> StructType:
    """The columns ``keep`` of ``df``, of any names, and those that ``more`` declares."""
    return StructType([StructField(c, loose(df.schema[c].dataType)) for c in keep] + StructType.fromDDL(more).fields)


def _loose(column: pa.Array) -> pa.Array:
    kind = nullable(column.type)
    return column if kind == column.type else column.cast(kind)


def map_columns(
    df: DataFrame, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], keep: list[str], schema: str, finish: Callable[[], None] | None = None
) -> DataFrame:
    """Add the columns ``compute`` makes to ``keep``; row for row, no shuffle, ``ROWS`` rows of an Arrow batch at a time.

    ``finish`` is called at the end of each task, to drop what ``compute`` kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in sliced(batches):
                made = compute(batch)
                yield pa.RecordBatch.from_arrays([_loose(batch.column(c)) for c in keep] + list(made.values()), names=keep + list(made))
        finally:
            if finish:
                finish()
            release()

    return df.mapInArrow(run, schema_of(df, keep, schema))


def column_of(compute: Callable[[pa.Array], pa.Array], kind: str, finish: Callable[[], None] | None = None) -> Callable[[Column], Column]:
    """A column made of another, ``ROWS`` values at a time: only that column goes to Python, the rest of a row stays in the JVM."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for values in batches:
                yield pa.concat_arrays([compute(values.slice(at, ROWS)) for at in range(0, max(1, len(values)), ROWS)])
        finally:
            if finish:
                finish()
            release()

    return lambda column: F.arrow_udf(run, kind)(column)
