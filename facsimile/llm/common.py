"""What the operators of this subpackage share: row keys, stored steps, text buffers."""

from __future__ import annotations

import gc
from contextlib import contextmanager
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.session import scratch_path, settle

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def gc_paused() -> Iterator[None]:
    """No search for reference cycles inside: strings and bytes have none, and large tables of them are slow to walk."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when each job has ended."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files go at once."""
    with _shuffles_dropped(df.sparkSession):
        return settle(df, purpose)


class Stored:
    """A step's result in the shared folder, to be dropped when a later step has been stored."""

    def __init__(self, df: DataFrame, purpose: str) -> None:
        self.path = scratch_path(df.sparkSession, purpose)
        with _shuffles_dropped(df.sparkSession):
            self.df = settle(df, purpose, self.path)

    def drop(self) -> None:
        context = self.df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(rows: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow`` over batches of 2 MB, or of one longer row, unless the session names a size itself.

    Spark's 10,000 rows or 64 MB a batch are held by the JVM, which doubles their buffers
    as they fill and keeps what it frees, and by the Python worker, in every task at once.
    The setting stays with the session, as the rows are computed later.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, "2m")
    return rows.mapInArrow(emit, schema)


def copy_key(text: Column) -> Column:
    """64 bits that tell different texts of one id, or of no id, apart."""
    return F.xxhash64(text)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as (row_id, row_copy, row_text, row): own names cannot clash with input columns.

    ``row`` holds the other columns, ``row_text`` the text (null: empty). ``row_copy``
    tells different texts of one id apart; equal rows share both keys, as they share
    every result. A null id is a key like any other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("row_id"),
        copy_key(text).alias("row_copy"),
        text.alias("row_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left.row_id.eqNullSafe(right.row_id) & (left.row_copy == right.row_copy)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and where each row begins and ends in it."""
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets
