"""Bounded samples of labelled rows, the same for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, held_out: Column, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(sample_id, text, label) of at most ``limit`` labelled rows: those of the smallest id hashes.

    Rows with ``held_out`` true, without an id or without a label are left out. An id
    labelled twice has its larger label; of an id's different texts one is taken.
    """
    usable = labels.filter(~held_out & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = usable.groupBy(F.col(id_col).cast("bigint").alias("sample_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("sample_id"), "sample_id").limit(limit)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), texts.id == chosen.sample_id)  # at most ``limit`` short rows
    return joined.groupBy("sample_id", "label").agg(F.min("text").alias("text"))
