"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the session names it.

    A session on one machine (``local[…]``: tests, the bench) that leaves it unset gets a
    temporary folder once. Anything else must name a folder, because one of a single
    machine would not survive the loss of that machine.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="facsimile-")
    return _LOCAL_FOLDERS[application]


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder; never reused, never cleared here."""
    return f"{shared_dir(spark)}/facsimile/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Used where later steps must all see the same rows (a limited read) or where
    an aggregate is used several times. A lost executor then costs a re-read of
    the files and not a recomputation. Columnar files keep column pruning.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, purpose)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def snapshot(df: DataFrame, purpose: str = "input") -> DataFrame:
    """Store ``df`` for several passes, whatever its size: all passes see the same rows.

    What is stored in fewer pieces than there are task slots is spread over all slots.
    """
    stored, slots = settle(df, purpose), df.sparkSession.sparkContext.defaultParallelism
    pieces = stored.rdd.getNumPartitions()  # of a plain file scan: planned, not run
    return stored if pieces >= slots else settle(stored.repartition(slots), purpose)
