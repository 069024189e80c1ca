"""Sketches over whole tables, merged in two steps.

A global aggregate hands the partial results of all tasks to one reducer. Counts
are small enough for that, sketches of many columns are not: with hundreds of
thousands of tasks they first meet in ``MERGERS`` reducers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGERS = 256


def merged(base: DataFrame, build: str, merge: str, columns: list[str]) -> DataFrame:
    """One row with a sketch per column of ``base``; ``{}`` in the templates stands for the column."""
    parted = base.withColumn("merger", F.expr(f"spark_partition_id() % {MERGERS}"))
    partial = parted.groupBy("merger").agg(*[F.expr(build.format(c)).alias(c) for c in columns])
    return partial.selectExpr(*[f"{merge.format(c)} AS {c}" for c in columns])
