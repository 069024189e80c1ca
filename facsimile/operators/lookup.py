"""Joins to a lookup table whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.session import settle

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALT = 32
HOT_ROWS = 1_000_000  # facts of a key from which its rows are spread over several tasks


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``table`` is small, measured on its values (bounded read: rows + 1)."""
    width = F.lit(0).cast("long")
    for f in table.schema.fields:
        text = F.col(f"`{f.name}`").cast("string")
        width = width + F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    measured = table.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    return measured["n"] <= rows and (measured["bytes"] or 0) <= size


def hot_keys(facts: DataFrame, key: str) -> DataFrame:
    """(key) that more than ``HOT_ROWS`` rows of ``facts`` have: counted, with partial counts per task."""
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > HOT_ROWS).select(key)


def lookup_join(facts: DataFrame, table: DataFrame, key: str, spread_by: list[str], how: str = "left") -> DataFrame:
    """Join many ``facts`` to a ``table`` that holds each ``key`` once.

    A small table is broadcast. A larger one is copied for hot keys alone, once per salt;
    the facts of those keys get a salt from ``spread_by``, so that many tasks share them.
    """
    if fits_broadcast(table):
        return facts.join(F.broadcast(table), key, how)
    hot = settle(hot_keys(facts, key), "hot-keys")
    salts = F.array(*[F.lit(i) for i in range(SALT)])
    told = hot.withColumn("hot", F.lit(True))
    told = F.broadcast(told) if fits_broadcast(hot) else told  # a key of it stands for HOT_ROWS rows at least
    marked = [side.join(told, key, "left") for side in (facts, table)]
    salted = marked[0].withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*spread_by), F.lit(SALT)).cast("int")).otherwise(0)).drop("hot")
    copies = marked[1].withColumn("salt", F.explode(F.when(F.col("hot"), salts).otherwise(F.array(F.lit(0))))).drop("hot")
    return salted.join(copies, [key, "salt"], how).drop("salt")
