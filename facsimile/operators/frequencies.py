"""Frequencies of texts in groups, and draws from them by an interval join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.operators.lookup import fits_broadcast, lookup_join
from facsimile.operators.ranks import running_totals
from facsimile.session import settle

BUCKET_ENTRIES = 64  # texts of a group in one bucket of the join, on average


@dataclass
class Frequencies:
    """Texts of each group with their intervals ``(label, text, lo, hi)``, and ``(label, total, width)`` of the groups' buckets."""

    texts: DataFrame
    groups: DataFrame

    @classmethod
    def learn(cls, table: DataFrame) -> Frequencies:
        """From ``table(label, text)``, a row per occurrence; nulls are none."""
        counted = table.filter("text IS NOT NULL").groupBy("label", "text").agg(F.count(F.lit(1)).alias("count"))
        counted = settle(counted.withColumn("rarity", -F.col("count")), "frequencies")
        texts = settle(running_totals(counted, ["label"], ["rarity", "text"], "count").select("label", "text", "lo", "hi"), "frequencies")
        return cls.of(texts)

    @classmethod
    def of(cls, texts: DataFrame) -> Frequencies:
        """From a stored table of intervals."""
        sizes = texts.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.max("hi").alias("total"))
        width = F.expr(f"greatest(1, total div greatest(1, texts div {BUCKET_ENTRIES}))")
        return cls(texts, settle(sizes.select("label", "total", width.alias("width")), "frequency-groups"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Frequencies:
        return cls(spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/groups"))

    def save(self, path: str) -> None:
        self.texts.write.mode("overwrite").parquet(f"{path}/texts")
        self.groups.write.mode("overwrite").parquet(f"{path}/groups")

    def draw(self, facts: DataFrame, u: str) -> DataFrame:
        """Adds ``text`` to ``facts(row, place, label, …)``: that of the group at the uniform number ``u``, null if it has none.

        An interval join in buckets, each of which meets about ``BUCKET_ENTRIES`` texts.
        """
        groups = lookup_join(facts, self.groups, "label", ["row", "place"])
        placed = groups.withColumn("point", F.expr(f"least(bigint(floor({u} * total)), total - 1)")).withColumn("bucket", F.expr("point div width"))
        cut = lookup_join(self.texts, self.groups.select("label", "width"), "label", ["text"])
        cut = cut.select("label", "text", "lo", "hi", F.explode(F.expr("sequence(lo div width, (hi - 1) div width)")).alias("bucket"))
        if fits_broadcast(self.texts):  # at most one extra row per BUCKET_ENTRIES texts
            cut = F.broadcast(cut)
        a, b = placed.alias("a"), cut.alias("b")
        hit = (F.col("a.label") == F.col("b.label")) & (F.col("a.bucket") == F.col("b.bucket")) & F.expr("b.lo <= a.point AND a.point < b.hi")
        return a.join(b, hit, "left").select(*[F.col(f"a.{c}") for c in facts.columns], "b.text")
