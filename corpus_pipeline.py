"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of ``documents``. A null text is empty from
the first stage on; rows with null ids, equal rows and further columns go the way that
the operators' docstrings tell.
"""

from __future__ import annotations

from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.llm.byte_bpe import encode_texts
from facsimile.llm.common import store
from facsimile.llm.contamination import without_items
from facsimile.llm.labelled import fold
from facsimile.llm.simhash import near_duplicates, one_of_each
from facsimile.llm.suffix import remove_repeats
from facsimile.llm.toxicity import fit_toxicity


def _unpacked(found: DataFrame, docs: DataFrame, changed: dict) -> DataFrame:
    """The columns of ``docs`` from ``row``, those in ``changed`` anew."""
    return found.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees score below 0.5; every fifth id never teaches them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = fit_toxicity(docs, labels, fold("doc_id", 5) == 0).score(docs)
    return _unpacked(scored.filter("score < 0.5"), docs, {"text": F.col("row_text")})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component."""
    return _unpacked(one_of_each(near_duplicates(docs)), docs, {"text": F.col("row_text")})


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that stand in them or in others again; ``n_chars`` follows the text."""
    text = F.col("kept").cast("string")
    return _unpacked(remove_repeats(docs, whole_characters=True), docs, {"text": text, "n_chars": F.length(text).cast("bigint")})


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each document; ``intact`` tells that they decode to its text."""
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    kept = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    decoded = encode_texts(kept, ranks, PATTERN, decoded=True)
    return decoded.select(
        "row.doc_id",
        "row.lang",
        "row.source",
        "row.n_chars",
        F.expr("length(ids) div 4").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.sha2("decoded", 256) == F.col("row.text_sha256")).alias("intact"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokenize),
]

#: SQL has no XXH64, no boosted trees and no BPE; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
