"""Check of uploaded payloads as a table job: nothing is decoded beyond the first bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strict base64, the allowed file names, the first four bytes of an Avro container file.
BASE64_PATTERN = r"^[A-Za-z0-9+/]*={0,2}$"
FILENAME_PATTERN = r"(?U)^[\w\-.]+\.avro$"
AVRO_MAGIC = "4F626A01"

BAD_BASE64, BAD_MAGIC, BAD_NAME = "malformed base64", "not an Avro container", "bad file name"


def check_payloads(df: DataFrame, payload: str = "payload", filename: str = "filename") -> DataFrame:
    """Adds ``ok`` and ``reason`` (the first check that failed). A null file name is allowed."""
    p, name = F.col(payload), F.col(filename)
    base64 = F.coalesce((F.length(p) % 4 == 0) & p.rlike(BASE64_PATTERN), F.lit(False))
    head = F.hex(F.substring(F.try_to_binary(F.substring(p, 1, 8), F.lit("base64")), 1, 4))
    magic = F.coalesce(head == AVRO_MAGIC, F.lit(False))
    named = name.isNull() | name.rlike(FILENAME_PATTERN)
    reason = F.when(~base64, BAD_BASE64).when(~magic, BAD_MAGIC).when(~named, BAD_NAME)
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def split_payloads(df: DataFrame, payload: str = "payload", filename: str = "filename") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rows for quarantine with the reason."""
    checked = check_payloads(df, payload, filename)
    return checked.where("ok").drop("ok", "reason"), checked.where(~F.col("ok")).drop("ok")
