"""Reading tables from files, catalogs and databases, with an optional row limit."""

from __future__ import annotations

import re
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.operators.ranks import SLOT_ROWS, any_rows, first_by
from facsimile.session import settle

INTERNAL_COLUMNS = ("_dq", "_dq_failed_checks", "_stage_dt", "_cleansed_dt")
FILE_KINDS = ("parquet", "s3", "json", "avro")
TABLE_KINDS = ("table", "jdbc", "iceberg")


def s3_options(overrides: dict[str, str] | None = None, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """Hadoop S3A options from ``access_key, secret_key, region, endpoint_url``.

    A source's own values go before the defaults, one by one. Keys count only as a pair.
    """
    own, common = overrides or {}, defaults or {}
    chosen = {k: own.get(k) or common.get(k) for k in ("access_key", "secret_key", "region")}
    options = {}
    if chosen["access_key"] and chosen["secret_key"]:
        options["fs.s3a.access.key"] = chosen["access_key"]
        options["fs.s3a.secret.key"] = chosen["secret_key"]
    if chosen["region"]:
        options["fs.s3a.endpoint.region"] = chosen["region"]
    if own.get("endpoint_url"):
        options["fs.s3a.endpoint"] = own["endpoint_url"]
        options["fs.s3a.path.style.access"] = "true"
    return options


def jdbc_options(location: str, split_by: str | None = None, bounds: tuple | None = None, parts: int | None = None) -> dict[str, str]:
    """Options of a database table, read by ``parts`` tasks over ranges of ``split_by`` (a number, date or time) between ``bounds``.

    The bounds cut the ranges and leave no row out: the first and the last range are open.
    """
    if split_by is None:
        if bounds is not None or parts is not None:
            raise ValueError("bounds and parts need split_by")
        return {"dbtable": location}
    if bounds is None or parts is None or parts < 1 or not bounds[0] < bounds[1]:
        raise ValueError("split_by needs lower and upper bounds and at least one part")
    low, high = bounds
    return {"dbtable": location, "partitionColumn": split_by, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


def read_table(
    spark: SparkSession,
    kind: str,
    location: str,
    limit: int | None = None,
    order_by: Iterable[str] = (),
    drop: Iterable[str] = (),
    options: dict[str, str] | None = None,
    split_by: str | None = None,
    bounds: tuple | None = None,
    parts: int | None = None,
) -> DataFrame:
    """A table as a DataFrame.

    ``kind``: ``parquet``, ``json`` (one record per line, or ``multiLine`` in the
    options), ``avro``, ``s3`` (Parquet; the location starts with ``s3://``),
    ``table`` (catalog.schema.name), ``jdbc``, ``iceberg``. Columns named in
    ``drop`` are left out; absent ones are ignored. Catalog and database tables
    always lose the internal columns. A database table is read by one task unless
    ``split_by``, ``bounds`` and ``parts`` deal it out (see ``jdbc_options``).
    """
    options = options or {}
    if kind != "jdbc" and split_by is not None:
        raise ValueError("split_by is for jdbc; other tables are read in the pieces they are stored in")
    if kind == "s3":
        if not location.startswith("s3://"):
            raise ValueError("the path must start with 's3://'")
        df = spark.read.options(**options).parquet("s3a://" + location[len("s3://") :])
    elif kind in FILE_KINDS:
        df = spark.read.format(kind).options(**options).load(location)
    elif kind == "table":
        df = spark.table(location)
    elif kind == "jdbc":
        df = spark.read.format("jdbc").options(**options, **jdbc_options(location, split_by, bounds, parts)).load()
    elif kind == "iceberg":
        df = spark.read.format("iceberg").options(**options).load(location)
    else:
        raise ValueError(f"kind must be one of {FILE_KINDS + TABLE_KINDS}")
    if kind == "json" and not df.columns:
        raise ValueError("all records are empty")
    hidden = [*drop, *(INTERNAL_COLUMNS if kind in TABLE_KINDS else ())]
    return first_rows(df.drop(*hidden), limit, order_by)


def first_rows(df: DataFrame, limit: int | None, order_by: Iterable[str] = ()) -> DataFrame:
    """At most ``limit`` rows; the first ones by ``order_by`` if it is given, else those of the first partitions.

    Rows are counted, by slices of the order or by partitions, and then filtered where
    they are: no task gathers them, whatever the limit.
    """
    if limit is None:
        return df
    if limit <= 0:
        raise ValueError("the limit must be positive")
    keys = list(order_by)
    return first_by(df, limit, keys) if keys else any_rows(df, limit)


def ranked_head(df: DataFrame, limit: int, keys: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """The first ``limit`` rows by ``keys``, counted in slices of about ``slot_rows``."""
    return first_by(df, limit, keys, slot_rows)


def require_rows(df: DataFrame) -> DataFrame:
    """``df`` itself; an input without rows is an error."""
    if df.isEmpty():
        raise ValueError("no valid records loaded from source")
    return df


def training_rows(df: DataFrame, limit: int, order_by: Iterable[str] = ()) -> DataFrame:
    """A limited input, written once so that every statistic sees the same rows."""
    return settle(first_rows(df, limit, order_by), "training")


def json_schema(df: DataFrame, text: str) -> str:
    """Schema of JSON objects in a text column: keys united over all rows in one aggregate."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(text))).alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<") or found == "OBJECT<>":
        raise ValueError("all records are empty")
    plain = re.sub(r"\bOBJECT<", "STRUCT<", found)
    plain = re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", plain)
    return re.sub(r"\bVOID\b", "STRING", plain)


def json_records(df: DataFrame, text: str, schema: str | None = None) -> DataFrame:
    """JSON objects in a text column as columns beside the other ones.

    Without ``schema`` the keys are united over all rows. Keys a record lacks are
    null, and so are all fields of text that is no JSON object.
    """
    ddl = schema or json_schema(df, text)
    parsed = df.withColumn(text, F.from_json(F.col(text), ddl))
    return parsed.select(*[c for c in df.columns if c != text], f"{text}.*")
