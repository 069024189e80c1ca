"""A sample document: column names and rows as arrays, in chunks of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions.nested import TIME_FORMATS, cell_text, column
from facsimile.operators.ranks import SLOT_ROWS, running_totals
from facsimile.session import settle

CHUNK_ROWS = 10_000  # rows in one cell
DEFAULT_ROWS = 1000


def _cell_json(name: str) -> Column:
    """The value as JSON text; null stays null."""
    wrapped = F.to_json(F.struct(column(name).alias("v")), TIME_FORMATS)
    return F.when(column(name).isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - F.lit(6)))


def sample_document(df: DataFrame, order_by: list[str], limit: int = DEFAULT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``chunk``, ``columns`` array<string>, ``rows`` array<array<string>>, ``document`` JSON; a row per chunk.

    ``rows`` holds values as text (times in ISO form), ``document`` as JSON values. Any
    number of rows may be asked for; each chunk is a document of ``chunk_rows`` of them.
    ``order_by`` should name each row once. Up to ``SLOT_ROWS`` rows are a top-k; more are
    placed slice by slice, without one task seeing all of them.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    if not order_by:
        raise ValueError("order_by must name the columns that order the rows")
    top = settle(df.orderBy(*[column(c) for c in order_by]).limit(limit) if limit <= SLOT_ROWS else df, "document")
    placed = running_totals(top.withColumn("_one", F.lit(1).cast("long")), [], order_by, "_one").where(F.col("hi") <= limit)
    top = placed.withColumn("_chunk", F.call_function("div", F.col("lo"), F.lit(chunk_rows))).drop("_one", "lo", "hi")
    cells = F.array(*[cell_text(column(f.name), f.dataType) for f in df.schema.fields])
    values = F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(_cell_json(c), F.lit("null")) for c in df.columns]), F.lit("]"))
    key = F.struct(*[column(c) for c in order_by])
    ordered = F.sort_array(F.collect_list(F.struct(key.alias("key"), cells.alias("cells"), values.alias("json"))))
    names = F.array(*[F.lit(c) for c in df.columns])
    gathered = top.groupBy(F.col("_chunk").alias("chunk")).agg(ordered.alias("items"))
    body = F.concat_ws(",", F.transform("items", lambda x: x["json"]))
    return gathered.select(
        "chunk",
        names.alias("columns"),
        F.transform("items", lambda x: x["cells"]).alias("rows"),
        F.concat(F.lit('{"columns":'), F.to_json(names), F.lit(',"rows":['), body, F.lit("]}")).alias("document"),
    )


def width_errors(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of documents whose number of values differs from the number of columns."""
    keep = keep or []
    opened = documents.select(*keep, F.size("columns").alias("expected"), F.posexplode("rows").alias("row", "cells"))
    return opened.select(*keep, "row", F.size("cells").alias("found"), "expected").where("found <> expected")
