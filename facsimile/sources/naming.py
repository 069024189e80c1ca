"""Names of records, tables, files and locations, as column expressions and path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension and MIME type of each output format.
FILE_FORMATS = {
    "csv": (".csv", "text/csv"),
    "json": (".json", "application/json"),
    "parquet": (".parquet", "application/vnd.apache.parquet"),
}


def record_namespace(name: Column, default: str) -> Column:
    """Everything before the last dot of a record name, or ``default``."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(
        F.when(F.length(name) > 0, F.lit(default))
    )


def record_title(name: Column) -> Column:
    return F.when(F.length(name) > 0, F.substring_index(name, ".", -1))


def engine_table(fqn: Column, catalog: str) -> Column:
    """``service.database.schema.table`` as ``catalog.schema.table`` with ``-`` as ``_``.

    Null for names that do not have exactly four parts.
    """
    parts = F.split(fqn, r"\.")
    local = F.concat_ws(".", F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))
    named = F.concat(F.lit(f"{catalog}."), F.translate(local, "-", "_"))
    return F.when(F.size(parts) == 4, named)


def file_path(filename: str, format: str, prefix: str | None = None) -> str:
    """``prefix/folders/filename.ext``: the last extension is replaced by the format's, folders stay."""
    if format not in FILE_FORMATS:
        raise ValueError(f"format must be one of {sorted(FILE_FORMATS)}")
    folders, _, name = filename.strip("/").rpartition("/")
    stem = name.rpartition(".")[0] or name  # a leading dot begins a name, not an extension
    return "/".join(part for part in (prefix, folders, stem + FILE_FORMATS[format][0]) if part)


def table_location(warehouse: str, namespace: str, table: str) -> str:
    """Folder of a table: ``warehouse/namespace.db/table/``."""
    return f"{warehouse.rstrip('/')}/{namespace}.db/{table}/"


def table_identifier(namespace: str, table: str) -> str:
    return f"{namespace}.{table}"
