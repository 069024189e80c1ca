"""Writing files: CSV, JSON or Parquet below ``prefix/name.ext``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.nested import TIME_FORMATS, cell_text, column
from facsimile.sources.naming import FILE_FORMATS, file_path

REPORT_DDL = "path string, format string, mime string, rows bigint"


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that fills while it is written: no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def csv_cells(df: DataFrame) -> DataFrame:
    """Nested and binary columns as text, as CSV holds scalars only."""
    complex_types = (T.StructType, T.ArrayType, T.MapType, T.BinaryType)
    return df.select(
        *[
            cell_text(column(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, complex_types) else column(f.name)
            for f in df.schema.fields
        ]
    )


def write_files(df: DataFrame, base: str, filename: str, format: str = "csv", prefix: str | None = None) -> DataFrame:
    """Write ``df`` and report path, format, MIME type and rows. The path is a folder of part files."""
    path = f"{base.rstrip('/')}/{file_path(filename, format, prefix)}"
    shaped = csv_cells(df) if format == "csv" else df
    observed, seen = counted(shaped, "files")
    writer = observed.write.mode("overwrite").options(**TIME_FORMATS)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif format == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    rows = [(path, format, FILE_FORMATS[format][1], int(seen.get["rows"]))]
    return df.sparkSession.createDataFrame(rows, REPORT_DDL)


def as_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls included, in column ``record``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **TIME_FORMATS}).alias("record"))
