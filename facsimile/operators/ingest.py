"""Staged rows to typed rows, with the rows that do not convert set apart.

Every cell that cannot be converted, and every required one that is missing, is noted
while its row is converted: where it is, its text and what is wrong. Rows without a note
are accepted, the others are kept as they came, with their notes. Nothing stops at the
first bad value and nothing turns silently into null.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.nested import cell_text, column
from facsimile.operators.typed import Conversion
from facsimile.plans.avro import ITEM, table_schema
from facsimile.session import settle

PROBLEMS = "array<struct<path:string,value:string,reason:string>>"
MISSING = "missing"


@dataclass
class Ingested:
    """``rows(source, row, problems)``: the staged row, the typed row and the notes, stored once."""

    rows: DataFrame

    def accepted(self) -> DataFrame:
        return self.rows.filter(F.size("problems") == 0).select("row.*")

    def rejected(self) -> DataFrame:
        """The staged columns, and ``problems``."""
        return self.rows.filter(F.size("problems") > 0).select("source.*", "problems")

    def counts(self) -> DataFrame:
        """(path, reason, rows, cells): how many rows and cells have each problem."""
        kinds = F.array_distinct(F.transform("problems", lambda p: F.struct(p["path"].alias("path"), p["reason"].alias("reason"))))
        same = "filter(problems, p -> p.path = kind.path AND p.reason = kind.reason)"
        per_row = self.rows.select("problems", F.explode(kinds).alias("kind")).select("kind.*", F.expr(f"size({same})").alias("cells"))
        return per_row.groupBy("path", "reason").agg(F.count(F.lit(1)).alias("rows"), F.sum("cells").alias("cells"))


def _none() -> Column:
    return F.array().cast(PROBLEMS)


def _noted(path: str, value: Column, reason: str) -> Column:
    return F.array(F.struct(F.lit(path).alias("path"), value.alias("value"), F.lit(reason).alias("reason"))).cast(PROBLEMS)


def problems(df: DataFrame, conversion: Conversion) -> Column:
    """The notes of a row of ``df``; an array's cells share the path of its items."""

    def walk(value: Column | None, source: T.DataType | None, dtype: T.DataType, path: str, required: bool) -> Column | None:
        found = below(value, source, dtype, path)
        if not required:
            return found
        absent = F.lit(True) if value is None else value.isNull()
        return F.when(absent, _noted(path, F.lit(None), MISSING)).otherwise(_none() if found is None else found)

    def below(value, source, dtype, path) -> Column | None:
        if isinstance(dtype, T.StructType):
            present = {f.name: f.dataType for f in source.fields} if isinstance(source, T.StructType) else {}
            if value is not None and not present:
                return F.when(value.isNotNull(), _noted(path, cell_text(value, source), "not a record")).otherwise(_none())
            if value is None:
                return None
            parts = [
                walk(value.getField(f.name) if f.name in present else None, present.get(f.name), f.dataType, f"{path}.{f.name}", not f.nullable)
                for f in dtype.fields
            ]
            parts = [p for p in parts if p is not None]
            return F.when(value.isNotNull(), F.concat(*parts)).otherwise(_none()) if parts else None
        if value is None or isinstance(source, T.NullType):
            return None
        if isinstance(dtype, T.ArrayType):
            if not isinstance(source, T.ArrayType):
                return F.when(value.isNotNull(), _noted(path, cell_text(value, source), "not a list")).otherwise(_none())
            if walk(F.lit(""), source.elementType, dtype.elementType, f"{path}.{ITEM}", False) is None:
                return None
            return F.coalesce(F.flatten(F.transform(value, lambda x: below(x, source.elementType, dtype.elementType, f"{path}.{ITEM}"))), _none())
        if source == dtype and conversion.formats.get(path) is None:
            return None
        made = conversion.leaf(value, source, dtype, path)
        reason = f"not a {conversion.formats.get(path) or dtype.simpleString()}"
        return F.when(value.isNotNull() & made.isNull(), _noted(path, cell_text(value, source), reason)).otherwise(_none())

    available = {f.name: f.dataType for f in df.schema.fields}
    notes = [
        walk(column(f.name) if f.name in available else None, available.get(f.name), f.dataType, f.name, not f.nullable)
        for f in conversion.target.fields
    ]
    notes = [n for n in notes if n is not None]
    return F.concat(*notes) if notes else _none()


def ingest(staged: DataFrame, schema: T.StructType | dict[str, Any], formats: dict[str, str] | None = None, **options) -> Ingested:
    """Bring ``staged`` rows to ``schema``, a Spark schema or an Avro record, and set apart those that do not convert.

    ``formats`` and ``options`` as in :func:`facsimile.operators.typed.conform`; an Avro
    schema brings its own formats. A field that is not nullable is required: a null or
    an absent column is a problem. Times out of range are clamped, which is none.
    """
    if isinstance(schema, dict):
        schema, own = table_schema(schema)
        formats = {**own, **(formats or {})}
    conversion = Conversion(schema, formats, on_error="null", **options)
    row = F.struct(*conversion.columns(staged))
    source = F.struct(*[column(c) for c in staged.columns])
    return Ingested(settle(staged.select(source.alias("source"), row.alias("row"), problems(staged, conversion).alias("problems")), "ingested"))
