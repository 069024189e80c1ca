"""Nested columns to scalar columns: one projection, no shuffle, no Python code per row."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.nested import iso_text, quoted
from facsimile.plans.shape import INDEX_STYLES, ITEM, LENGTH, NULL_FLAG, TAIL, Plan

WIDTH_LIMIT = 10_000


@dataclass
class FlatField:
    """A flat column: its SQL expression, and when its cell exists at all.

    ``present`` is a SQL condition over *flat* columns (flags and lengths); None
    means the cell exists in every row. ``place`` is where in the schema it comes from.
    """

    name: str
    value: str
    dtype: T.DataType
    present: str | None
    place: str = ""


def _both(a: str | None, b: str) -> str:
    return b if a is None else f"{a} AND {b}"


def flat_fields(plan: Plan, index_style: str = "__i", lengths: bool = False, null_flags: bool = True) -> list[FlatField]:
    if index_style not in INDEX_STYLES:
        raise ValueError(f"index_style must be one of {sorted(INDEX_STYLES)}")
    indexed = INDEX_STYLES[index_style]

    def walk(name: str, place: str, dtype: T.DataType, value: str, present: str | None) -> Iterator[FlatField]:
        branch = plan.branches(place, dtype)
        if branch is None:
            yield FlatField(name, value, dtype, present, place)
            return
        extent = plan.extent(place)
        if extent.nulls and null_flags:
            yield FlatField(name + NULL_FLAG, f"{value} IS NULL", T.BooleanType(), present, place)
            present = _both(present, f"coalesce(NOT {quoted(name + NULL_FLAG)}, false)")
        if isinstance(branch, T.StructType):
            for f in branch.fields:
                yield from walk(f"{name}.{f.name}", f"{place}.{f.name}", f.dataType, f"{value}.{quoted(f.name)}", present)
            return
        if lengths:
            yield FlatField(name + LENGTH, f"array_size({value})", T.IntegerType(), present, place)
        columns = plan.columns(place)
        for i in range(columns):
            item, at = indexed.format(base=name, i=i), f"get({value}, {i})"
            here = _both(present, f"coalesce({quoted(name + LENGTH)} > {i}, false)") if lengths else present
            if plan.deep:
                yield from walk(item, f"{place}.{ITEM}", branch.elementType, at, here)
            else:
                yield FlatField(item, at, branch.elementType, here, f"{place}.{ITEM}")
        if columns < extent.width:
            yield FlatField(name + TAIL, f"slice({value}, {columns + 1}, greatest(size({value}) - {columns}, 0))", branch, present, place)

    fields = [f for c in plan.schema.fields for f in walk(c.name, c.name, c.dataType, quoted(c.name), None)]
    seen: set[str] = set()
    for f in fields:
        if f.name in seen:
            raise ValueError(f"two fields flatten to the same column {f.name!r}; rename one of them")
        seen.add(f.name)
    if len(fields) > WIDTH_LIMIT:
        raise ValueError(
            f"flattening gives {len(fields)} columns; infer the plan with ``head`` to keep the items of long arrays together"
        )
    return fields


def _times_as_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(value, dtype)
    if isinstance(dtype, T.StructType):
        parts = [_times_as_text(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNull(), F.lit(None)).otherwise(F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _times_as_text(x, dtype.elementType))
    return value


def flatten(
    df: DataFrame,
    plan: Plan,
    index_style: str = "__i",
    timestamps: str = "keep",
    lengths: bool = False,
    null_flags: bool = True,
) -> DataFrame:
    """Struct fields become ``a.b``, array elements ``a__0``, ``a__1``, …

    Short arrays give nulls. ``a._is_null`` marks null arrays and structs where
    the plan has any; ``lengths`` adds ``a._len``. Items beyond the plan's ``head`` come
    in ``a._tail``. ``timestamps="string"`` turns times into ISO text.
    """
    if timestamps not in ("keep", "string"):
        raise ValueError("timestamps must be 'keep' or 'string'")
    fields = flat_fields(plan, index_style, lengths, null_flags)
    if timestamps == "keep":
        return df.selectExpr(*[f"{f.value} AS {quoted(f.name)}" for f in fields])
    return df.select(*[_times_as_text(F.expr(f.value), f.dtype).alias(f.name) for f in fields])
