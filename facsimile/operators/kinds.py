"""Column profile and column kinds of a flat table, from one aggregate per block of columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.epoch import as_number_sql, is_time
from facsimile.functions.nested import column, quoted
from facsimile.functions.search import sql_string
from facsimile.operators.sketches import merged

KINDS = ("numeric", "datetime", "boolean", "categorical", "id", "text", "bytes", "carried")
BLOCK = 24  # columns per aggregate of sketches; each block reads its own columns
MEASURED = 8  # columns per aggregate of plain measures: the longer the generated method, the slower the row; beyond 8000 bytes it is interpreted
SKETCH_BITS = 12  # HyperLogLog registers: 2^12, standard error 1.6 %
DISTINCT_ERROR = 0.02
CATEGORY_COUNT = 1000
CATEGORY_LENGTH = 256
ID_LENGTH = 64
SCALES = (0, 1, 2, 3, 4)
ROWS = "count(1)"
AGGREGATE = re.compile(r"(count|count_if|min|max|avg|stddev_samp|coalesce)\(")

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONS = (T.FloatType, T.DoubleType)
UNCOUNTED = ("binary", "other")  # classes whose distinct values decide nothing


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if is_time(dtype):
        return "time"
    if isinstance(dtype, INTEGERS):
        return "int"
    if isinstance(dtype, T.DecimalType):
        return "wide" if dtype.scale == 0 and dtype.precision > 15 else "number"
    if isinstance(dtype, FRACTIONS):
        return "number"
    if isinstance(dtype, T.StringType):
        return "string"
    return "binary" if isinstance(dtype, T.BinaryType) else "other"


def to_digits_sql(value: str, digits: int) -> str:
    """Round a double to decimal digits in plain arithmetic (``round`` goes through BigDecimal)."""
    scale = f"{float(10**digits)!r}D"
    return f"rint({value} * {scale}) / {scale}"


def _base_sql(field: T.StructField) -> str:
    """What is measured of a column: a finite number, or the column itself."""
    name = quoted(field.name)
    numbers = type_class(field.dataType) in ("time", "int", "wide", "number")
    return as_number_sql(name, field.dataType) if numbers else name


def absent_sql(field: T.StructField) -> str:
    """Whether a cell counts as null: infinities do not, other numbers that are none do."""
    base = _base_sql(field)
    endless = isinstance(field.dataType, FRACTIONS)
    return f"({base} IS NULL AND NOT coalesce(abs(double({quoted(field.name)})) = double('Infinity'), false))" if endless else f"{base} IS NULL"


def _measures(n: int, position: int, field: T.StructField, present: bool) -> dict[str, str]:
    """SQL aggregates over the prepared columns ``c<n>`` and ``p<n>``; what needs none is constant."""
    c, group = f"c{n}", type_class(field.dataType)
    number, text = group in ("time", "int", "wide", "number"), group == "string"
    digits = "int(NULL)"
    if isinstance(field.dataType, FRACTIONS):
        cases = " ".join(f"WHEN {to_digits_sql(c, s)} = {c} THEN {s}" for s in SCALES)
        digits = f"max(CASE WHEN {c} IS NULL THEN {SCALES[0]} {cases} ELSE {SCALES[-1] + 1} END)"
    endless = isinstance(field.dataType, FRACTIONS)  # such a column may hold infinities, which are no nulls
    absent = f"{c} IS NULL AND NOT coalesce(abs(f{n}) = double('Infinity'), false)" if endless else f"{c} IS NULL"
    return {
        "column": sql_string(field.name),
        "position": str(position),
        "type": sql_string(field.dataType.simpleString()),
        "class": f"'{group}'",
        "rows": ROWS,
        "nulls": f"count_if({absent})",
        "cells": f"count_if(p{n})" if present else ROWS,
        "empty": f"count_if(p{n} AND {absent})" if present else f"count_if({absent})",
        "minus": f"count_if(f{n} = double('-Infinity'))" if endless else "0L",
        "plus": f"count_if(f{n} = double('Infinity'))" if endless else "0L",
        "min": f"min({c})" if number else "double(NULL)",
        "max": f"max({c})" if number else "double(NULL)",
        "mean": f"avg({c})" if number else "double(NULL)",
        "std": f"stddev_samp({c})" if number else "double(NULL)",
        "max_length": f"max(length({c}))" if text else "int(NULL)",
        "spaced": f"coalesce(bool_or(contains({c}, ' ')), false)" if text else "false",
        "digits": digits,
    }


def _plain_measures(flat: DataFrame, block: list[tuple[int, T.StructField]], present: dict[str, str]) -> DataFrame:
    """One aggregate over a block of columns, turned into a row per column."""
    columns = [f"{_base_sql(f)} AS c{n}" for n, (_, f) in enumerate(block)]
    columns += [f"double({quoted(f.name)}) AS f{n}" for n, (_, f) in enumerate(block) if isinstance(f.dataType, FRACTIONS)]
    columns += [f"({present[f.name]}) AS p{n}" for n, (_, f) in enumerate(block) if f.name in present]
    measured = [_measures(n, position, f, f.name in present) for n, (position, f) in enumerate(block)]
    names: dict[str, str] = {ROWS: "a0"}  # each aggregate once
    for m in measured:
        for sql in m.values():
            if AGGREGATE.match(sql):
                names.setdefault(sql, f"a{len(names)}")
    wide = flat.selectExpr(*columns).selectExpr(*[f"{sql} AS {name}" for sql, name in names.items()])
    rows = [
        "named_struct(" + ", ".join(f"'{key}', {names.get(sql, sql)}" for key, sql in m.items()) + ")" for m in measured
    ]
    long = wide.selectExpr(f"inline(array({', '.join(rows)}))")
    return long.withColumn("digits", F.expr(f"if(digits <= {SCALES[-1]}, digits, NULL)"))


def distinct_sketches(flat: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """``(column, sketch)``: HyperLogLog sketches, one binary buffer per column, which can be merged.

    Kept apart from the plain measures: a sketch in the same aggregate would
    take all of them out of generated code.
    """
    columns = [f"c{n}" for n in range(len(fields))]
    base = flat.selectExpr(*[f"{_base_sql(f)} AS {c}" for c, f in zip(columns, fields)])
    build = f"hll_sketch_agg(if({{0}} IS NULL, NULL, xxhash64({{0}})), {SKETCH_BITS})"
    sketches = merged(base, build, "hll_union_agg({})", columns)
    rows = [f"named_struct('column', {sql_string(f.name)}, 'sketch', {c})" for c, f in zip(columns, fields)]
    return sketches.selectExpr(f"inline(array({', '.join(rows)}))")


def sketched_distinct(flat: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """``(column, distinct)`` from sketches."""
    return distinct_sketches(flat, fields).selectExpr("column", "hll_sketch_estimate(sketch) AS distinct")


def distinct_values(flat: DataFrame) -> DataFrame:
    """``(column, value)``, each value of each column once, pre-aggregated before the shuffle.

    Long texts stand there by their SHA-256, so that the shuffle carries no texts.
    """

    def value(f: T.StructField) -> str:
        if isinstance(f.dataType, FRACTIONS):
            return f"string({_base_sql(f)})"
        text = f"string({quoted(f.name)})"
        return f"if(length({text}) > 64, sha2({text}, 256), {text})" if type_class(f.dataType) == "string" else text

    cells = [
        f"named_struct('column', {sql_string(f.name)}, 'value', {value(f)})"
        for f in flat.schema.fields
        if type_class(f.dataType) not in UNCOUNTED
    ]
    long = flat.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")
    return long.groupBy("column", "value").agg(F.count(F.lit(1))).select("column", "value")


def exact_distinct(flat: DataFrame) -> DataFrame:
    """``(column, distinct)`` exactly. Numbers are counted as numbers, under the place of their column; the rest as texts."""
    groups: dict[type, list[T.StructField]] = {}
    for f in flat.schema.fields:
        if type_class(f.dataType) not in UNCOUNTED:
            group = T.LongType if isinstance(f.dataType, INTEGERS) else T.DoubleType if isinstance(f.dataType, FRACTIONS) else T.StringType
            groups.setdefault(group, []).append(f)
    return reduce(DataFrame.unionByName, [_distinct_of(flat, fields, group) for group, fields in groups.items()])


def _distinct_of(flat: DataFrame, fields: list[T.StructField], group: type[T.DataType]) -> DataFrame:
    if group is T.StringType:
        return distinct_values(flat.select(*[column(f.name) for f in fields])).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    value = "bigint({})" if group is T.LongType else "{}"
    base = {f.name: quoted(f.name) if group is T.LongType else _base_sql(f) for f in fields}
    cells = [f"named_struct('place', {i}, 'value', {value.format(base[f.name])})" for i, f in enumerate(fields)]
    values = flat.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL").groupBy("place", "value").agg(F.count(F.lit(1)))
    names = f"array({', '.join(sql_string(f.name) for f in fields)})"
    return values.groupBy("place").agg(F.count(F.lit(1)).alias("distinct")).selectExpr(f"get({names}, place) AS column", "distinct")


def column_profile(
    flat: DataFrame,
    exact: bool = False,
    present: dict[str, str] | None = None,
    counts: set[str] | None = None,
) -> DataFrame:
    """One row per column: counts, nulls, range, mean, spread, distinct values, text length.

    Times are profiled as days or microseconds since 1970. ``present`` limits
    ``cells`` and ``empty`` to rows in which a cell exists (array elements);
    its values are SQL conditions.
    ``counts`` limits the counting of distinct values to the columns it names.
    """
    present = present or {}
    fields = flat.schema.fields
    counted = [f for f in fields if type_class(f.dataType) not in UNCOUNTED and (counts is None or f.name in counts)]
    blocks, sketches = [], []
    for start in range(0, len(fields), MEASURED):
        block = list(enumerate(fields))[start : start + MEASURED]
        blocks.append(_plain_measures(flat, block, present))
    if not counted:
        return reduce(DataFrame.unionByName, blocks).withColumn("distinct", F.lit(0).cast("long"))
    if exact:
        sketches.append(exact_distinct(flat.select(*[column(f.name) for f in counted])))
    else:
        for start in range(0, len(counted), BLOCK):
            sketches.append(sketched_distinct(flat, counted[start : start + BLOCK]))
    profile = reduce(DataFrame.unionByName, blocks)
    distinct = reduce(DataFrame.unionByName, sketches)
    joined = profile.join(F.broadcast(distinct), "column", "left")  # one row per column
    return joined.withColumn("distinct", F.coalesce("distinct", F.lit(0).cast("long")))


def decisive_columns(fields: list[T.StructField]) -> set[str]:
    """Columns whose kind depends on their number of distinct values."""
    out = set()
    for f in fields:
        group = type_class(f.dataType)
        if group in ("string", "wide") or group == "int" and f.name.lower().endswith(("id", "key")):
            out.add(f.name)
    return out


def detect_kinds(
    flat: DataFrame,
    overrides: dict[str, str] | None = None,
    exact: bool = False,
    present: dict[str, str] | None = None,
) -> DataFrame:
    """The profile with a ``kind`` per column; ``overrides`` wins over the rules."""
    overrides = overrides or {}
    unknown = set(overrides) - set(flat.columns)
    if unknown or not set(overrides.values()) <= set(KINDS):
        raise ValueError(f"overrides name existing columns and one of {KINDS}")
    counts = None if exact else decisive_columns(flat.schema.fields)
    return column_profile(flat, exact, present, counts).withColumn("kind", F.expr(kind_sql(overrides, exact)))


def kind_sql(overrides: dict[str, str], exact: bool) -> str:
    """The kind of a row of the profile."""
    slack = 1.0 if exact else 1.0 - 3 * DISTINCT_ERROR
    filled = "(rows - nulls)"
    unique = f"(distinct >= {filled} * {slack}D)"
    forced = " ".join(f"WHEN column = {sql_string(n)} THEN '{k}'" for n, k in overrides.items())
    return f"""CASE {forced}
        WHEN {filled} = 0 THEN 'carried'
        WHEN class = 'bool' THEN 'boolean'
        WHEN class = 'time' THEN 'datetime'
        WHEN class = 'int' AND nulls = 0 AND {unique} AND lower(column) RLIKE '(id|key)$' THEN 'id'
        WHEN class = 'wide' AND {unique} THEN 'id'
        WHEN class IN ('int', 'wide', 'number') THEN 'numeric'
        WHEN class = 'binary' THEN 'bytes'
        WHEN class = 'other' THEN 'carried'
        WHEN {unique} AND max_length <= {ID_LENGTH} AND NOT spaced THEN 'id'
        WHEN {unique} OR max_length > {CATEGORY_LENGTH} THEN 'text'
        WHEN distinct <= {CATEGORY_COUNT} OR distinct <= rows / 2 THEN 'categorical'
        ELSE 'text' END"""
