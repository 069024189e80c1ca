"""Avro record schemas: Spark schema and per-field formats (driver-side, schema sized)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

ITEM = "_item"

# Format names a field may carry, and the column type each stands for.
FORMAT_TYPES: dict[str, T.DataType] = {
    "RFC3339Nano": T.TimestampType(),
    "ISO8601": T.TimestampType(),
    "ISO8601Date": T.DateType(),
    "uint64": T.DecimalType(20, 0),
}
UUID_FORMAT = "uuid"

_PRIMITIVES: dict[str, T.DataType] = {
    "null": T.NullType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bytes": T.BinaryType(),
    "string": T.StringType(),
}


def _only_member(union: list) -> Any | None:
    members = [m for m in union if m != "null"]
    return members[0] if len(members) == 1 else None


def _walk_fields(avro: Any, prefix: str, found: dict[str, str], wanted: str) -> None:
    if isinstance(avro, list):
        member = _only_member(avro)
        if member is not None:
            _walk_fields(member, prefix, found, wanted)
    elif isinstance(avro, dict):
        kind = avro.get("type")
        if wanted == UUID_FORMAT and avro.get("logicalType") == UUID_FORMAT:
            found[prefix] = UUID_FORMAT
        if kind == "record":
            for f in avro.get("fields", []):
                path = f"{prefix}.{f['name']}" if prefix else f["name"]
                if wanted == "format" and "format" in f:
                    found[path] = f["format"]
                _walk_fields(f["type"], path, found, wanted)
        elif kind == "array":
            _walk_fields(avro.get("items"), f"{prefix}.{ITEM}", found, wanted)
        elif isinstance(kind, (dict, list)):
            _walk_fields(kind, prefix, found, wanted)


def format_paths(avro: Any) -> dict[str, str]:
    """``{dotted path: format}`` for every field with a ``format`` attribute."""
    found: dict[str, str] = {}
    if isinstance(avro, dict) and avro.get("type") == "record":
        _walk_fields(avro, "", found, "format")
    return found


def uuid_paths(avro: Any) -> dict[str, str]:
    """``{dotted path: 'uuid'}`` for every value with the uuid logical type."""
    found: dict[str, str] = {}
    _walk_fields(avro, "", found, UUID_FORMAT)
    return found


def spark_type(avro: Any) -> T.DataType:
    """Spark type of an Avro type; list elements are always nullable."""
    if isinstance(avro, str):
        if avro not in _PRIMITIVES:
            raise ValueError(f"unknown Avro type {avro!r}")
        return _PRIMITIVES[avro]
    if isinstance(avro, list):
        member = _only_member(avro)
        if member is None:
            raise ValueError(f"a union needs exactly one member besides null, got {avro!r}")
        return spark_type(member)
    kind, logical = avro["type"], avro.get("logicalType")
    if isinstance(kind, (dict, list)):
        return spark_type(kind)
    if kind == "record":
        return T.StructType(
            [T.StructField(f["name"], spark_type(f["type"]), _nullable(f["type"])) for f in avro["fields"]]
        )
    if kind == "array":
        return T.ArrayType(spark_type(avro["items"]), True)
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(avro["values"]), True)
    if kind == "enum":
        return T.StringType()
    if logical == "decimal":
        return T.DecimalType(avro["precision"], avro.get("scale", 0))
    if kind == "fixed":
        return T.BinaryType()
    if logical == "date":
        return T.DateType()
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    if logical in ("local-timestamp-millis", "local-timestamp-micros"):
        return T.TimestampNTZType()
    return spark_type(kind)


def _nullable(avro: Any) -> bool:
    return isinstance(avro, list) and "null" in avro


def override_types(
    schema: T.StructType, formats: dict[str, str], mapping: dict[str, T.DataType] | None = None
) -> T.StructType:
    """``schema`` with the type of each formatted path replaced, through structs and lists."""
    table = FORMAT_TYPES if mapping is None else mapping

    def fix(dtype: T.DataType, path: str) -> T.DataType:
        chosen = table.get(formats.get(path, ""))
        if chosen is not None:
            if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
                raise ValueError(f"format {formats[path]!r} at {path!r} needs a scalar field")
            return chosen
        if isinstance(dtype, T.StructType):
            return T.StructType(
                [T.StructField(f.name, fix(f.dataType, f"{path}.{f.name}"), f.nullable) for f in dtype.fields]
            )
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(fix(dtype.elementType, f"{path}.{ITEM}"), True)
        return dtype

    return T.StructType([T.StructField(f.name, fix(f.dataType, f.name), f.nullable) for f in schema.fields])


def table_schema(
    avro: dict[str, Any], mapping: dict[str, T.DataType] | None = None
) -> tuple[T.StructType, dict[str, str]]:
    """Target schema of an Avro record and the formats that lead to it."""
    if not isinstance(avro, dict) or avro.get("type") != "record":
        raise ValueError("expected an Avro record schema")
    formats = format_paths(avro)
    return override_types(spark_type(avro), formats, mapping), {**uuid_paths(avro), **formats}
