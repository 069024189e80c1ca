"""Rebuilding nested values field by field, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Text formats of times for JSON and CSV writers: all six digits, as the types hold.
TIME_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A top-level column whose name may hold dots or brackets."""
    return F.col(quoted(name))


def nullable(dtype: T.DataType) -> T.DataType:
    """The same type with nulls allowed at every level."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(nullable(dtype.elementType), True)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, nullable(dtype.valueType), True)
    return dtype


def reproject(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """Bring ``value`` to ``target``: fields by name, missing ones null, extra ones dropped."""
    if source == target:
        return value
    if isinstance(target, T.StructType) and isinstance(source, T.StructType):
        present = {f.name: f.dataType for f in source.fields}
        parts = [
            (
                reproject(value.getField(f.name), present[f.name], f.dataType)
                if f.name in present
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in target.fields
        ]
        return F.when(value.isNull(), F.lit(None)).otherwise(F.struct(*parts))
    if isinstance(target, T.ArrayType) and isinstance(source, T.ArrayType):
        return F.transform(value, lambda x: reproject(x, source.elementType, target.elementType))
    if isinstance(target, (T.StructType, T.ArrayType, T.MapType)) or isinstance(
        source, (T.StructType, T.ArrayType, T.MapType)
    ):
        if isinstance(target, T.StringType):
            return F.to_json(value)
        return value.cast(target)
    return value.try_cast(target)


def cell_text(value: Column, dtype: T.DataType) -> Column:
    """One value as text: nested values as JSON, times in ISO form, the rest by cast."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false", **TIME_FORMATS})
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(value, dtype)
    return value.cast("string")


def iso_text(value: Column, dtype: T.DataType) -> Column:
    """ISO 8601 text; the fraction appears only when it is not zero.

    Times with a zone carry the offset of the session zone, local times none.
    """
    zone = "xxx" if isinstance(dtype, T.TimestampType) else ""
    fraction = F.date_format(value, "SSSSSS")
    whole = F.date_format(value, f"yyyy-MM-dd'T'HH:mm:ss{zone}")
    exact = F.date_format(value, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}")
    return F.when(fraction == "000000", whole).otherwise(exact)
