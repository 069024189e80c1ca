"""Bring rows to a target schema by name, with format-driven casts at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions import casts
from facsimile.functions.nested import column
from facsimile.plans.avro import ITEM, UUID_FORMAT, override_types

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def conform(
    df: DataFrame,
    schema: T.StructType,
    formats: dict[str, str] | None = None,
    format_mapping: dict[str, T.DataType] | None = None,
    default_offset: str = casts.DEFAULT_OFFSET,
    on_error: str = "clamp",
    null_lists: str = "keep",
    null_structs: str = "keep",
    uuid_as: str = "string",
) -> DataFrame:
    """Rows of ``df`` under ``schema``: missing columns null, unknown ones dropped, order fixed.

    ``formats`` maps dotted paths (``a.b``, list items ``a._item``) to format
    names and overrides the type there. ``on_error``: ``clamp`` gives unparseable
    times the lower bound and stops at any other bad value, ``null`` gives null,
    ``raise`` stops at the first bad value. ``null_lists="empty"`` and
    ``null_structs="expand"`` turn null containers into empty ones.
    """
    return df.select(*Conversion(schema, formats, format_mapping, default_offset, on_error, null_lists, null_structs, uuid_as).columns(df))


class Conversion:
    """How rows are brought to a schema; the options are those of ``conform``."""

    def __init__(
        self,
        schema: T.StructType,
        formats: dict[str, str] | None = None,
        format_mapping: dict[str, T.DataType] | None = None,
        default_offset: str = casts.DEFAULT_OFFSET,
        on_error: str = "clamp",
        null_lists: str = "keep",
        null_structs: str = "keep",
        uuid_as: str = "string",
    ):
        if on_error not in casts.ON_ERROR:
            raise ValueError(f"on_error must be one of {casts.ON_ERROR}")
        if null_lists not in ("keep", "empty") or null_structs not in ("keep", "expand"):
            raise ValueError("null_lists is 'keep' or 'empty', null_structs is 'keep' or 'expand'")
        if uuid_as not in ("string", "binary"):
            raise ValueError("uuid_as must be 'string' or 'binary'")
        self.formats = dict(formats or {})
        self.target = override_types(schema, self.formats, format_mapping)
        self.default_offset, self.on_error, self.uuid_as = default_offset, on_error, uuid_as
        self.null_lists, self.null_structs = null_lists, null_structs

    def columns(self, df: DataFrame) -> list[Column]:
        """The target's columns from those of ``df``."""
        available = {f.name: f.dataType for f in df.schema.fields}
        return [
            self.build(column(f.name) if f.name in available else None, available.get(f.name), f.dataType, f.name).alias(f.name)
            for f in self.target.fields
        ]

    def leaf(self, value: Column, source: T.DataType, dtype: T.DataType, path: str) -> Column:
        text = isinstance(source, T.StringType)
        fmt = self.formats.get(path)
        if fmt == UUID_FORMAT and text:
            return casts.uuid_bytes(value) if self.uuid_as == "binary" else casts.uuid_text(value)
        if fmt == "uint64" and isinstance(dtype, T.DecimalType):
            return casts.uint64_from_text(value, self.on_error, path)
        if isinstance(dtype, T.TimestampType) and text:
            return casts.timestamp_from_text(value, self.default_offset, self.on_error, path)
        if isinstance(dtype, T.TimestampType) and isinstance(source, NUMERIC):
            return casts.timestamp_from_nanos(value)
        if isinstance(dtype, T.DateType) and text:
            return casts.date_from_text(value, self.on_error, path)
        if source == dtype:
            return value
        return value.try_cast(dtype) if self.on_error == "null" else value.cast(dtype)

    def build(self, value: Column | None, source: T.DataType | None, dtype: T.DataType, path: str) -> Column:
        if isinstance(dtype, T.StructType):
            return self._struct(value, source, dtype, path)
        if isinstance(dtype, T.ArrayType):
            return self._array(value, source, dtype, path)
        if value is None or isinstance(source, T.NullType):
            return F.lit(None).cast(self._final_type(dtype, path))
        return self.leaf(value, source, dtype, path)

    def _struct(self, value, source, dtype: T.StructType, path: str) -> Column:
        present = {f.name: f.dataType for f in source.fields} if isinstance(source, T.StructType) else {}
        parts = [
            self.build(
                value.getField(f.name) if f.name in present else None, present.get(f.name), f.dataType, f"{path}.{f.name}"
            ).alias(f.name)
            for f in dtype.fields
        ]
        made = F.struct(*parts)
        if self.null_structs == "expand":
            return made
        if not present:
            return F.when(F.lit(False), made)
        return F.when(value.isNotNull(), made)

    def _array(self, value, source, dtype: T.ArrayType, path: str) -> Column:
        if isinstance(source, T.ArrayType):
            made = F.transform(value, lambda x: self.build(x, source.elementType, dtype.elementType, f"{path}.{ITEM}"))
        else:
            made = F.lit(None).cast(self._final_type(dtype, path))
        if self.null_lists == "empty":
            return F.coalesce(made, F.array().cast(self._final_type(dtype, path)))
        return made

    def _final_type(self, dtype: T.DataType, path: str) -> T.DataType:
        """The type a branch without input must have (uuids may become binary)."""
        if isinstance(dtype, T.StructType):
            return T.StructType([T.StructField(f.name, self._final_type(f.dataType, f"{path}.{f.name}")) for f in dtype.fields])
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(self._final_type(dtype.elementType, f"{path}.{ITEM}"))
        if self.formats.get(path) == UUID_FORMAT and self.uuid_as == "binary":
            return T.BinaryType()
        return dtype
