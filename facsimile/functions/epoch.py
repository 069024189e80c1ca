"""Times as whole numbers and back, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000


def _ntz_micros_sql(c: str) -> str:
    return (
        f"(bigint(unix_date(date({c}))) * 86400000000L + bigint(hour({c})) * 3600000000L + "
        f"bigint(minute({c})) * 60000000L + bigint(extract(SECOND FROM {c}) * 1000000))"
    )


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def as_number_sql(c: str, dtype: T.DataType) -> str:
    """The column as double: days for dates, microseconds for timestamps; NaN and the infinities are null."""
    if isinstance(dtype, T.DateType):
        return f"double(unix_date({c}))"
    if isinstance(dtype, T.TimestampType):
        return f"double(unix_micros({c}))"
    if isinstance(dtype, T.TimestampNTZType):
        return f"double({_ntz_micros_sql(c)})"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"if(abs(double({c})) < double('Infinity'), double({c}), NULL)"
    return f"double({c})"


def epoch_micros(c: str, dtype: T.DataType) -> Column:
    """Exact microseconds since 1970 of a timestamp column (its name as SQL), as bigint."""
    return F.expr(f"unix_micros({c})" if isinstance(dtype, T.TimestampType) else _ntz_micros_sql(c))


def from_number(c: Column, dtype: T.DataType) -> Column:
    """Inverse of :func:`as_number_sql`, cast to ``dtype``."""
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(F.round(c).cast("int"))
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.round(c).cast("long"))
    if isinstance(dtype, T.TimestampNTZType):
        seconds = (F.round(c).cast("decimal(20,0)") / F.lit(MICROS)).cast("decimal(18,6)")
        return F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(secs=seconds)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.round(c).try_cast(dtype)
    return c.try_cast(dtype)
