"""Casts from loosely typed text and numbers, one per format. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_OFFSET = "+03:00"
# The bounds of signed 64-bit nanoseconds since 1970, floored to microseconds.
MICROS_MIN = -9223372036854776
MICROS_MAX = 9223372036854775
NANOS_MIN = -(2**63)
NANOS_MAX = 2**63 - 1
UINT64_MAX = 2**64 - 1

DAY = r"\d{4}-\d{2}-\d{2}"
OFFSET = r"(Z|[+-]\d{2}:\d{2})"
CLOCK = r"[T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?"
ISO_TIME = f"^{DAY}({CLOCK}{OFFSET}?)?$"
WITH_SECONDS = rf"^{DAY}[T ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?"
UUID_TEXT = "^([0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32})$"
ON_ERROR = ("clamp", "null", "raise")


def _settle_failures(parsed: Column, source: Column, on_error: str, what: str, path: str) -> Column:
    """Null or an error where a value that is not null did not parse. ``parsed`` is evaluated once."""
    if on_error == "null":
        return parsed
    message = F.concat(F.lit("Cannot convert '"), source.cast("string"), F.lit(f"' to {what} at '{path}'"))
    return F.coalesce(parsed, F.when(source.isNotNull(), F.raise_error(message)))


def micros_from_text(c: Column, default_offset: str = DEFAULT_OFFSET) -> Column:
    """Microseconds since 1970 of ISO 8601 / RFC 3339 text; null if it does not parse.

    ``Z`` and explicit offsets are kept, text without one gets ``default_offset``.
    A bare date is midnight at the default offset. Hours or minutes that are left
    out count as zero and digits below the microsecond are cut.
    """
    size = F.length(c)
    # The pattern fixes the layout, so lengths tell which parts are there.
    signed = (size >= 19) & F.substring(c, -6, 1).isin("+", "-")
    tail = F.when(c.endswith("Z"), F.lit(1)).when(signed, F.lit(6)).otherwise(F.lit(0))
    local = size - tail
    filler = (
        F.when(local == 10, F.lit("T00:00:00")).when(local == 13, F.lit(":00:00")).when(local == 16, F.lit(":00")).otherwise(F.lit(""))
    )
    offset = F.when(tail > 0, F.substring(c, local + 1, tail)).otherwise(F.lit(default_offset))
    # Most text has all its parts, or lacks the offset alone; only the rest is taken apart.
    ready = F.when(c.rlike(f"{WITH_SECONDS}{OFFSET}$"), c).when(c.rlike(f"{WITH_SECONDS}$"), F.concat(c, F.lit(default_offset)))
    filled = ready.when(c.rlike(ISO_TIME), F.concat(F.substring(c, F.lit(1), local), filler, offset))
    return F.unix_micros(F.when(~c.startswith("0000"), filled).try_cast("timestamp"))


def _clamped(us: Column) -> Column:
    return F.greatest(F.least(us, F.lit(MICROS_MAX)), F.lit(MICROS_MIN))


def timestamp_from_text(
    c: Column, default_offset: str = DEFAULT_OFFSET, on_error: str = "clamp", path: str = ""
) -> Column:
    """ISO text to timestamp, kept within the bounds of 64-bit nanoseconds.

    With ``clamp`` text that does not parse gives the lower bound.
    """
    us = micros_from_text(c, default_offset)
    if on_error == "clamp":
        return F.timestamp_micros(F.when(c.isNotNull(), _clamped(F.coalesce(us, F.lit(MICROS_MIN)))))
    settled = _settle_failures(us, c, on_error, "timestamp", path)
    return F.timestamp_micros(F.when(settled.isNotNull(), _clamped(settled)))


def timestamp_from_nanos(ns: Column) -> Column:
    """Epoch nanoseconds of any numeric type to timestamp, floored and clamped."""
    wide = F.floor(ns.cast("decimal(38,0)"))
    inside = F.greatest(F.least(wide, F.lit(NANOS_MAX).cast("decimal(38,0)")), F.lit(NANOS_MIN).cast("decimal(38,0)"))
    whole = inside.cast("long")
    return F.timestamp_micros(F.when(ns.isNotNull(), _floor_thousandth(whole)))


def _floor_thousandth(ns: Column) -> Column:
    borrow = F.when(ns % F.lit(1000) < 0, F.lit(1)).otherwise(F.lit(0))
    return F.call_function("div", ns, F.lit(1000)) - borrow


def text_from_nanos(ns: Column) -> Column:
    """ISO text of epoch nanoseconds; outside 64 bits the number itself, marked as such."""
    wide = ns.cast("decimal(38,0)")
    inside = (wide >= F.lit(NANOS_MIN).cast("decimal(38,0)")) & (wide <= F.lit(NANOS_MAX).cast("decimal(38,0)"))
    moment = F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(
        secs=(F.floor(F.when(inside, wide) / F.lit(1000)) / F.lit(1_000_000)).cast("decimal(18,6)")
    )
    fraction = F.date_format(moment, "SSSSSS")
    iso = F.when(fraction == "000000", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return F.when(inside, iso).otherwise(F.concat(F.lit("TIMESTAMP_NS:"), wide.cast("string")))


def date_from_text(c: Column, on_error: str = "null", path: str = "") -> Column:
    """Text to date; a time part after ``T`` is cut off."""
    day = F.when(F.contains(c, F.lit("T")), F.substring(c, 1, 10)).otherwise(c)
    parsed = F.when(day.rlike(f"^{DAY}$"), day).try_cast("date")
    return _settle_failures(parsed, c, "null" if on_error == "null" else "raise", "date", path)


def uint64_from_text(c: Column, on_error: str = "raise", path: str = "") -> Column:
    """Digits to decimal(20,0) within 0 … 2^64-1."""
    digits = F.trim(c.cast("string"))
    largest = str(UINT64_MAX)
    plain = F.ltrim(digits, F.lit("+0"))
    inside = (F.length(plain) < len(largest)) | ((F.length(plain) == len(largest)) & (plain <= largest))
    parsed = F.when(digits.rlike(r"^\+?\d+$") & inside, digits).try_cast("decimal(20,0)")
    return _settle_failures(parsed, c, "null" if on_error == "null" else "raise", "uint64", path)


def uuid_bytes(c: Column) -> Column:
    """UUID text to its 16 bytes; null if it is not a UUID."""
    return F.unhex(F.when(c.rlike(UUID_TEXT), F.replace(c, F.lit("-"), F.lit(""))))


def uuid_text(c: Column) -> Column:
    """UUID text in canonical lower case; null if it is not a UUID."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    dashed = F.concat_ws("-", *[F.substring(c, start, size) for start, size in cuts])
    return F.when(c.rlike(UUID_TEXT), F.lower(F.when(F.length(c) == 36, c).otherwise(dashed)))
