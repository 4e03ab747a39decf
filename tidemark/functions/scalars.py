"""Strict parsing of text into typed values, as Column expressions.

Each *_value gives null for text that it rejects; callers that must tell a null from a
rejection compare with the input's null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.types import decimal_type

_DAY = 86_400_000_000


def date_value(text: Column) -> Column:
    """YYYY-MM-DD only."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def time_micros(text: Column) -> Column:
    """HH:MM:SS with an optional fraction, as microseconds since midnight."""
    part = lambda i: F.regexp_extract(text, r"^([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(?:\.(\d{1,9}))?$", i)
    whole = (part(1).cast("bigint") * 3600 + part(2).cast("bigint") * 60 + part(3).cast("bigint")) * 1_000_000
    return F.when(text.rlike(r"^([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(\.\d{1,9})?$"), whole + F.substring(F.rpad(part(4), 9, "0"), 1, 6).cast("bigint"))


def timestamp_micros(text: Column, zone: str = "UTC") -> Column:
    """RFC 3339, or a local time of `zone` (the earlier of two in an overlap), as microseconds since the epoch."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?"
    local = F.try_to_timestamp(F.concat(F.translate(F.regexp_extract(text, shape, 0), "Tt", "  "), F.lit("Z")))
    offset = F.regexp_extract(text, r"([Zz]|[+-]\d{2}:\d{2})$", 1)
    hours, minutes = F.substring(offset, 2, 2).cast("bigint"), F.substring(offset, 5, 2).cast("bigint")
    seconds = F.when(F.upper(offset) == "Z", 0).otherwise(F.when(offset.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60))
    absolute = F.unix_micros(local) - seconds * 1_000_000
    return F.when(text.rlike(shape + r"([Zz]|[+-]\d{2}:\d{2})$"), absolute).when(text.rlike(shape + "$"), F.unix_micros(F.to_utc_timestamp(local, zone)))


def _digits(text: Column) -> tuple[Column, Column, Column]:
    """(is a number, significant digits, scale); trailing zeros of the fraction count."""
    shape = r"^[+-]?(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$"
    whole, fraction, power = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    digits = F.regexp_replace(F.concat(whole, fraction), r"^0+(?=\d)", "")
    return text.rlike(shape) & text.rlike(r"\d"), F.length(digits), F.length(fraction) - F.coalesce(F.when(power != "", power).cast("int"), F.lit(0))


def decimal_error(text: Column, precision: int, scale: int) -> Column:
    """Why decimal(precision, scale) rejects the text: invalid, precision, scale or integer; null: it doesn't."""
    number, digits, own_scale = _digits(text)
    rounded = _rounded(text, precision, scale)
    if scale < 0:
        return F.when(~number, "invalid").when(rounded.isNull(), "precision")
    if scale > precision:
        used = F.length(F.regexp_replace(F.regexp_replace(rounded.cast("string"), r"^-?0*\.?0*", ""), r"\D", ""))
        return F.when(~number, "invalid").when(rounded.isNull(), "integer").when(used > precision, "precision")
    return F.when(~number, "invalid").when(digits > precision, "precision").when(own_scale > scale, "scale").when(digits - own_scale > precision - scale, "integer")


def _rounded(text: Column, precision: int, scale: int) -> Column:
    kind = decimal_type(precision, scale)
    exact = text.try_cast(f"decimal(38,{max(scale, 0) if scale > precision else 10 if scale < 0 else scale})")
    if scale < 0:
        return F.round(exact, scale).try_cast(kind)
    return exact.try_cast(kind)


def decimal_value(text: Column, precision: int, scale: int) -> Column:
    """The value as Spark's decimal: a scale within the precision rejects what doesn't fit exactly; a negative scale rounds half away from zero to tens; a scale beyond the precision rounds half up and allows no whole part."""
    return F.when(decimal_error(text, precision, scale).isNull(), _rounded(text, precision, scale))


def postgres_numeric(text: Column, precision: int, scale: int) -> Column:
    """Not-a-number and the infinities are null."""
    return F.when(F.lower(text).isin("nan", "infinity", "-infinity"), F.lit(None)).otherwise(text.try_cast(decimal_type(precision, scale)))


def postgres_bool(text: Column) -> Column:
    return F.when(text == "t", True).when(text == "f", False)


def bytea(text: Column) -> Column:
    r"""\x and hex digits."""
    return F.when(text.rlike(r"^\\x([0-9A-Fa-f]{2})*$"), F.unhex(F.substring(text, 3, 1 << 30)))


def uuid_text(text: Column) -> Column:
    """Canonical lower case; accepts it with or without hyphens and braces."""
    hexes = F.lower(F.regexp_replace(text, r"[-{}]", ""))
    parts = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(hexes.rlike(r"^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def postgres_value(text: Column, name: str, precision: int = 38, scale: int = 10) -> Column:
    """A Postgres text value of a scalar type."""
    simple = {"int2": "smallint", "int4": "int", "int8": "bigint", "oid": "bigint", "float4": "float", "float8": "double"}
    if name in simple:
        return text.try_cast(simple[name])
    return {
        "bool": postgres_bool, "bytea": bytea, "date": date_value, "time": time_micros, "uuid": uuid_text,
        "timestamp": lambda x: F.timestamp_micros(timestamp_micros(x)).cast("timestamp_ntz"),
        "timestamptz": lambda x: F.timestamp_micros(timestamp_micros(F.regexp_replace(x, r"([+-]\d{2})$", "$1:00"))),
        "numeric": lambda x: postgres_numeric(x, precision, scale), "char": lambda x: F.rtrim(x), "bpchar": lambda x: F.rtrim(x),
        "json": lambda x: F.when(F.try_parse_json(x).isNotNull(), x), "jsonb": lambda x: F.when(F.try_parse_json(x).isNotNull(), x),
    }.get(name, lambda x: x)(text)
