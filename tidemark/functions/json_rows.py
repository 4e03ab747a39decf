"""JSON objects to typed rows, strictly, as Column expressions.

Each value is a (value, error) pair; an error is a text with the value's path, such as
`a.item[1]: expected int32`.  The first error in declaration order counts.  A missing
top-level field is an error even if nullable; a missing nullable child of a struct is
null; a list is never null; a decimal is written as a string; unknown fields are ignored.

What is used more than once is bound to a lambda's variable (`_let`): written twice into the
expression, a line would be parsed, and a value got, dozens of times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars

_RANGE = {"smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value being computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _pair(ok: Column, value: Column, path: Column, what: str) -> Column:
    return _let(F.coalesce(ok, F.lit(False)), lambda ok: F.struct(F.when(ok, value).alias("value"), F.when(~ok, F.concat(path, F.lit(f": expected {what}"))).alias("error")))


def _text(v: Column, kind: T.DataType, value: Column, path: Column, what: str) -> Column:
    return _pair((_kind(v) == "STRING") & value.isNotNull(), value, path, what)


def _value(v: Column, kind: T.DataType, path: Column, meta: dict) -> Column:
    """The pair of a value that is there and isn't null."""
    plain = F.try_variant_get(v, "$", "string")
    if meta.get("logical") == "time64":
        return _text(v, kind, scalars.time_micros(plain), path, "time")
    if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType)):
        name = kind.simpleString()
        low, high = _RANGE[name]
        wide = F.try_variant_get(v, "$", "decimal(38,0)")
        return _pair((_kind(v) == "BIGINT") & wide.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)")), F.try_variant_get(v, "$", name), path, name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _pair(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", kind.simpleString()), path, kind.simpleString())
    if isinstance(kind, T.BooleanType):
        return _pair(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"), path, "boolean")
    if isinstance(kind, T.StringType):
        return _pair(_kind(v) == "STRING", plain, path, "string")
    if isinstance(kind, T.BinaryType):
        return _pair(_kind(v) == "STRING", plain.cast("binary"), path, "string")
    if isinstance(kind, T.DecimalType):
        p, s = meta.get("precision", kind.precision), meta.get("scale", kind.scale)
        return _text(v, kind, scalars.decimal_value(plain, p, s), path, f"decimal({p},{s}) as a string")
    if isinstance(kind, T.DateType):
        return _text(v, kind, scalars.date_value(plain), path, "date")
    if isinstance(kind, T.TimestampType):
        return _text(v, kind, F.timestamp_micros(scalars.timestamp_micros(plain, meta.get("zone", "UTC"))), path, "timestamp")
    if isinstance(kind, T.TimestampNTZType):
        return _text(v, kind, F.timestamp_micros(scalars.timestamp_micros(plain)).cast("timestamp_ntz"), path, "timestamp")
    if isinstance(kind, T.ArrayType):
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e, i: _nullable(e, T.StructField("item", kind.elementType, kind.containsNull), F.concat(path, F.lit(".item["), i.cast("string"), F.lit("]"))))

        def listed(items: Column) -> Column:
            bad = F.filter(items, lambda x: x["error"].isNotNull())
            error = F.when(~_kind(v).startswith("ARRAY"), F.concat(path, F.lit(": expected list"))).otherwise(F.get(bad, 0)["error"])
            return _let(error, lambda error: F.struct(F.when(error.isNull(), F.transform(items, lambda x: x["value"])).alias("value"), error.alias("error")))

        return _let(items, listed)
    if isinstance(kind, T.StructType):
        parts = [_child(v, f, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return _joined(~_kind(v).startswith("OBJECT"), F.concat(path, F.lit(": expected struct")), parts, kind)
    raise TypeError(f"no conversion to {kind}")


def _joined(wrong: Column, what: Column, parts: list[Column], kind: T.StructType) -> Column:
    """The pair of a struct whose fields' pairs are parts; the error is `what` where it is wrong itself."""
    def done(p: Column) -> Column:
        error = F.when(wrong, what).otherwise(F.coalesce(*[p[f"_{i}"]["error"] for i in range(len(parts))]))
        row = F.struct(*[p[f"_{i}"]["value"].alias(f.name) for i, f in enumerate(kind.fields)])
        return _let(error, lambda error: F.struct(F.when(error.isNull(), row).alias("value"), error.alias("error")))

    return _let(F.struct(*[p.alias(f"_{i}") for i, p in enumerate(parts)]), done)


def _empty(kind: T.DataType, error: Column) -> Column:
    return F.struct(F.lit(None).cast(kind).alias("value"), error.cast("string").alias("error"))


def _nullable(v: Column, f: T.StructField, path: Column) -> Column:
    """The pair of a value that is there, maybe as a JSON null."""
    allowed = f.nullable and not isinstance(f.dataType, T.ArrayType)
    null = F.lit(None) if allowed else F.concat(path, F.lit(": null isn't allowed"))
    return F.when(v.isNull() | F.is_variant_null(v), _empty(f.dataType, null)).otherwise(_value(v, f.dataType, path, f.metadata or {}))


def _child(v: Column, f: T.StructField, path: Column) -> Column:
    missing = F.lit(None) if f.nullable else F.concat(path, F.lit(": missing"))
    return _got(v, f, missing, path)


def _got(v: Column, f: T.StructField, missing: Column, path: Column) -> Column:
    return _let(F.try_variant_get(v, f'$["{f.name}"]', "variant"), lambda own: F.when(own.isNull(), _empty(f.dataType, missing)).otherwise(_nullable(own, f, path)))


def convert(text: Column, schema: T.StructType) -> Column:
    """struct(value struct<schema>, error string) of JSON text."""

    def done(v: Column) -> Column:
        parts = [_got(v, f, F.lit(f"{f.name}: missing"), F.lit(f.name)) for f in schema.fields]
        return _joined(v.isNull() | ~_kind(v).startswith("OBJECT"), F.lit("not a JSON object"), parts, schema)

    return _let(F.try_parse_json(text), done)


def rows_and_errors(lines: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected lines with their errors)."""
    # a filter isn't pushed below an explode, where it would convert each line once more
    done = lines.select(F.col(column).alias("line"), F.explode(F.array(convert(F.col(column), schema))).alias("c"))
    return done.where("c.error IS NULL").select("c.value.*"), done.where("c.error IS NOT NULL").select("line", F.col("c.error").alias("error"))
