"""Declared schemas as Spark types: field lists, Avro schemas and Postgres types.

Field ids go into field metadata as `field_id`, numbered depth first from 0.  A time of
day is a LongType of microseconds with `logical: time64` in its metadata.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import count

from pyspark.sql import types as T

from tidemark.errors import InvalidArgument

#: Names of types in a declared field list, in lower case.
_SIMPLE = {
    "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "string": T.StringType(), "text": T.StringType(), "boolean": T.BooleanType(), "bool": T.BooleanType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "date32": T.DateType(),
}


def decimal_type(precision: int, scale: int) -> T.DecimalType:
    """The Spark type that holds decimal(precision, scale) values; Spark knows neither negative scales nor scales beyond the precision."""
    if precision < 1 or precision > 38:
        raise InvalidArgument(f"decimal precision {precision} isn't in 1 to 38")
    p, s = (precision - scale, 0) if scale < 0 else (max(precision, scale), scale)
    if p > 38:
        raise InvalidArgument(f"decimal({precision},{scale}) needs over 38 digits")
    return T.DecimalType(p, s)


def _decimal(name: str) -> tuple[T.DataType, dict]:
    m = re.fullmatch(r"decimal\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\)", name)
    if not m:
        raise InvalidArgument(f"unknown type {name!r}")
    p, s = int(m[1]), int(m[2] or 0)
    return decimal_type(p, s), {"precision": p, "scale": s}


def struct_from_fields(fields: list[dict], ids: Iterator[int] | None = None) -> T.StructType:
    """[{name, data_type, nullable, fields?, item?}] as a StructType."""
    ids = count() if ids is None else ids
    return T.StructType([_field(f, ids) for f in fields])


def _field(f: dict, ids: Iterator[int]) -> T.StructField:
    if not f.get("name"):
        raise InvalidArgument("a field needs a name")
    name, extra = str(f["data_type"]).strip().lower(), {}
    number = next(ids)
    if name == "struct":
        if not f.get("fields"):
            raise InvalidArgument(f"struct {f['name']} has no fields")
        kind: T.DataType = struct_from_fields(f["fields"], ids)
    elif name in ("list", "array"):
        item = f.get("item")
        if not item:
            raise InvalidArgument(f"list {f['name']} has no item")
        if str(item["data_type"]).lower() in ("list", "array", "struct"):
            raise InvalidArgument(f"items of list {f['name']} must be simple")
        inner = _field({"name": "item", **item}, ids)
        kind = T.ArrayType(inner.dataType, inner.nullable)
    elif name in _SIMPLE:
        kind = _SIMPLE[name]
    else:
        kind, extra = _decimal(name)
    return T.StructField(f["name"], kind, bool(f.get("nullable", False)), {"field_id": number, **extra})


#: Avro's primitive and logical types.
_AVRO = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
_AVRO_LOGICAL = {"date": T.DateType(), "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType(), "local-timestamp-millis": T.TimestampNTZType(), "local-timestamp-micros": T.TimestampNTZType(), "time-micros": T.LongType(), "time-millis": T.LongType(), "uuid": T.StringType()}


def struct_from_avro(schema: str | dict) -> T.StructType:
    """A record schema. Unions are of null and one other type; maps are lists of (key, value)."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    kind, _ = _avro(schema, {})
    if not isinstance(kind, T.StructType):
        raise InvalidArgument("the top level must be a record")
    ids = count()

    def numbered(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {"field_id": n, **f.metadata}) if not isinstance(f.dataType, (T.StructType, T.ArrayType)) else T.StructField(f.name, numbered(f.dataType), f.nullable, {"field_id": n, **f.metadata}) for f in t.fields for n in [next(ids)]])
        return T.ArrayType(numbered(t.elementType), t.containsNull) if isinstance(t, T.ArrayType) else t

    return numbered(kind)


def _avro(s: str | dict | list, named: dict) -> tuple[T.DataType, bool]:
    """(type, nullable)."""
    if isinstance(s, list):
        others = [x for x in s if x != "null"]
        if len(s) != 2 or len(others) != 1:
            raise InvalidArgument("a union must be of null and one other type")
        return _avro(others[0], named)[0], True
    if isinstance(s, str):
        if s in _AVRO:
            return _AVRO[s], s == "null"
        if s in named:
            return named[s], False
        raise InvalidArgument(f"unknown Avro type {s!r}")
    kind = s["type"]
    if s.get("logicalType") == "decimal":
        return decimal_type(int(s["precision"]), int(s.get("scale", 0))), False
    if s.get("logicalType") in _AVRO_LOGICAL:
        return _AVRO_LOGICAL[s["logicalType"]], False
    if kind == "record":
        fields = []
        for f in s["fields"]:
            t, nullable = _avro(f["type"], named)
            fields.append(T.StructField(f["name"], t, nullable))
        named[s["name"]] = T.StructType(fields)
        return named[s["name"]], False
    if kind == "array":
        t, nullable = _avro(s["items"], named)
        return T.ArrayType(t, nullable), False
    if kind == "map":
        t, nullable = _avro(s["values"], named)
        return T.ArrayType(T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", t, nullable)]), False), False
    if kind == "enum":
        named[s["name"]] = T.StringType()
        return T.StringType(), False
    if kind == "fixed":
        named[s["name"]] = T.BinaryType()
        return T.BinaryType(), False
    return _avro(kind, named)


def numeric_typmod(modifier: int) -> tuple[int, int] | None:
    """(precision, scale) that a Postgres numeric's type modifier packs; None: unbounded. The scale is an 11-bit signed number."""
    if modifier < 4:
        return None
    packed = modifier - 4
    scale = packed & 0x7FF
    return packed >> 16 & 0xFFFF, scale - 0x800 if scale >= 0x400 else scale


#: Postgres types by name.
_POSTGRES = {
    "bool": T.BooleanType(), "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "float4": T.FloatType(), "float8": T.DoubleType(), "oid": T.LongType(),
    "text": T.StringType(), "varchar": T.StringType(), "bpchar": T.StringType(), "char": T.StringType(), "name": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(), "uuid": T.StringType(),
    "bytea": T.BinaryType(), "date": T.DateType(), "time": T.LongType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
}
#: An unbounded numeric is stored with these.
UNBOUNDED_NUMERIC = (38, 10)


def postgres_type(name: str, modifier: int = -1, composite: list[tuple[str, str]] | None = None) -> T.DataType:
    """Arrays are written type[]; unknown types and enums are strings; composite: its (field, type) pairs."""
    if name.endswith("[]"):
        return T.ArrayType(postgres_type(name[:-2], modifier, composite), True)
    if composite is not None:
        return T.StructType([T.StructField(f, postgres_type(t), True) for f, t in composite])
    if name == "numeric":
        return decimal_type(*(numeric_typmod(modifier) or UNBOUNDED_NUMERIC))
    return _POSTGRES.get(name, T.StringType())


def struct_from_postgres(columns: list[dict]) -> T.StructType:
    """[{name, type, modifier?, nullable?, composite?}]."""
    return T.StructType([T.StructField(c["name"], postgres_type(c["type"], c.get("modifier", -1), c.get("composite")), c.get("nullable", True), {"field_id": i} | ({"logical": "time64"} if c["type"] == "time" else {})) for i, c in enumerate(columns)])
