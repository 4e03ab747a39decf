"""Avro data and protobuf rows to typed columns, decoded in Arrow batches.

Spark's own decoders need jars that aren't everywhere; where they are, they can be used
instead.  Both decoders here take one datum per binary value.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.types import struct_from_avro

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class AvroReader:
    """Reads data of one schema from bytes."""

    def __init__(self, schema: str | dict):
        self.schema = json.loads(schema) if isinstance(schema, str) else schema
        self.named: dict[str, dict] = {}
        self._collect(self.schema)

    def _collect(self, s) -> None:
        if isinstance(s, list):
            for x in s:
                self._collect(x)
        elif isinstance(s, dict):
            if s["type"] in ("record", "enum", "fixed"):
                self.named[s["name"]] = s
            for f in s.get("fields", []):
                self._collect(f["type"])
            for k in ("items", "values"):
                if k in s:
                    self._collect(s[k])
            if isinstance(s["type"], (dict, list)):
                self._collect(s["type"])

    def read(self, data: bytes):
        value, at = self._value(self.schema, data, 0)
        if at != len(data):
            raise ValueError(f"{len(data) - at} bytes are left over")
        return value

    @staticmethod
    def _long(data: bytes, at: int) -> tuple[int, int]:
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return (out >> 1) ^ -(out & 1), at
            shift += 7

    def _bytes(self, data: bytes, at: int) -> tuple[bytes, int]:
        n, at = self._long(data, at)
        if n < 0 or at + n > len(data):
            raise ValueError("a length runs past the end")
        return data[at : at + n], at + n

    def _blocks(self, data: bytes, at: int, one) -> tuple[list, int]:
        out = []
        while True:
            n, at = self._long(data, at)
            if n == 0:
                return out, at
            if n < 0:  # a block that tells its size
                n, (_, at) = -n, self._long(data, at)
            for _ in range(n):
                v, at = one(data, at)
                out.append(v)

    def _value(self, s, data: bytes, at: int):
        if isinstance(s, list):
            i, at = self._long(data, at)
            return self._value(s[i], data, at)
        if isinstance(s, str) and s in self.named:
            s = self.named[s]
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, (dict, list)):
            return self._value(kind, data, at)
        logical = s.get("logicalType") if isinstance(s, dict) else None
        if kind == "null":
            return None, at
        if kind == "boolean":
            return data[at] == 1, at + 1
        if kind in ("int", "long"):
            v, at = self._long(data, at)
            return self._logical(logical, v), at
        if kind == "float":
            return struct.unpack_from("<f", data, at)[0], at + 4
        if kind == "double":
            return struct.unpack_from("<d", data, at)[0], at + 8
        if kind in ("bytes", "string"):
            v, at = self._bytes(data, at)
            if logical == "decimal":
                return Decimal(int.from_bytes(v, "big", signed=True)).scaleb(-int(s.get("scale", 0))), at
            return (v.decode() if kind == "string" else v), at
        if kind == "fixed":
            v = data[at : at + s["size"]]
            if logical == "decimal":
                return Decimal(int.from_bytes(v, "big", signed=True)).scaleb(-int(s.get("scale", 0))), at + s["size"]
            return v, at + s["size"]
        if kind == "enum":
            i, at = self._long(data, at)
            return s["symbols"][i], at
        if kind == "array":
            return self._blocks(data, at, lambda d, a: self._value(s["items"], d, a))
        if kind == "map":
            def pair(d: bytes, a: int):
                k, a = self._bytes(d, a)
                v, a = self._value(s["values"], d, a)
                return {"key": k.decode(), "value": v}, a

            return self._blocks(data, at, pair)
        if kind == "record":
            out = {}
            for f in s["fields"]:
                out[f["name"]], at = self._value(f["type"], data, at)
            return out, at
        raise ValueError(f"unknown Avro type {kind!r}")

    @staticmethod
    def _logical(logical: str | None, v: int):
        if logical == "date":
            return date(1970, 1, 1) + timedelta(days=v)
        if logical == "time-millis":
            return v * 1000
        if logical and "timestamp-" in logical:
            moment = _EPOCH + timedelta(microseconds=v * (1000 if logical.endswith("millis") else 1))
            return moment.replace(tzinfo=None) if logical.startswith("local") else moment
        return v


def decode_avro(data: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of the record schema; a damaged datum raises."""
    target = struct_from_avro(schema)
    return _decode(data, column, target, lambda: AvroReader(schema).read)


def row_message(schema: T.StructType):
    """A protobuf message class for rows of a schema: field n+1 is column n; nested structs are messages, lists repeated."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    file = descriptor_pb2.FileDescriptorProto(name="tidemark_row.proto", package="tidemark", syntax="proto3")
    D = descriptor_pb2.FieldDescriptorProto
    simple = {T.ShortType: D.TYPE_SINT32, T.IntegerType: D.TYPE_SINT32, T.LongType: D.TYPE_SINT64, T.FloatType: D.TYPE_FLOAT, T.DoubleType: D.TYPE_DOUBLE, T.BooleanType: D.TYPE_BOOL, T.StringType: D.TYPE_STRING, T.BinaryType: D.TYPE_BYTES, T.DateType: D.TYPE_SINT32, T.TimestampType: D.TYPE_SINT64, T.TimestampNTZType: D.TYPE_SINT64, T.DecimalType: D.TYPE_STRING}

    def message(name: str, fields: list[T.StructField]) -> None:
        m = file.message_type.add(name=name)
        for i, f in enumerate(fields):
            kind, repeated = f.dataType, isinstance(f.dataType, T.ArrayType)
            kind = kind.elementType if repeated else kind
            own = m.field.add(name=f.name, number=i + 1, label=D.LABEL_REPEATED if repeated else D.LABEL_OPTIONAL)
            if isinstance(kind, T.StructType):
                own.type, own.type_name = D.TYPE_MESSAGE, f".tidemark.{name}_{f.name}"
                message(f"{name}_{f.name}", kind.fields)
            else:
                own.type = simple[type(kind)]
                if not repeated:
                    own.proto3_optional = True
                    own.oneof_index = len(m.oneof_decl)
                    m.oneof_decl.add(name=f"_{f.name}")

    message("Row", schema.fields)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("tidemark.Row"))


def _from_message(m, schema: T.StructType) -> dict:
    out = {}
    for f in schema.fields:
        kind, v = f.dataType, getattr(m, f.name)
        if isinstance(kind, T.ArrayType):
            out[f.name] = [_from_message(x, kind.elementType) if isinstance(kind.elementType, T.StructType) else _plain(x, kind.elementType) for x in v]
        elif not m.HasField(f.name):
            out[f.name] = None
        else:
            out[f.name] = _from_message(v, kind) if isinstance(kind, T.StructType) else _plain(v, kind)
    return out


def _plain(v, kind: T.DataType):
    if isinstance(kind, T.DecimalType):
        return Decimal(v)
    if isinstance(kind, T.DateType):
        return date(1970, 1, 1) + timedelta(days=v)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        moment = _EPOCH + timedelta(microseconds=v)
        return moment.replace(tzinfo=None) if isinstance(kind, T.TimestampNTZType) else moment
    return v


def decode_protobuf(data: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    def reader():
        cls = row_message(schema)

        def read(raw: bytes) -> dict:
            m = cls()
            m.ParseFromString(raw)
            return _from_message(m, schema)

        return read

    return _decode(data, column, schema, reader)


def _to_message(m, row: dict, schema: T.StructType) -> None:
    for f in schema.fields:
        kind, v = f.dataType, row[f.name]
        if v is None:
            continue
        if isinstance(kind, T.ArrayType):
            for x in v:
                if isinstance(kind.elementType, T.StructType):
                    _to_message(getattr(m, f.name).add(), x, kind.elementType)
                else:
                    getattr(m, f.name).append(_wire(x, kind.elementType))
        elif isinstance(kind, T.StructType):
            getattr(m, f.name).SetInParent()
            _to_message(getattr(m, f.name), v, kind)
        else:
            setattr(m, f.name, _wire(v, kind))


def _wire(v, kind: T.DataType):
    if isinstance(kind, T.DecimalType):
        return str(v)
    if isinstance(kind, T.DateType):
        return (v - date(1970, 1, 1)).days
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        moment = v if v.tzinfo else v.replace(tzinfo=UTC)
        return (moment - _EPOCH) // timedelta(microseconds=1)
    return v


def encode_protobuf(rows: DataFrame, column: str = "value") -> DataFrame:
    """One message per row, as decode_protobuf reads it; a null list is an empty one."""
    schema = rows.schema

    def writer():
        cls = row_message(schema)

        def write(row: dict) -> bytes:
            m = cls()
            _to_message(m, row, schema)
            return m.SerializeToString()

        return write

    return _encode(rows, column, writer)


class AvroWriter:
    """Writes data of one record schema: null, boolean, int, long, float, double, string, bytes, arrays, records, and unions of null and one of these."""

    def __init__(self, schema: str | dict):
        self.schema = json.loads(schema) if isinstance(schema, str) else schema

    def write(self, row: dict) -> bytes:
        out = bytearray()
        self._value(self.schema, row, out)
        return bytes(out)

    @staticmethod
    def _long(v: int, out: bytearray) -> None:
        v = v << 1 ^ v >> 63
        while v > 0x7F:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        out.append(v)

    def _value(self, s, v, out: bytearray) -> None:
        if isinstance(s, list):
            at = s.index("null") if v is None else next(i for i, x in enumerate(s) if x != "null")
            self._long(at, out)
            self._value(s[at], v, out)
            return
        kind = s["type"] if isinstance(s, dict) else s
        if kind == "null":
            return
        if kind == "boolean":
            out.append(bool(v))
        elif kind in ("int", "long"):
            self._long(v, out)
        elif kind in ("float", "double"):
            out += struct.pack("<f" if kind == "float" else "<d", v)
        elif kind in ("string", "bytes"):
            raw = v.encode() if kind == "string" else v
            self._long(len(raw), out)
            out += raw
        elif kind == "array":
            if v:
                self._long(len(v), out)
            for x in v:
                self._value(s["items"], x, out)
            self._long(0, out)
        elif kind == "record":
            for f in s["fields"]:
                self._value(f["type"], v[f["name"]], out)
        else:
            raise ValueError(f"can't write Avro type {kind!r}")


def encode_avro(rows: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """One datum per row of the record schema."""
    return _encode(rows, column, lambda: AvroWriter(schema).write)


def _encode(rows: DataFrame, column: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([write(r) for r in batch.to_pylist()], pa.binary())], [column])

    return rows.mapInArrow(run, f"{column} binary")


def _decode(data: DataFrame, column: str, target: T.StructType, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, arrow = make(), to_arrow_schema(target)
        for batch in batches:
            rows = [read(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return data.select(column).mapInArrow(run, target)
