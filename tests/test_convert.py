"""Parsing of text into typed values, and declared schemas."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument
from tidemark.functions import binary_rows, delete_vectors, json_rows, literals, scalars
from tidemark.functions import types as ty
from tidemark.operators import policy
from tidemark.sources import cdc


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "value"), [("2024-03-15", 19797), ("2024/03/15", None), ("2024-3-5", None), ("2024-02-30", None)])
def test_date(spark, text, value):
    assert one(spark, text, lambda c: F.datediff(scalars.date_value(c), F.lit("1970-01-01").cast("date"))) == value


@pytest.mark.parametrize(("text", "value"), [("14:30:45", 52_245_000_000), ("09:15:30.123456", 33_330_123_456), ("25:00:00", None)])
def test_time(spark, text, value):
    assert one(spark, text, scalars.time_micros) == value


@pytest.mark.parametrize(("text", "zone", "value"), [("1970-01-01T00:00:01Z", "UTC", 1_000_000), ("1970-01-01T02:00:00.5+02:00", "UTC", 500_000), ("1970-01-01 01:00:00", "Europe/Berlin", 0), ("2024-10-27T02:30:00", "Europe/Berlin", 1_729_989_000_000_000), ("yesterday", "UTC", None)])
def test_timestamp(spark, text, zone, value):
    assert one(spark, text, lambda c: scalars.timestamp_micros(c, zone)) == value


@pytest.mark.parametrize(
    ("text", "p", "s", "value", "error"),
    [("123.45", 5, 2, "123.45", None), ("1.239", 5, 2, None, "scale"), ("12345.6", 5, 2, None, "precision"), ("1234", 5, 2, None, "integer"), ("x", 5, 2, None, "invalid"), ("9976", 2, -3, "10000", None), ("0.00123", 3, 5, "0.00123", None), ("1.5", 3, 5, None, "integer"), ("-0.5", 3, 1, "-0.5", None)],
)
def test_decimal(spark, text, p, s, value, error):
    assert one(spark, text, lambda c: scalars.decimal_error(c, p, s)) == error
    got = one(spark, text, lambda c: scalars.decimal_value(c, p, s))
    assert (got is None) == (value is None) and (value is None or got == Decimal(value))


def test_array_and_composite_literals():
    assert literals.parse_array('{a,"b,c",NULL,"null","q\\"x",""}') == ["a", "b,c", None, "null", 'q"x', ""]
    assert literals.parse_array("{}") == [] and literals.parse_array(None) is None
    assert literals.parse_composite('(1,"a ""b"" c",)', 3) == ["1", 'a "b" c', None]
    with pytest.raises(ValueError):
        literals.parse_array("a,b")
    with pytest.raises(ValueError):
        literals.parse_composite("(1)", 2)


def test_json_rows(spark):
    schema = ty.struct_from_fields([
        {"name": "id", "data_type": "int32"},
        {"name": "price", "data_type": "decimal(5,2)", "nullable": True},
        {"name": "user", "data_type": "struct", "nullable": True, "fields": [{"name": "name", "data_type": "string", "nullable": True}, {"name": "tags", "data_type": "list", "nullable": True, "item": {"data_type": "string"}}]},
    ])
    good = {"id": 1, "price": "1.50", "user": {"name": "n", "tags": ["a", "b"]}, "more": 1}
    bad = [({**good, "id": 2**31}, "id: expected int"), ({**good, "price": 1.5}, "price: expected decimal(5,2) as a string"), ({**good, "user": {"tags": ["a", 1]}}, "user.tags.item[1]: expected string"), ({"id": 1, "user": None}, "price: missing"), ({**good, "user": {"tags": None}}, "user.tags: null isn't allowed"), ({**good, "id": None}, "id: null isn't allowed")]
    lines = spark.createDataFrame([(json.dumps(x),) for x in [good, {**good, "user": {"tags": []}}, *[b for b, _ in bad]]] + [("[1]",), ("{",)], "value string")
    rows, errors = json_rows.rows_and_errors(lines, schema)
    assert [r.asDict(True) for r in rows.orderBy(F.desc("user.name")).collect()] == [{"id": 1, "price": Decimal("1.50"), "user": {"name": "n", "tags": ["a", "b"]}}, {"id": 1, "price": Decimal("1.50"), "user": {"name": None, "tags": []}}]
    assert sorted(r["error"] for r in errors.collect()) == sorted([e for _, e in bad] + ["not a JSON object"] * 2)


def test_a_line_is_parsed_once(spark):
    schema = ty.struct_from_fields([{"name": "id", "data_type": "int64"}, {"name": "tags", "data_type": "list", "item": {"data_type": "string"}}])
    rows, _ = json_rows.rows_and_errors(spark.range(2).selectExpr("CAST(id AS string) AS value"), schema)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1


def test_schemas():
    s = ty.struct_from_fields([{"name": "a", "data_type": "Int64"}, {"name": "s", "data_type": "struct", "fields": [{"name": "b", "data_type": "text"}]}, {"name": "c", "data_type": "bool"}])
    assert [s["a"].metadata["field_id"], s["s"].metadata["field_id"], s["s"].dataType["b"].metadata["field_id"], s["c"].metadata["field_id"]] == [0, 1, 2, 3]
    for bad in ({"name": "x", "data_type": "nope"}, {"name": "x", "data_type": "list", "item": {"data_type": "struct"}}, {"name": "x", "data_type": "decimal(60,2)"}):
        with pytest.raises(InvalidArgument):
            ty.struct_from_fields([bad])
    assert ty.numeric_typmod((12 << 16 | 5) + 4) == (12, 5) and ty.numeric_typmod(-1) is None and ty.numeric_typmod((2 << 16 | (-3 & 0x7FF)) + 4) == (2, -3)
    assert ty.postgres_type("int4[]") == T.ArrayType(T.IntegerType(), True) and ty.postgres_type("mood") == T.StringType()
    with pytest.raises(InvalidArgument):
        ty.struct_from_avro({"type": "record", "name": "r", "fields": [{"name": "x", "type": ["int", "string"]}]})


def zigzag(n):
    n = n << 1 ^ n >> 63
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def test_avro(spark):
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "id", "type": "int"}, {"name": "name", "type": ["null", "string"]}, {"name": "m", "type": {"type": "map", "values": "long"}}]})
    datum = zigzag(-5) + zigzag(1) + zigzag(2) + b"hi" + zigzag(1) + zigzag(1) + b"k" + zigzag(300) + zigzag(0)
    row = binary_rows.decode_avro(spark.createDataFrame([(datum,)], "value binary"), schema).first()
    assert row.asDict(True) == {"id": -5, "name": "hi", "m": [{"key": "k", "value": 300}]}
    with pytest.raises(ValueError):
        binary_rows.AvroReader(schema).read(datum + b"x")


def test_protobuf(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("price", T.DecimalType(5, 2))])
    m = binary_rows.row_message(schema)(id=-3, tags=["a"], price="1.25")
    row = binary_rows.decode_protobuf(spark.createDataFrame([(m.SerializeToString(),), (b"",)], "value binary"), schema).collect()
    assert row[0].asDict() == {"id": -3, "tags": ["a"], "price": Decimal("1.25")} and row[1]["id"] is None


def test_delete_vector_blob(spark):
    rows = [0, 5, 6, 7, 1 << 33]
    blob = delete_vectors.encode(spark, rows)
    assert blob[4:8] == bytes.fromhex("D1D33964") and delete_vectors.decode(spark, blob) == rows
    with pytest.raises(ValueError):
        delete_vectors.decode(spark, blob[:-1] + bytes([blob[-1] ^ 1]))


def test_blobs_of_tasks_are_those_of_the_bitmap_classes(spark):
    sets = {
        "few": [0, 5, 6, 7, 1 << 33], "one": [70000], "last": [(1 << 40) - 1], "run": list(range(100, 9000)), "edge": list(range(3)) + [1 << 16], "array": list(range(0, 8192, 2)), "bitset": list(range(0, 8194, 2)), "full": list(range(1 << 16)),
        "pairs": [x for i in range(0, 60000, 4) for x in (i, i + 1)], "many": [i << 16 | j for i in range(6) for j in range(i + 1)], "mixed": list(range(70000)) + list(range(140000, 260000, 3)) + [1 << 34, (1 << 34) + 1], "high": [-1, 5, -(1 << 40)],
    }
    rows = spark.createDataFrame([(f, r) for f, s in sets.items() for r in s] + [(None, 3), ("few", 5), ("few", None)], "file string, row_index bigint")
    got = delete_vectors.blobs(rows.repartition(3)).cache()
    assert {r["file"]: bytes(r["blob"]) for r in got.collect()} == {f: delete_vectors.encode(spark, s) for f, s in {**sets, None: [3]}.items()}
    back = delete_vectors.positions(got).collect()
    assert len(back) == sum(map(len, sets.values())) + 1 and {tuple(r) for r in back} == {(f, r) for f, s in sets.items() for r in s} | {(None, 3)}
    damaged = got.where("file = 'few'").selectExpr("file", "substr(blob, 1, length(blob) - 1) AS blob")
    with pytest.raises(Exception, match="damaged"):
        delete_vectors.positions(damaged).collect()


def test_blobs_leave_the_positions_in_tasks(spark):
    rows = spark.range(3).selectExpr("'f' AS file", "id AS row_index")
    assert "LocalTableScan" not in delete_vectors.positions(delete_vectors.blobs(rows))._jdf.queryExecution().executedPlan().toString()


def test_copy_text(spark):
    lines = spark.createDataFrame([("1\ta\\tb\\\\n\tt",), ("2\t\\N\tf",)], "value string")
    got = cdc.copy_text(lines, [("id", "int4"), ("name", "text"), ("ok", "bool")]).collect()
    assert [tuple(r) for r in got] == [(1, "a\tb\\n", True), (2, None, False)]


def test_messages(spark):
    rows = [("I", 1, 0, None, None, (1, "a")), ("U", 2, 1, None, (1, "a"), (1, "b")), ("C", 3, 2, None, None, None)]
    messages = spark.createDataFrame(rows, "op string, lsn bigint, seq int, xact_id int, old struct<k:int,v:string>, new struct<k:int,v:string>")
    from tidemark.operators import changelog as cl

    live = cl.reduce(cl.resolve(cdc.changelog_from_messages(messages)), cl.Identity.key("k"))
    assert [tuple(r) for r in live.collect()] == [(1, "b")]


def test_policies():
    assert policy.range_shards(10, 3) == [(0, 4), (4, 8), (8, None)] and len(policy.ctid_predicates(100, 4)) == 4
    indexes = [policy.IndexInfo(("a",), unique=True, partial=True), policy.IndexInfo(("b",)), policy.IndexInfo(("c",), primary=True)]
    assert policy.discover_key(indexes, {"a", "b", "c"}) == ("c",) and policy.discover_key(indexes, {"b"}) == ("b",) and policy.discover_key(indexes, set()) is None
    assert policy.persisted_table_lsn(5, 5, 9) == 9 and policy.persisted_table_lsn(4, 5, 9) == 4 and policy.persisted_table_lsn(None, None, 9) == 9
    assert policy.may_read(8, 5, 5, 9) and not policy.may_read(8, 5, 6, 9)
    assert policy.should_persist(0, 1000, 0, 5, None) and not policy.should_persist(1, 0, 0, 5, 4)
