"""Group R: rows from text and nested data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import json_rows, literals, otlp, scalars, types
from tidemark.plans.registry import query


@query("r01_json_props", "SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events")
def r01(spark, sf_dir):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", json_rows.convert(F.col("props"), schema)["value"]["k"].alias("k"))


_SHAPES = """CASE event_id % 6 WHEN 0 THEN '{"a": 1, "b": "x"}' WHEN 1 THEN '{"a": null, "b": "x"}' WHEN 2 THEN '{"b": "x"}' WHEN 3 THEN '{"a": "1", "b": "x"}' WHEN 4 THEN '{"a": 1, "b": null}' ELSE 'nope' END"""


@query("r02_json_null_vs_missing", "SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'a: missing' WHEN 3 THEN 'a: expected int' WHEN 4 THEN 'b: null isn''t allowed' WHEN 5 THEN 'not a JSON object' END AS error, CASE WHEN event_id % 6 = 0 THEN 1 END::INTEGER AS a FROM events")
def r02(spark, sf_dir):
    """A null in a nullable field, a missing field, a wrong type, a null where none may be, and no JSON."""
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType(), False)])
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", json_rows.convert(F.expr(_SHAPES), schema).alias("c"))
    return e.select("event_id", "c.error", "c.value.a")


@query("r03_decimal_parse", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 1000 || '.5')::DECIMAL(12,2) END AS v, CASE WHEN p_partkey % 3 = 0 THEN 'scale' END AS error FROM part")
def r03(spark, sf_dir):
    """Text with too many decimals is rejected, not rounded."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat((F.col("p_partkey") % 1000).cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".125").otherwise(".5"))
    return p.select("p_partkey", scalars.decimal_value(text, 12, 2).alias("v"), scalars.decimal_error(text, 12, 2).alias("error"))


@query("r04_date_time_parse", "SELECT event_id, CAST(ts AS DATE) AS d, epoch_us(ts) % 86400000000 AS t, epoch_us(ts) - 7200000000 AS z FROM events")
def r04(spark, sf_dir):
    """Dates, times of day and instants with an offset, from text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day, time = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss.SSSSSS")
    return e.select("event_id", scalars.date_value(day).alias("d"), scalars.time_micros(time).alias("t"), scalars.timestamp_micros(F.concat(day, F.lit("T"), time, F.lit("+02:00"))).alias("z"))


@query("r05_pg_array_parse", "SELECT conv_id, turn, array_to_string(list_transform(list_value(role, text, NULL, 'null', 'a,b'), lambda x: coalesce(x, '<null>')), '|') AS parts FROM conversations")
def r05(spark, sf_dir):
    r"""Array literals with quotes, backslashes, a null and a quoted "null"."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.when(F.col("text").isNull(), "NULL").otherwise(quoted(F.col("text")))
    role = F.when(F.col("role").isNull(), "NULL").otherwise(quoted(F.col("role")))
    literal = F.concat(F.lit("{"), role, F.lit(","), text, F.lit(',NULL,"null","a,b"}'))
    return c.select("conv_id", "turn", F.array_join(literals.array_elements(literal), "|", "<null>").alias("parts"))


@query("r06_pg_numeric_nan", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN NULL ELSE (p_partkey || '.25')::DECIMAL(12,5) END AS v FROM part")
def r06(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' ELSE concat(cast(p_partkey AS string), '.25') END")
    return p.select("p_partkey", scalars.postgres_numeric(text, 12, 5).alias("v"))


@query("r07_otlp_flatten", "SELECT CASE WHEN event_id % 2 = 0 THEN 'gauge' ELSE 'sum' END AS kind, event_type AS metric_name, user_id::VARCHAR AS host, event_id AS number_int, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 2 END::INTEGER AS temporality, event_id % 2 = 1 AS is_monotonic FROM events UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN 'gauge' ELSE 'sum' END, event_type, user_id::VARCHAR, event_id + 1000000, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 2 END, event_id % 2 = 1 FROM events")
def r07(spark, sf_dir):
    """Each event as a request of one metric with two points."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    point = lambda n: F.format_string('{"timeUnixNano":"1","asInt":"%s"}', (F.col("event_id") + n).cast("string"))
    points = F.format_string('{"dataPoints":[%s,%s],"aggregationTemporality":2,"isMonotonic":true}', point(0), point(1_000_000))
    kind = F.when(F.col("event_id") % 2 == 0, "gauge").otherwise("sum")
    metric = F.format_string('{"name":"%s","unit":"u","%s":%s}', "event_type", kind, points)
    request = F.format_string('{"resourceMetrics":[{"resource":{"attributes":[{"key":"host","value":{"stringValue":"%s"}}]},"scopeMetrics":[{"scope":{"name":"s"},"metrics":[%s]}]}]}', F.col("user_id").cast("string"), metric)
    flat = otlp.flatten_metrics(e.select(request.alias("value")))
    return flat.select("kind", "metric_name", F.col("resource_attributes")[0]["value"]["string_value"].alias("host"), "number_int", "temporality", "is_monotonic")


@query("r08_map_to_entries", "SELECT c_custkey, i::INTEGER AS pos, CASE i WHEN 0 THEN 'name' ELSE 'segment' END AS key, CASE i WHEN 0 THEN c_name ELSE c_mktsegment END AS value FROM customer, generate_series(0, 1) t(i)")
def r08(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", F.posexplode(F.map_entries(F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment"))).alias("pos", "e")).select("c_custkey", "pos", "e.key", "e.value")


@query("r09_bytea_uuid", "SELECT o_orderkey, octet_length(unhex(h)) AS n, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders)")
def r09(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    data = scalars.bytea(F.concat(F.lit("\\x"), F.col("h")))
    return o.select("o_orderkey", F.octet_length(data).cast("bigint").alias("n"), scalars.uuid_text(F.upper("h")).alias("u"))


@query("r10_pg_composite", "SELECT c_custkey, c_custkey::VARCHAR AS a, c_name AS b, NULL::VARCHAR AS c FROM customer")
def r10(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    literal = F.concat(F.lit("("), F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit('",)'))
    return c.select("c_custkey", literals.composite_fields(literal, ["a", "b", "c"]).alias("x")).select("c_custkey", "x.*")


def _requests(spark, sf_dir, metric):
    """Each event as a request of one metric; every other service has a name, and every third point a table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    named = F.when(F.col("event_id") % 2 == 0, F.format_string('{"key":"service.name","value":{"stringValue":"s%s"}},', (F.col("user_id") % 3).cast("string"))).otherwise("")
    refs = '"entityRefs":[{"type":"host","idKeys":["host","missing"],"descriptionKeys":["service.name"]}]'
    resource = F.concat(F.lit('{"attributes":['), named, F.format_string('{"key":"host","value":{"intValue":"%s"}}],', F.col("user_id").cast("string")), F.lit(refs + "}"))
    return e.select(F.concat(F.lit('{"resourceMetrics":[{"resource":'), resource, F.lit(',"scopeMetrics":[{"scope":{"name":"s"},"metrics":['), metric, F.lit("]}]}]}")).alias("value"))


@query("r11_otlp_histogram", "SELECT event_id AS hist_count, event_id / 2.0::DOUBLE AS hist_sum, [0.5::DOUBLE, 1.5::DOUBLE] AS explicit_bounds, [event_id, 2::BIGINT, 3::BIGINT] AS bucket_counts, 1 AS hist_temporality, NULL::BIGINT AS number_int, NULL::BOOLEAN AS is_monotonic, user_id AS host, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS described FROM events")
def r11(spark, sf_dir):
    """Histogram points; the resource's entity names its attributes, and keys that it lacks are left out."""
    point = F.format_string('{"timeUnixNano":"1","count":"%s","sum":%s,"explicitBounds":[0.5,1.5],"bucketCounts":["%s","2","3"]}', F.col("event_id").cast("string"), (F.col("event_id") / 2.0).cast("string"), F.col("event_id").cast("string"))
    metric = F.format_string('{"name":"%s","histogram":{"dataPoints":[%s],"aggregationTemporality":1}}', "event_type", point)
    flat = otlp.flatten_metrics(_requests(spark, sf_dir, metric))
    entity = F.col("resource_entity_refs")[0]
    return flat.select("hist_count", "hist_sum", "explicit_bounds", "bucket_counts", "hist_temporality", "number_int", "is_monotonic", entity["id_pairs"][0]["value"]["int_value"].alias("host"), F.size(entity["description_pairs"]).alias("described"))


@query("r12_otlp_routes", "SELECT CASE WHEN event_id % 2 = 0 THEN 's' || (user_id % 3) ELSE 'unknown' END || '.t' || (event_id % 5) || '.gauge.' || event_type AS \"table\", event_id AS number_int FROM events WHERE event_id % 3 = 0 UNION ALL SELECT NULL, event_id FROM events WHERE event_id % 3 <> 0")
def r12(spark, sf_dir):
    """Points that carry the routing attribute go to a table of their service and metric, each once."""
    routed = F.when(F.col("event_id") % 3 == 0, F.format_string('"attributes":[{"key":"table_id","value":{"stringValue":"t%s"}}],', (F.col("event_id") % 5).cast("string"))).otherwise("")
    point = F.concat(F.lit("{"), routed, F.format_string('"timeUnixNano":"1","asInt":"%s"}', F.col("event_id").cast("string")))
    metric = F.format_string('{"name":"%s","gauge":{"dataPoints":[%s]}}', "event_type", point)
    from tidemark.sources.rows import ingest_otlp_json

    return ingest_otlp_json(_requests(spark, sf_dir, metric)).select("table", "number_int")


@query("r13_pg_composite_array", "SELECT c_custkey, c_custkey::VARCHAR || '/' || c_name || ',' || '-1/<null>' AS parts FROM customer")
def r13(spark, sf_dir):
    """An array of composites: quoted twice, with a null field."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    literal = F.concat(F.lit('{"('), F.col("c_custkey").cast("string"), F.lit(',\\"'), "c_name", F.lit('\\")","(-1,)"}'))
    parts = literals.composite_array(literal, ["a", "b"])
    return c.select("c_custkey", F.array_join(F.transform(parts, lambda x: F.concat(x["a"], F.lit("/"), F.coalesce(x["b"], F.lit("<null>")))), ",").alias("parts"))


@query("r14_decimal_negative_scale", "SELECT o_orderkey, (round(o_orderkey / 100.0) * 100)::DECIMAL(8,0) AS v FROM orders")
def r14(spark, sf_dir):
    """A negative scale rounds to hundreds, halves away from zero."""
    text = F.col("o_orderkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", scalars.decimal_value(text, 6, -2).alias("v"))


_PG_SQL = "SELECT * FROM (VALUES ('bool', 'boolean'), ('bytea', 'binary'), ('date', 'date'), ('float4', 'float'), ('float8', 'double'), ('int2', 'smallint'), ('int4', 'int'), ('int8', 'bigint'), ('int4[]', 'array<int>'), ('json', 'string'), ('mood', 'string'), ('numeric', 'decimal(38,10)'), ('numeric(12,5)', 'decimal(12,5)'), ('numeric(2,-3)', 'decimal(5,0)'), ('text', 'string'), ('timestamp', 'timestamp_ntz'), ('timestamptz', 'timestamp'), ('uuid', 'string')) t(name, type)"


@query("r15_pg_types", _PG_SQL)
def r15(spark, sf_dir):
    """Column types by name and modifier."""
    typmod = lambda p, s: (p << 16 | (s & 0x7FF)) + 4
    named = [(n, n, -1) for n in "bool bytea date float4 float8 int2 int4 int8 int4[] json mood numeric text timestamp timestamptz uuid".split()]
    named += [("numeric(12,5)", "numeric", typmod(12, 5)), ("numeric(2,-3)", "numeric", typmod(2, -3))]
    return spark.createDataFrame([(shown, types.postgres_type(name, modifier).simpleString()) for shown, name, modifier in named], "name string, type string")


@query("r16_pg_scalars", "SELECT event_id, event_id % 2 = 0 AS b, event_id::INTEGER AS i, epoch_us(ts) AS at, 'x' AS c, CASE WHEN event_id % 3 = 0 THEN '{\"a\": 1}' END AS j FROM events")
def r16(spark, sf_dir):
    """Text values of several types; a char is trimmed, bad JSON is null."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = lambda text, kind: scalars.postgres_value(text, kind)
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))
    return e.select("event_id", value(F.when(F.col("event_id") % 2 == 0, "t").otherwise("f"), "bool").alias("b"), value(F.col("event_id").cast("string"), "int4").alias("i"), F.unix_micros(value(stamp, "timestamptz")).alias("at"), value(F.lit("x   "), "bpchar").alias("c"), value(F.when(F.col("event_id") % 3 == 0, '{"a": 1}').otherwise("{"), "jsonb").alias("j"))
