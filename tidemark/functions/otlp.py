"""OTLP metrics (in their JSON form) to one row per data point.

Resources, scopes, metrics and points are nested arrays; they are exploded in turn.  A
point is written once, whatever the number of tagged points in its request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANY_JSON = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string>"
_KV_JSON = f"array<struct<key:string,value:{_ANY_JSON}>>"
_EXEMPLAR_JSON = f"struct<timeUnixNano:string,asInt:string,asDouble:double,traceId:string,spanId:string,filteredAttributes:{_KV_JSON}>"
_POINT_JSON = f"struct<attributes:{_KV_JSON},startTimeUnixNano:string,timeUnixNano:string,asInt:string,asDouble:double,count:string,sum:double,min:double,max:double,explicitBounds:array<double>,bucketCounts:array<string>,exemplars:array<{_EXEMPLAR_JSON}>>"
_POINTS_JSON = f"struct<dataPoints:array<{_POINT_JSON}>,aggregationTemporality:int,isMonotonic:boolean>"
_ENTITY_JSON = "struct<schemaUrl:string,type:string,idKeys:array<string>,descriptionKeys:array<string>>"
#: The part of an export request that is read.
REQUEST = (
    f"resourceMetrics array<struct<resource:struct<attributes:{_KV_JSON},entityRefs:array<{_ENTITY_JSON}>>,"
    f"scopeMetrics:array<struct<scope:struct<name:string,attributes:{_KV_JSON}>,"
    f"metrics:array<struct<name:string,unit:string,gauge:{_POINTS_JSON},sum:{_POINTS_JSON},histogram:{_POINTS_JSON}>>>>>>"
)
_ANY = "struct<string_value:string,int_value:bigint,double_value:double,bool_value:boolean,bytes_value:binary>"
_ATTRIBUTES = f"array<struct<key:string,value:{_ANY}>>"


def any_value(v: Column) -> Column:
    """One slot is set; nested lists and maps leave all five null."""
    return F.struct(v["stringValue"].alias("string_value"), v["intValue"].try_cast("bigint").alias("int_value"), v["doubleValue"].alias("double_value"), v["boolValue"].alias("bool_value"), F.unbase64(v["bytesValue"]).alias("bytes_value")).cast(_ANY)


def attributes(kv: Column) -> Column:
    return F.coalesce(F.transform(kv, lambda x: F.struct(x["key"].alias("key"), any_value(x["value"]).alias("value"))), F.array().cast(_ATTRIBUTES)).cast(_ATTRIBUTES)


def _looked_up(keys: Column, kv: Column) -> Column:
    """Key-value pairs of the resource attributes that an entity reference names; unknown keys are left out."""
    return F.filter(attributes(kv), lambda x: F.array_contains(F.coalesce(keys, F.array().cast("array<string>")), x["key"]))


def entity_refs(refs: Column, kv: Column) -> Column:
    one = lambda e: F.struct(e["type"].alias("type"), _looked_up(e["idKeys"], kv).alias("id_pairs"), _looked_up(e["descriptionKeys"], kv).alias("description_pairs"), e["schemaUrl"].alias("schema_url"))
    kind = f"array<struct<type:string,id_pairs:{_ATTRIBUTES},description_pairs:{_ATTRIBUTES},schema_url:string>>"
    return F.coalesce(F.transform(refs, one), F.array().cast(kind)).cast(kind)


def _exemplars(x: Column) -> Column:
    one = lambda e: F.struct(e["timeUnixNano"].cast("bigint").alias("time_unix_nano"), e["asInt"].cast("bigint").alias("as_int"), e["asDouble"].alias("as_double"), F.unhex(e["traceId"]).alias("trace_id"), F.unhex(e["spanId"]).alias("span_id"), attributes(e["filteredAttributes"]).alias("filtered_attributes"))
    kind = f"array<struct<time_unix_nano:bigint,as_int:bigint,as_double:double,trace_id:binary,span_id:binary,filtered_attributes:{_ATTRIBUTES}>>"
    return F.coalesce(F.transform(x, one), F.array().cast(kind)).cast(kind)


def flatten_metrics(requests: DataFrame, column: str = "value") -> DataFrame:
    """Requests as JSON text to points. A gauge has temporality -1 and isn't monotonic; counts, descriptions and versions that the rows don't carry are null."""
    parsed = requests.select(F.from_json(column, REQUEST).alias("q"))
    resource = parsed.select(F.explode("q.resourceMetrics").alias("rm"))
    scope = resource.select("rm.resource", F.explode("rm.scopeMetrics").alias("sm"))
    metric = scope.select("resource", "sm.scope", F.explode("sm.metrics").alias("m"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"m.{k}").alias("data")) for k in ("gauge", "sum", "histogram")])
    typed = metric.select("resource", "scope", "m.name", "m.unit", F.explode(F.filter(kinds, lambda k: k["data"].isNotNull())).alias("k"))
    point = typed.select("resource", "scope", "name", "unit", "k.kind", "k.data", F.explode("k.data.dataPoints").alias("p"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    histogram = F.col("kind") == "histogram"
    only = lambda cond, c, name: F.when(cond, c).alias(name)
    temporality = F.when(F.col("kind") == "gauge", -1).otherwise(F.coalesce("data.aggregationTemporality", F.lit(0)))
    return point.select(
        "kind",
        attributes(F.col("resource.attributes")).alias("resource_attributes"),
        entity_refs(F.col("resource.entityRefs"), F.col("resource.attributes")).alias("resource_entity_refs"),
        null("bigint", "resource_dropped_attributes_count"),
        null("string", "resource_schema_url"),
        F.coalesce("scope.name", F.lit("")).alias("scope_name"),
        null("string", "scope_version"),
        attributes(F.col("scope.attributes")).alias("scope_attributes"),
        null("bigint", "scope_dropped_attributes_count"),
        null("string", "scope_schema_url"),
        F.col("name").alias("metric_name"),
        null("string", "metric_description"),
        F.coalesce("unit", F.lit("")).alias("metric_unit"),
        F.coalesce(F.col("p.startTimeUnixNano").cast("bigint"), F.lit(0).cast("bigint")).alias("start_time_unix_nano"),
        F.coalesce(F.col("p.timeUnixNano").cast("bigint"), F.lit(0).cast("bigint")).alias("time_unix_nano"),
        attributes(F.col("p.attributes")).alias("point_attributes"),
        null("bigint", "point_dropped_attributes_count"),
        only(~histogram, F.col("p.asInt").try_cast("bigint"), "number_int"),
        only(~histogram, F.col("p.asDouble"), "number_double"),
        only(~histogram, temporality.cast("int"), "temporality"),
        only(~histogram, F.coalesce((F.col("kind") == "sum") & F.col("data.isMonotonic"), F.lit(False)), "is_monotonic"),
        only(~histogram, _exemplars(F.col("p.exemplars")), "exemplars"),
        only(histogram, F.col("p.count").try_cast("bigint"), "hist_count"),
        only(histogram, F.col("p.sum"), "hist_sum"),
        only(histogram, F.col("p.min"), "hist_min"),
        only(histogram, F.col("p.max"), "hist_max"),
        only(histogram, F.col("p.explicitBounds"), "explicit_bounds"),
        only(histogram, F.transform("p.bucketCounts", lambda x: x.cast("bigint")), "bucket_counts"),
        only(histogram, temporality.cast("int"), "hist_temporality"),
        only(histogram, _exemplars(F.col("p.exemplars")), "hist_exemplars"),
    )


def route(points: DataFrame, key: str = "table_id") -> DataFrame:
    """points with `table`: service.table.type.metric for points that carry the routing attribute; others have none."""
    text = lambda kv, name: F.get(F.filter(F.col(kv), lambda x: x["key"] == name), 0)["value"]["string_value"]
    target = text("point_attributes", key)
    service = F.coalesce(text("resource_attributes", "service.name"), F.lit("unknown"))
    return points.withColumn("table", F.when(target.isNotNull(), F.concat_ws(".", service, target, "kind", "metric_name")))
