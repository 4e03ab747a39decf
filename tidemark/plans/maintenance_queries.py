"""Group V: deletion vectors, unions of files and buffers, file statistics and maintenance policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import deletes as dv
from tidemark.operators import policy
from tidemark.operators.changelog import Identity
from tidemark.plans.registry import query
from tidemark.tables.table import file_stats

_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as if in 16 files of a manifest."""
    o = _orders(spark, sf_dir)
    return o.select(F.concat(F.lit("f"), (F.col("o_orderkey") % 16).cast("string")).alias("file"), "o_orderkey", "o_totalprice", "o_orderstatus")


@query("v01_dv_anti_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus = 'F'")
def v01(spark, sf_dir):
    """Positions of every fifth order are deleted; the scan masks them under a pushed filter."""
    rows = dv.with_position(_orders(spark, sf_dir))
    gone = rows.where("o_orderkey % 5 = 0").select(F.col("__file").alias("file"), F.col("__row").alias("row_index"))
    return dv.mask(rows, gone).where("o_orderstatus = 'F'").select(*_ORDERS)


@query("v02_union_read", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey + 1000000, o_custkey, 'B', o_totalprice FROM orders WHERE o_orderkey % 50 = 1")
def v02(spark, sf_dir):
    """Persisted rows less deletes, and buffered ones."""
    rows = dv.with_position(_orders(spark, sf_dir))
    gone = rows.where("o_orderkey % 5 = 0").select(F.col("__file").alias("file"), F.col("__row").alias("row_index"))
    buffered = _orders(spark, sf_dir).where("o_orderkey % 50 = 1").select((F.col("o_orderkey") + 1_000_000).alias("o_orderkey"), "o_custkey", F.lit("B").alias("o_orderstatus"), "o_totalprice")
    return dv.mask(rows, gone).select(*_ORDERS).unionByName(buffered)


@query("v03_dv_counts_per_file", "SELECT 'f' || (o_orderkey % 16) AS file, count(*) AS num_rows, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS deleted, count(*) FILTER (WHERE o_orderkey % 3 = 0) * 100 // count(*) AS deleted_percent FROM orders GROUP BY 1")
def v03(spark, sf_dir):
    rows = _by_file(spark, sf_dir)
    files = rows.groupBy("file").agg(F.count("*").alias("num_rows"))
    return dv.percentages(files, rows.where("o_orderkey % 3 = 0").select("file", F.col("o_orderkey").alias("row_index")))


_FILES_SQL = "SELECT 'f' || (o_orderkey % 64) AS file, count(*) AS num_rows, count(*) * 100 AS bytes, count(*) FILTER (WHERE (o_orderkey // 64) % (1 + o_orderkey % 4) = 0) AS deleted FROM orders GROUP BY 1, o_orderkey % 4, o_orderkey % 64"


@query("v04_compaction_select", f"WITH f AS ({_FILES_SQL}), c AS (SELECT *, deleted * 100 // num_rows AS deleted_percent FROM f WHERE bytes < 1000 OR deleted * 100 // num_rows >= 50) SELECT * FROM c WHERE (SELECT count(*) FROM c) >= 16 ORDER BY bytes, file LIMIT 24")
def v04(spark, sf_dir):
    o = _orders(spark, sf_dir)
    gone = F.expr("(o_orderkey div 64) % (1 + o_orderkey % 4) = 0")
    files = o.groupBy(F.concat(F.lit("f"), (F.col("o_orderkey") % 64).cast("string")).alias("file")).agg(F.count("*").alias("num_rows"), (F.count("*") * 100).alias("bytes"), F.count(F.when(gone, 1)).alias("deleted"))
    return policy.select_for_compaction(files, policy.CompactionConfig(16, 24, 1000, 50))


@query("v05_compaction_result_equal", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def v05(spark, sf_dir):
    """A table that was loaded, had rows deleted, was flushed and compacted, reads as before."""
    from tidemark.operators import changelog as cl
    from tidemark.plans.scratch import scratch_table

    orders = _orders(spark, sf_dir).select(*_ORDERS)
    table = scratch_table(spark, orders.schema, Identity.key("o_orderkey"))
    table.append(orders, 1)
    table.commit(2)
    table.flush()
    gone = orders.where("o_orderkey % 7 = 0")
    table.write_events(cl.deletes(gone, 3))
    table.commit(4)
    table.flush()
    table.optimize("full")
    return table.read()


@query("v06_file_stats_minmax", "SELECT count(*) AS num_rows, min(o_orderkey) AS o_orderkey__min, max(o_orderkey) AS o_orderkey__max, 0::BIGINT AS o_orderkey__nulls, min(o_orderstatus) AS o_orderstatus__min, max(o_orderstatus) AS o_orderstatus__max, count(*) FILTER (WHERE o_orderstatus IS NULL) AS o_orderstatus__nulls FROM orders")
def v06(spark, sf_dir):
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])
    return file_stats(spark.read.schema(schema).parquet(f"{sf_dir}/orders.parquet"), schema).drop("file")


@query("v07_confirmed_lsn", "SELECT min(CASE WHEN wal > 0 THEN wal ELSE p END) AS confirmed_lsn FROM (SELECT (c_custkey % 3) * c_custkey AS wal, c_custkey + 5 AS p FROM customer)")
def v07(spark, sf_dir):
    tables = spark.read.parquet(f"{sf_dir}/customer.parquet").select(((F.col("c_custkey") % 3) * F.col("c_custkey")).alias("wal_flush_lsn"), (F.col("c_custkey") + 5).alias("persisted_lsn"))
    return policy.confirmed_flush_lsn(tables)


@query("v08_scan_projection_filter", "SELECT l_orderkey, l_partkey, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity BETWEEN 20 AND 40 THEN 'mid' ELSE 'small' END AS size FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' AND l_shipdate IS NOT NULL")
def v08(spark, sf_dir):
    """Filters and columns reach the Parquet scan, and are checked again above it."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = F.when(F.col("l_quantity") > 40, "big").when(F.col("l_quantity").between(20, 40), "mid").otherwise("small")
    return lines.where(F.col("l_returnflag").isin("A", "R") & F.col("l_linestatus").like("F%") & F.col("l_shipdate").isNotNull()).select("l_orderkey", "l_partkey", size.alias("size"))


@query("v09_position_delete_merge", "SELECT 'f' || (o_orderkey % 16) AS file, o_orderkey AS row_index FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT 'f' || (o_orderkey % 16), o_orderkey FROM orders WHERE o_orderkey % 4 = 0")
def v09(spark, sf_dir):
    rows = _by_file(spark, sf_dir).select("file", F.col("o_orderkey").alias("row_index"))
    return dv.merge(rows.where("row_index % 3 = 0"), rows.where("row_index % 4 = 0"))


@query("v10_index_lookup", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def v10(spark, sf_dir):
    """Keys probed in a key -> position sidecar."""
    from tidemark.plans.scratch import scratch_table

    orders = _orders(spark, sf_dir).select(*_ORDERS)
    table = scratch_table(spark, orders.schema, Identity.key("o_orderkey"))
    table.load_files([f"{sf_dir}/orders.parquet"], 1)
    table.build_index()
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table.lookup(wanted).select("o_orderkey")


@query("v11_ctid_shards", "SELECT least(c_custkey // (SELECT (max(c_custkey) + 1 + 3) // 4 FROM customer), 3) AS shard, count(*) AS n FROM customer GROUP BY 1")
def v11(spark, sf_dir):
    """Disjoint block ranges over customer keys that cover every row once."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    blocks = c.agg(F.max("c_custkey")).first()[0] + 1
    shards = [c.where((F.col("c_custkey") >= a) & (F.col("c_custkey") < b if b is not None else F.lit(True))).agg(F.lit(i).cast("bigint").alias("shard"), F.count("*").alias("n")) for i, (a, b) in enumerate(policy.range_shards(blocks, 4))]
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


@query("v12_alter_drop_add", "SELECT o_orderkey, o_custkey, o_totalprice, NULL::INTEGER AS o_note FROM orders")
def v12(spark, sf_dir):
    """Files of the old schema read with the new one: a dropped column is gone, an added one is null."""
    from tidemark.plans.scratch import scratch_table

    table = scratch_table(spark, _orders(spark, sf_dir).select(*_ORDERS).schema, Identity.key("o_orderkey"))
    table.load_files([f"{sf_dir}/orders.parquet"], 1)
    table.alter(drop=["o_orderstatus"], add=[T.StructField("o_note", T.IntegerType())])
    return table.read()


@query("v13_persist_policy", "SELECT p_partkey, (p_size % 3 >= 1 OR p_partkey % 1500 >= 1000) AND p_partkey % 5 <> 0 AS persist FROM part")
def v13(spark, sf_dir):
    """The thresholds as a condition over many tables' counters."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    config = policy.TableConfig()
    enough = (F.col("p_size") % 3 >= config.persist_new_files) | (F.col("p_partkey") % 1500 >= config.persist_deletes)
    return p.select("p_partkey", (enough & (F.col("p_partkey") % 5 != 0)).alias("persist"))


@query("v14_wal_truncate", "SELECT s_suppkey AS file_id FROM supplier WHERE s_suppkey >= (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey * 10 > 55 OR s_suppkey = 4)")
def v14(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("file_id"), (F.col("s_suppkey") * 10).alias("highest_lsn"), (F.col("s_suppkey") == 4).alias("has_open_xact"))
    return policy.wal_files_to_keep(files, 55).select("file_id")


@query("v15_live_table_life", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 7")
def v15(spark, sf_dir):
    """Bulk load, then buffered upserts and deletes that aren't flushed: read in one plan."""
    from tidemark.operators import changelog as cl
    from tidemark.plans.scratch import scratch_table

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    table = scratch_table(spark, c.schema, Identity.key("c_custkey"))
    table.load_files([f"{sf_dir}/customer.parquet"], 1)
    table.write_events(cl.upserts(c.where("c_custkey % 10 = 3").withColumn("c_mktsegment", F.lit("MOVED")), 2))
    table.write_events(cl.deletes(c.where("c_custkey % 10 = 7"), 3))
    table.commit(4)
    return table.read()
