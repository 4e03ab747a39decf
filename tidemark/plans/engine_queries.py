"""Group E: whole tables through the engine: sources, life cycle, reads at an LSN, maintenance, streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import binary_rows, delete_vectors
from tidemark.functions.types import struct_from_avro, struct_from_fields
from tidemark.operators import changelog as cl
from tidemark.operators import deletes as dv
from tidemark.operators import policy
from tidemark.operators.changelog import Identity
from tidemark.plans.registry import query
from tidemark.plans.scratch import scratch_path, scratch_table
from tidemark.sources import cdc
from tidemark.sources import rows as sources
from tidemark.streaming import ingest, transactions, windows
from tidemark.tables.engine import Engine
from tidemark.tables.files import Files
from tidemark.tables.manifest import Manifest
from tidemark.tables.table import Table, footer_stats


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> tuple[Table, DataFrame]:
    """A table that holds the customers' keys and segments at LSN 1."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    table = scratch_table(spark, c.schema, Identity.key("c_custkey"))
    table.load_files([f"{sf_dir}/customer.parquet"], 1)
    return table, c


# ---- catalog and service


@query("e01_catalog", "SELECT 'lake' AS database, 'nation' AS \"table\", (SELECT count(*) FROM nation) AS cardinality, (SELECT count(*) FROM nation) AS persisted_live_rows, 1::BIGINT AS commit_lsn UNION ALL SELECT 'lake', 'region', (SELECT count(*) FROM region), (SELECT count(*) FROM region), 1")
def e01(spark, sf_dir):
    """Tables are created, loaded, listed and dropped."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    for name in ("nation", "region", "supplier"):
        engine.create_table("lake", name, _t(spark, sf_dir, name).schema, Identity.full_row())
        engine.load_files("lake", name, [f"{sf_dir}/{name}.parquet"], 1)
    engine.drop_table("lake", "supplier")
    return engine.list_tables().select("database", "table", "cardinality", "persisted_live_rows", "commit_lsn")


@query("e02_declared_schema", "SELECT * FROM (VALUES (0, 'id', 'bigint', false), (1, 'name', 'string', true), (2, 'price', 'decimal(12,2)', true), (3, 'place', 'struct<city:string,zip:int>', true), (4, 'tags', 'array<string>', true)) t(pos, name, type, nullable)")
def e02(spark, sf_dir):
    """A table's schema from a declared field list, as the catalog gives it back."""
    fields = [{"name": "id", "data_type": "int64"}, {"name": "name", "data_type": "string", "nullable": True}, {"name": "price", "data_type": "decimal(12,2)", "nullable": True}]
    fields += [{"name": "place", "data_type": "struct", "nullable": True, "fields": [{"name": "city", "data_type": "string", "nullable": True}, {"name": "zip", "data_type": "int32", "nullable": True}]}, {"name": "tags", "data_type": "list", "nullable": True, "item": {"data_type": "string"}}]
    engine = Engine(spark, scratch_path(spark, "engine"))
    engine.create_table("lake", "t", struct_from_fields(fields), Identity.key("id"))
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(engine.schema("lake", "t").fields)]
    return spark.createDataFrame(rows, "pos int, name string, type string, nullable boolean")


@query("e03_sql_over_live_tables", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 1 GROUP BY n_name")
def e03(spark, sf_dir):
    """Spark SQL over tables of the catalog, one with buffered deletes."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    for name, key in (("customer", "c_custkey"), ("nation", "n_nationkey")):
        engine.create_table("lake", name, _t(spark, sf_dir, name).schema, Identity.key(key))
        engine.load_files("lake", name, [f"{sf_dir}/{name}.parquet"])
    table = engine.table("lake", "customer")
    table.write_events(cl.deletes(_t(spark, sf_dir, "customer").where("c_custkey % 4 = 1"), 5))
    table.commit(6)
    return engine.sql("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("e04_recover", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 7 UNION ALL SELECT -c_custkey, 'OPEN' FROM customer WHERE c_custkey % 10 = 7")
def e04(spark, sf_dir):
    """A new engine over the same folder finds persisted rows, buffered events, and a transaction that commits after the restart."""
    root = scratch_path(spark, "engine")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    table = Engine(spark, root).create_table("lake", "customer", c.schema, Identity.key("c_custkey"))
    table.load_files([f"{sf_dir}/customer.parquet"], 1)
    gone = c.where("c_custkey % 10 = 7")
    table.write_events(cl.deletes(gone, 2))
    table.write_events(cl.appends(gone.select((-F.col("c_custkey")).alias("c_custkey"), F.lit("OPEN").alias("c_mktsegment")), 3, 0, F.lit(9)))
    table.commit(4)
    (again,) = Engine(spark, root).recover()
    again.commit(5, xact_id=9)
    return again.read()


@query("e05_two_writers", "SELECT c_custkey FROM customer")
def e05(spark, sf_dir):
    """Two writers commit from the same state: the second takes the first's state and tries again, and nothing is lost."""
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    one = scratch_table(spark, c.schema, Identity.key("c_custkey"))
    other = Table(spark, one.path)
    events = cl.appends(c.where("c_custkey % 2 = 0"), 1)

    def with_a_commit_between(m: Manifest, left=[True]) -> Manifest:  # noqa: B006 - once
        if left.pop() if left else False:
            other.write_events(events)
        return m

    one.log.commit(with_a_commit_between)
    one.append(c.where("c_custkey % 2 = 1"), 2)
    other.commit(3)
    one.flush()
    return other.read()


@query("e06_status", "SELECT 4::BIGINT AS commit_lsn, 2::BIGINT AS flush_lsn, 9::BIGINT AS replication_lsn, count(*) + count(*) FILTER (WHERE c_custkey % 3 = 0) AS cardinality, count(*) AS persisted_live_rows FROM customer")
def e06(spark, sf_dir):
    """Cardinality counts buffered rows and deleted ones; the replication LSN follows the source's keepalives."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    table = scratch_table(spark, c.schema, Identity.key("c_custkey"))
    table.append(c, 1)
    table.commit(2)
    table.flush()
    table.write_events(cl.upserts(c.where("c_custkey % 3 = 0"), 3))
    table.commit(4)
    table.keepalive(9)
    table.wait_for_wal(9)
    s = table.status()
    return spark.createDataFrame([(s["commit_lsn"], s["flush_lsn"], table.manifest.replication_lsn, s["cardinality"], s["persisted_live_rows"])], "commit_lsn bigint, flush_lsn bigint, replication_lsn bigint, cardinality bigint, persisted_live_rows bigint")


# ---- row sources


@query("e10_json_ingest", "SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ['a', event_type] END AS tags FROM events WHERE event_id % 7 <> 0 AND event_id % 3 <> 0 UNION ALL SELECT event_id, user_id, event_type, [] FROM events WHERE event_id % 7 <> 0 AND event_id % 3 = 0")
def e10(spark, sf_dir):
    """JSON objects into a table: those with a wrong type are rejected, then inserted rows are there."""
    schema = struct_from_fields([{"name": "event_id", "data_type": "int64"}, {"name": "user_id", "data_type": "int64"}, {"name": "event_type", "data_type": "string", "nullable": True}, {"name": "tags", "data_type": "list", "item": {"data_type": "string"}}])
    table = scratch_table(spark, schema, Identity.key("event_id"))
    shown = F.when(F.col("event_id") % 7 == 0, F.format_string('"%s"', F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    tags = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.format_string('"a","%s"', "event_type"))
    lines = _t(spark, sf_dir, "events").select(F.format_string('{"event_id":%s,"user_id":%s,"event_type":"%s","tags":[%s]}', F.col("event_id").cast("string"), shown, "event_type", tags).alias("value"))
    sources.ingest_json(table, lines)
    return table.read()


@query("e11_protobuf_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN [o_custkey, -o_custkey] ELSE [] END AS numbers FROM orders")
def e11(spark, sf_dir):
    """Rows to protobuf messages and, through an ingest, back."""
    numbers = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.col("o_custkey"), -F.col("o_custkey"))).otherwise(F.array().cast("array<bigint>"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", numbers.alias("numbers"))
    table = scratch_table(spark, rows.schema, Identity.key("o_orderkey"))
    sources.ingest_protobuf(table, binary_rows.encode_protobuf(rows))
    return table.read()


_AVRO = json.dumps({"type": "record", "name": "part", "fields": [{"name": "p_partkey", "type": "long"}, {"name": "p_size", "type": ["null", "int"]}, {"name": "p_price", "type": "double"}, {"name": "words", "type": {"type": "array", "items": "string"}}]})


@query("e12_avro_ingest", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END::INTEGER AS p_size, p_partkey / 4.0::DOUBLE AS p_price, ['x', p_partkey::VARCHAR] AS words FROM part")
def e12(spark, sf_dir):
    """Avro data by a registered schema, which becomes the table's."""
    table = scratch_table(spark, struct_from_avro(_AVRO), Identity.key("p_partkey"))
    source = sources.AvroSource(table)
    source.set_schema(7, _AVRO)
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("int")).alias("p_size"), (F.col("p_partkey") / 4.0).alias("p_price"), F.array(F.lit("x"), F.col("p_partkey").cast("string")).alias("words"))
    source.ingest(binary_rows.encode_avro(rows, _AVRO), 7)
    return table.read()


@query("e13_parquet_upload", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def e13(spark, sf_dir):
    """A file's rows inserted one by one with LSNs of their own, and the same file adopted as it is."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    table = scratch_table(spark, s.schema, Identity.append_only())
    path = f"{sf_dir}/supplier.parquet"
    sources.upload(spark, table, [path], "insert")
    table.flush()
    sources.upload(spark, table, [path], "upload")
    return table.read()


@query("e14_upsert_and_delete_calls", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'UP' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 <> 0")
def e14(spark, sf_dir):
    table, c = _customers(spark, sf_dir)
    sources.ingest_rows(table, c.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("UP")), "upsert")
    sources.ingest_rows(table, c.where("c_custkey % 5 = 0").select("c_custkey"), "delete")
    return table.read()


# ---- change data


@query("e20_cdc_messages", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 1 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 2 AND o_orderkey % 5 <> 3")
def e20(spark, sf_dir):
    """Inserts, updates and deletes of the main transaction; a streamed transaction (every 5n + 3) that is aborted. Frames up to LSN 0 were seen before."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    row = F.struct("o_orderkey", "o_orderstatus", "o_totalprice")
    none = F.lit(None).cast(o.select(row.alias("r")).schema["r"].dataType)
    in_xact = F.when(F.col("o_orderkey") % 5 == 3, 7)
    message = lambda df, op, lsn, old, new, xact=None: df.select(F.lit(op).alias("op"), F.lit(lsn).cast("bigint").alias("lsn"), F.lit(0).alias("seq"), (F.lit(None).cast("int") if xact is None else xact.cast("int")).alias("xact_id"), old.alias("old"), new.alias("new"))
    changed = F.struct("o_orderkey", F.lit("U").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    ends = spark.createDataFrame([("C", 9, None), ("SA", 10, 7)], "op string, lsn bigint, xact_id int")
    end = ends.select("op", "lsn", F.lit(0).alias("seq"), "xact_id", none.alias("old"), none.alias("new"))
    messages = message(o.withColumn("o_totalprice", F.lit(-1.0)), "I", 0, none, row).unionByName(message(o, "I", 1, none, row, in_xact)).unionByName(message(o.where("o_orderkey % 5 = 1"), "U", 2, row, changed)).unionByName(message(o.where("o_orderkey % 5 = 2"), "D", 3, row, none)).unionByName(end)
    return cl.reduce(cl.resolve(cdc.changelog_from_messages(cdc.after_frame(messages, 0))), Identity.key("o_orderkey"), strict=True)


@query("e21_unchanged_columns", "SELECT doc_id, text, 'XX' AS lang FROM documents")
def e21(spark, sf_dir):
    """An update that leaves a long column out because it didn't change: its old value stays."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    old, new = F.struct("doc_id", "text", "lang"), F.struct("doc_id", F.lit(None).cast("string").alias("text"), F.lit("XX").alias("lang"))
    updates = d.select(F.lit("U").alias("op"), F.lit(2).cast("bigint").alias("lsn"), F.lit(0).alias("seq"), F.lit(None).cast("int").alias("xact_id"), old.alias("old"), new.alias("new"), F.array(F.lit("text")).alias("unchanged"))
    log = cl.appends(d, 1).unionByName(cdc.changelog_from_messages(updates, "keep", ["doc_id"]))
    return cl.reduce(log, Identity.key("doc_id"))


@query("e22_copy_text", "SELECT conv_id, turn, role, text FROM conversations")
def e22(spark, sf_dir):
    r"""COPY text with escaped tabs, line ends and backslashes, and \N for null, written by four writers and read back."""
    c = _t(spark, sf_dir, "conversations")

    def field(name: str):
        x = F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\"))
        for char, letter in (("\t", "t"), ("\n", "n"), ("\r", "r"), ("\b", "b"), ("\f", "f"), ("\v", "v")):
            x = F.replace(x, F.lit(char), F.lit(f"\\{letter}"))
        return F.coalesce(x, F.lit("\\N"))

    lines = c.select(F.concat_ws("\t", *[field(n) for n in ("conv_id", "turn", "role", "text")]).alias("value"))
    kinds = {"bigint": "int8", "int": "int4", "string": "text"}
    rows = cdc.copy_text(lines, [(n, kinds[c.schema[n].dataType.simpleString()]) for n in ("conv_id", "turn", "role", "text")])
    path = scratch_path(spark, "copy")
    cdc.write_copy(rows, path, 4, 10_000)
    return spark.read.schema(rows.schema).parquet(path)


@query("e23_copy_while_changes_wait", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 4 <> 3")
def e23(spark, sf_dir):
    """Events wait while the initial copy runs; those up to its LSN 10 are in the copy, and later ones count after it."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    table = scratch_table(spark, c.schema, Identity.key("c_custkey"))
    table.begin_copy()
    table.write_events(cl.appends(c.where("c_custkey % 4 = 1"), 8))
    table.commit(9)
    table.write_events(cl.upserts(c.where("c_custkey % 4 = 2").withColumn("c_mktsegment", F.lit("NEW")), 11))
    table.write_events(cl.deletes(c.where("c_custkey % 4 = 3"), 12))
    table.commit(13)
    table.finish_copy([f"{sf_dir}/customer.parquet"], 10)
    return table.read()


@query("e24_alter_with_buffered_events", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 END::INTEGER AS level FROM customer UNION ALL SELECT -c_custkey, NULL FROM customer WHERE c_custkey % 3 = 1")
def e24(spark, sf_dir):
    """ALTER flushes what is committed; an open transaction's rows are read by the new schema once it commits."""
    table, c = _customers(spark, sf_dir)
    table.write_events(cl.appends(c.where("c_custkey % 3 = 1").withColumn("c_custkey", -F.col("c_custkey")), 2, 0, F.lit(5)))
    table.write_events(cl.upserts(c.where("c_custkey % 3 = 0"), 3))
    table.commit(4)
    table.alter(drop=["c_mktsegment"], add=[T.StructField("level", T.IntegerType())])
    table.write_events(cl.upserts(c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(1).alias("level")), 5))
    table.commit(6)
    table.commit(7, xact_id=5)
    return table.read()


@query("e25_nested_key", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 1")
def e25(spark, sf_dir):
    """Rows with a struct and a list, told apart by all of them, nulls inside included."""
    p = _t(spark, sf_dir, "part")
    nested = F.struct(F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("a"), F.array(F.col("p_size").cast("int"), F.lit(None).cast("int")).alias("b"))
    rows = p.select("p_partkey", nested.alias("s"), F.array(F.struct(F.col("p_partkey").alias("k"))).alias("l"))
    table = scratch_table(spark, rows.schema, Identity.full_row())
    table.append(rows, 1)
    table.commit(2)
    table.flush()
    table.write_events(cl.deletes(rows.where("p_partkey % 2 = 0"), 3))
    table.commit(4)
    return table.read().select("p_partkey")


# ---- reads


@query("e30_read_at_lsn", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'FIRST' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def e30(spark, sf_dir):
    """Of two buffered commits the read at the first's LSN sees one."""
    table, c = _customers(spark, sf_dir)
    for lsn, name in ((2, "FIRST"), (4, "SECOND")):
        table.write_events(cl.upserts(c.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit(name)), lsn).unionByName(table._marks([("C", lsn + 1, None)])))
    return table.read(min_lsn=5, at_lsn=3)


@query("e31_cached_read", "SELECT c_custkey, c_mktsegment, 'cached' AS which FROM customer UNION ALL SELECT c_custkey, 'NEW', 'fresh' FROM customer")
def e31(spark, sf_dir):
    """A request that the last read is fresh enough for gets it again; one for the latest state doesn't."""
    table, c = _customers(spark, sf_dir)
    table.read_cached(1)
    table.write_events(cl.upserts(c.withColumn("c_mktsegment", F.lit("NEW")), 2).unionByName(table._marks([("C", 3, None)])))
    cached = table.read_cached(1)
    return cached.withColumn("which", F.lit("cached")).unionByName(table.read_cached().withColumn("which", F.lit("fresh")))


@query("e32_pruned_read", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 200 AND 900 AND o_orderkey % 9 <> 0")
def e32(spark, sf_dir):
    """A range of keys over files sorted by key: files outside it aren't read, and deletes are masked in the others."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "files")
    o.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    table = scratch_table(spark, o.schema, Identity.key("o_orderkey"))
    table.load_files([path], 1)
    table.write_events(cl.deletes(o.where("o_orderkey % 9 = 0"), 2).unionByName(table._marks([("C", 3, None)])))
    table.flush()
    return table.read(prune={"o_orderkey": (200, 900)})


@query("e33_pinned_scan", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def e33(spark, sf_dir):
    """A pinned state outlives a compaction and a vacuum of the files that it reads."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    table = scratch_table(spark, c.schema, Identity.key("c_custkey"))
    table.append(c, 0)
    table.commit(1)
    table.flush()
    table.write_events(cl.deletes(c.where("c_custkey % 2 = 0"), 2).unionByName(table._marks([("C", 3, None)])))
    table.flush()
    table.optimize("full")
    state, pin = table.begin_scan()
    table.write_events(cl.deletes(c.where("c_custkey % 2 = 1"), 4).unionByName(table._marks([("C", 5, None)])))
    table.flush()
    table.optimize("full")
    table.vacuum()
    rows = table.persisted(state)
    path = scratch_path(spark, "pinned")
    rows.write.parquet(path)
    table.end_scan(pin)
    table.vacuum()
    return spark.read.schema(rows.schema).parquet(path)


@query("e34_read_state", "SELECT count(*) AS num_rows, count(*) FILTER (WHERE c_custkey % 6 = 0) AS deleted, 3::BIGINT AS flush_lsn, 'c_custkey' AS keys FROM customer")
def e34(spark, sf_dir):
    """A state through its encoded form: counts by file, and the sorted positions of its deletes."""
    table, c = _customers(spark, sf_dir)
    table.write_events(cl.deletes(c.where("c_custkey % 6 = 0"), 2).unionByName(table._marks([("C", 3, None)])))
    table.flush()
    m = Manifest.from_json(table.manifest.to_json())
    positions = table.deleted(m).orderBy("file", "row_index")
    files = table.file_rows(m).agg(F.sum("num_rows").alias("num_rows"))
    return files.crossJoin(positions.agg(F.count("*").alias("deleted"))).select("num_rows", "deleted", F.lit(m.flush_lsn).cast("bigint").alias("flush_lsn"), F.lit(",".join(m.keys)).alias("keys"))


@query("e35_footer_stats", "SELECT count(*) AS num_rows, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls, min(o_orderstatus) AS first, max(o_orderstatus) AS last FROM orders")
def e35(spark, sf_dir):
    """Row counts and bounds from the footers alone."""
    files = Files(spark)
    paths = [p for p, _ in files.parquet(f"{sf_dir}/orders.parquet")]
    rows = []
    for raw in files.footers(paths):
        n, s = footer_stats(raw)
        rows.append((n, s["o_orderkey"][0], s["o_orderkey"][1], s["o_orderkey"][2], s["o_orderstatus"][0], s["o_orderstatus"][1]))
    found = spark.createDataFrame(rows, "n bigint, low bigint, high bigint, nulls bigint, first string, last string")
    return found.agg(F.sum("n").alias("num_rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("nulls").alias("nulls"), F.min("first").alias("first"), F.max("last").alias("last"))


# ---- deletes and maintenance


@query("e40_delete_vector_blobs", "SELECT 'f' || (o_orderkey % 16) AS file, o_orderkey // 16 AS row_index FROM orders WHERE o_orderkey % 7 = 0")
def e40(spark, sf_dir):
    """Positions to one portable blob per file, and back."""
    gone = _t(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 16).cast("string")).alias("file"), F.expr("o_orderkey div 16").alias("row_index"))
    return delete_vectors.positions(delete_vectors.blobs(gone))


@query("e41_lsn_visibility", "SELECT event_id FROM events WHERE NOT (event_id % 3 = 0 AND event_id <= 500 + event_id % 2)")
def e41(spark, sf_dir):
    """Deletes of LSN 500 and 501 see rows of their own LSN and before."""
    e = _t(spark, sf_dir, "events")
    rows = e.select(F.lit("f").alias("file"), F.col("event_id").alias("row_index"), F.col("event_id").alias("lsn"), "event_id")
    gone = e.where("event_id % 3 = 0").select(F.lit("f").alias("file"), F.col("event_id").alias("row_index"), (500 + F.col("event_id") % 2).alias("lsn"))
    return dv.committed_visible(rows, gone).select("event_id")


@query("e42_committed_deletes_per_file", "SELECT 'f' || (o_orderkey % 8) AS file, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE o_orderkey % 10 < 4 GROUP BY 1")
def e42(spark, sf_dir):
    """A delete log up to a flush, as sorted positions of each file."""
    log = _t(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 8).cast("string")).alias("file"), F.col("o_orderkey").alias("row_index"), (F.col("o_orderkey") % 10).alias("lsn"))
    found = dv.committed_before(log, 4)
    return found.select("file", F.size("row_indexes").cast("bigint").alias("n"), F.get("row_indexes", 0).alias("low"), F.element_at("row_indexes", -1).alias("high"))


@query("e43_thresholds", "SELECT 2::BIGINT AS flushed_lsn, (SELECT count(*) FROM customer) AS persisted, (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0) AS buffered")
def e43(spark, sf_dir):
    """A tick flushes when enough rows are buffered, and leaves fewer in the log. Enough is as many as there are customers: of any number, a fiftieth is fewer."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    table = Table.create(spark, scratch_path(spark, "table"), c.schema, Identity.key("c_custkey"), policy.TableConfig(mem_slice_rows=max(1, c.count())))
    table.append(c, 1)
    table.commit(2)
    table.tick()
    table.append(c.where("c_custkey % 50 = 0").withColumn("c_custkey", -F.col("c_custkey")), 3)
    table.commit(4)
    m = table.tick()
    return spark.createDataFrame([(m.flush_lsn, sum(f.rows for f in m.files), sum(w["rows"] for w in m.wal))], "flushed_lsn bigint, persisted bigint, buffered bigint")


@query("e44_persist_rule", "SELECT p_partkey, (p_size % 3 >= 1 OR p_partkey % 1500 >= 1000 OR p_partkey % 11 = 0) AND (p_partkey % 5 <> 0) AS persist FROM part")
def e44(spark, sf_dir):
    """The rule itself, for each part's counters: new files, deletes, a maintenance result, and a flush that is still under way."""
    counters = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).cast("int").alias("files"), (F.col("p_partkey") % 1500).cast("int").alias("deletes"), F.when(F.col("p_partkey") % 11 == 0, 1).otherwise(0).alias("results"), F.when(F.col("p_partkey") % 5 == 0, 7).alias("ongoing"))
    rule = F.udf(lambda files, deletes, results, ongoing: policy.should_persist(files, deletes, results, 9, ongoing), "boolean", useArrow=True)
    return counters.select("p_partkey", rule("files", "deletes", "results", "ongoing").alias("persist"))


@query("e45_index_merge", "SELECT c_custkey, 1::BIGINT AS sidecars FROM customer WHERE c_custkey % 4 = 1")
def e45(spark, sf_dir):
    """Three sidecars become one, which finds the keys at their new places after a compaction."""
    table, c = _customers(spark, sf_dir)
    for _ in range(3):
        table.build_index()
    table.merge_indexes()
    table.write_events(cl.deletes(c.where("c_custkey % 4 = 2"), 2).unionByName(table._marks([("C", 3, None)])))
    table.flush()
    table.optimize("full")
    table.build_index()
    n = table.index_sizes().where("bytes > 0").agg(F.count("*").alias("sidecars"))
    return table.lookup(c.where("c_custkey % 4 IN (1, 2)")).select("c_custkey").crossJoin(n)


@query("e46_forced_snapshot", "SELECT 5::BIGINT AS flush_lsn, count(*) AS live FROM customer WHERE c_custkey % 2 = 0")
def e46(spark, sf_dir):
    table, c = _customers(spark, sf_dir)
    table.write_events(cl.deletes(c.where("c_custkey % 2 = 1"), 4).unionByName(table._marks([("C", 5, None)])))
    m = table.create_snapshot(5)
    return table.persisted(m).agg(F.count("*").alias("live")).select(F.lit(m.flush_lsn).cast("bigint").alias("flush_lsn"), "live")


# ---- streams


def _streamed(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """df's rows as a stream of files, and a folder for the stream's own use."""
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex[:8]}")
    df.write.parquet(f"{base}/in")
    return spark.readStream.schema(df.schema).parquet(f"{base}/in"), base


def _collected(spark: SparkSession, out: DataFrame, base: str, mode: str = "append") -> DataFrame:
    """What the stream gives, run to the end of its input; complete results go through foreachBatch."""
    if mode == "append":
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("e50_streamed_transactions", "SELECT (user_id % 4)::INTEGER AS xact_id, 1000000000 + user_id % 4 AS lsn, event_id FROM events WHERE user_id % 4 < 2")
def e50(spark, sf_dir):
    """Transactions 0 and 1 commit, 2 aborts, 3 stays open: rows come out of the stream with their commit's LSN."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id")
    log = cl.appends(e, F.col("event_id"), 0, F.col("user_id") % 4)
    log = log.unionByName(cl.marks(log, [("C", 10**9, 0), ("C", 10**9 + 1, 1), ("X", 10**9 + 2, 2)]))
    stream, base = _streamed(spark, log)
    out = _collected(spark, transactions.release_on_commit(stream), base)
    return out.select("xact_id", "lsn", F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"))


@query("e51_stream_into_table", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def e51(spark, sf_dir):
    """A stream of rows, the last of each key in a table; its thresholds decide about flushes."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id")
    table = scratch_table(spark, e.schema, Identity.key("user_id"))
    stream, base = _streamed(spark, e)
    ingest.upsert_latest(table, stream, ["user_id"], "event_id", "latest", f"{base}/state").awaitTermination()
    return table.read()


@query("e52_stream_changelog", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0")
def e52(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    log = cl.appends(c, 1).unionByName(cl.deletes(c.where("c_custkey % 3 = 0"), 2))
    log = log.unionByName(cl.marks(log, [("C", 3, None)]))
    table = scratch_table(spark, c.schema, Identity.key("c_custkey"))
    stream, base = _streamed(spark, log)
    ingest.follow(table, stream, "log", f"{base}/state", flush=None).awaitTermination()
    return table.read()


@query("e53_stream_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def e53(spark, sf_dir):
    """The same window aggregate as a table's, run as a stream."""
    stream, base = _streamed(spark, _t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").coalesce(1))
    out = _collected(spark, windows.tumbling(stream, "ts", "1 hour", [F.count("*").alias("n")], ["event_type"], "10 minutes"), base, "complete")
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "event_type", "n")


@query("e54_stream_interval_join", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 20 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'error'")
def e54(spark, sf_dir):
    """Errors of a user up to 20 minutes after a click: two streams joined within watermarks, so old state goes."""
    e = _t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").coalesce(1)
    stream, base = _streamed(spark, e)
    a = stream.where("event_type = 'click'").select(F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"), F.col("user_id").alias("a_user")).withWatermark("a_ts", "1 hour")
    b = stream.where("event_type = 'error'").select(F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"), F.col("user_id").alias("b_user")).withWatermark("b_ts", "1 hour")
    joined = a.join(b, (F.col("a_user") == F.col("b_user")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr("INTERVAL 20 MINUTES")))
    return _collected(spark, joined.select("a_id", "b_id"), base)
