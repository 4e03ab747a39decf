"""Group K: changelogs made from the given tables, reduced to live rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changelog as cl
from tidemark.operators import policy
from tidemark.operators.changelog import Identity
from tidemark.plans.registry import query
from tidemark.streaming import wal

ORDER = Identity.key("o_orderkey")
_ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def orders_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders at LSN 1; every third gets double the price at LSN 2; every seventh goes at LSN 3."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    doubled = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    gone = orders.where("o_orderkey % 7 = 0")
    first = cl.appends(orders, 1)
    return first.unionByName(cl.upserts(doubled, 2)).unionByName(cl.deletes(gone, 3)).unionByName(cl.marks(first, [("C", 4, None)]))


def live_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.reduce(cl.resolve(orders_changelog(spark, sf_dir)), ORDER, unique_keys=True)


LIVE_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0"


@query("k01_keyed_upsert_state", LIVE_ORDERS_SQL)
def k01(spark, sf_dir):
    return live_orders(spark, sf_dir)


@query("k02_read_at_lsn", "SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS o_totalprice FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders)")
def k02(spark, sf_dir):
    """Order k is committed at LSN 10k + 1 and doubled, if even, at 10k + 3; read at the LSN by which half of the keys are."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    middle = orders.agg(F.expr("max(o_orderkey) div 2")).first()[0] * 10 + 5
    base = F.col("o_orderkey") * 10
    doubled = orders.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    events = cl.appends(orders, base).unionByName(cl.upserts(doubled, base + 2))
    commits = orders.select(F.lit("C").alias("op"), F.explode(F.array(base + 1, base + 3)).alias("lsn"), F.lit(0).alias("seq"), F.lit(None).cast("int").alias("xact_id"), F.lit(False).alias("delete_if_exists"), F.lit(None).cast(events.schema["r"].dataType).alias("r"))
    return cl.reduce(cl.resolve(events.unionByName(commits), at_lsn=middle), ORDER, unique_keys=True)


@query("k03_fullrow_multiset_delete", "WITH a AS (SELECT l_returnflag, l_linestatus, count(*) - count(*) FILTER (WHERE l_linenumber = 1) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus FROM a, generate_series(1, n)")
def k03(spark, sf_dir):
    """Every line appended as (flag, status); one equal row deleted for each first line: copies are counted, not named."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines.select("l_returnflag", "l_linestatus")
    events = cl.appends(rows, 1).unionByName(cl.deletes(lines.where("l_linenumber = 1").select("l_returnflag", "l_linestatus"), 2))
    return cl.net_multiset(events)


@query("k04_composite_key", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity < 25")
def k04(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    events = cl.appends(lines, 1).unionByName(cl.deletes(lines.where("l_quantity >= 25"), 2))
    return cl.reduce(events, Identity.key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), unique_keys=True)


@query("k05_null_safe_key", "WITH c AS (SELECT nullif(c_custkey % 5, 0) AS k1, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS k2, c_custkey FROM customer), d AS (SELECT DISTINCT k1, k2 FROM c WHERE k1 IS NULL OR k2 IS NULL) SELECT k1, k2, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.k1 IS NOT DISTINCT FROM c.k1 AND d.k2 IS NOT DISTINCT FROM c.k2) GROUP BY k1, k2 UNION ALL SELECT k1, k2, count(*) - 1 AS n FROM c WHERE EXISTS (SELECT 1 FROM d WHERE d.k1 IS NOT DISTINCT FROM c.k1 AND d.k2 IS NOT DISTINCT FROM c.k2) GROUP BY k1, k2 HAVING count(*) > 1")
def k05(spark, sf_dir):
    """Keys with nulls: one delete per key that has a null takes one row of the equal, null-matching key."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.nullif(F.col("c_custkey") % 5, F.lit(0)).alias("k1"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("k2"), "c_custkey")
    gone = c.where("k1 IS NULL OR k2 IS NULL").select("k1", "k2").distinct().withColumn("c_custkey", F.lit(None).cast("bigint"))
    events = cl.appends(c, 1).unionByName(cl.deletes(gone, 2))
    return cl.reduce(events, Identity.key("k1", "k2")).groupBy("k1", "k2").agg(F.count("*").alias("n"))


@query("k06_delete_if_exists_missing", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 3")
def k06(spark, sf_dir):
    """Optional deletes: of nation 3, and of keys that aren't there."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    missing = nation.withColumn("n_nationkey", F.col("n_nationkey") + 1000)
    events = cl.deletes(missing, 1, if_exists=True).unionByName(cl.appends(nation, 2)).unionByName(cl.deletes(missing.unionByName(nation.where("n_nationkey = 3")), 3, if_exists=True))
    return cl.reduce(events, Identity.key("n_nationkey"), strict=True)


@query("k07_upsert_last_wins", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def k07(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value", "event_id")
    log = cl.upserts(events, F.col("event_id"))
    return cl.reduce(log, Identity.key("user_id"), unique_keys=True).drop("event_id")


@query("k08_append_only_ignores_deletes", "SELECT event_id, user_id, event_type FROM events")
def k08(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return cl.reduce(cl.appends(events, 1).unionByName(cl.deletes(events.where("event_id % 2 = 0"), 2)), Identity.append_only())


@query("k09_xact_commit_abort_open", "SELECT event_id, user_id, value FROM events WHERE user_id % 10 < 6")
def k09(spark, sf_dir):
    """Transactions 0 to 5 commit, 6 and 7 abort, 8 and 9 stay open."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    rows = cl.appends(events, F.col("event_id"), 0, (F.col("user_id") % 10))
    ends = [("C", 10**9 + i, i) for i in range(6)] + [("X", 10**9 + i, i) for i in (6, 7)]
    return cl.reduce(cl.resolve(rows.unionByName(cl.marks(rows, ends))), Identity.key("event_id"), unique_keys=True)


@query("k10_delete_then_reinsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def k10(spark, sf_dir):
    """A delete and an append of one key in one LSN, ordered by seq."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    even = c.where("c_custkey % 2 = 0")
    events = cl.appends(c, 1).unionByName(cl.deletes(even, 2, 0)).unionByName(cl.appends(even.withColumn("c_mktsegment", F.lit("new")), 2, 1))
    return cl.reduce(events, Identity.key("c_custkey"))


@query("k11_cdc_update_split", "SELECT 'D' AS op, 0 AS seq, o_orderkey, o_orderstatus FROM orders UNION ALL SELECT 'A', 1, o_orderkey, 'X' FROM orders")
def k11(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    changes = o.select(F.struct("o_orderkey", "o_orderstatus").alias("old"), F.struct("o_orderkey", F.lit("X").alias("o_orderstatus")).alias("new"), "o_orderkey")
    return cl.updates(changes, "old", "new", F.col("o_orderkey")).select("op", "seq", "r.*")


@query("k12_initial_copy_boundary", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'late' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def k12(spark, sf_dir):
    """Changes up to the copy's LSN 100 are in the copy already; those at 101 and later count."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    early = cl.upserts(o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("early")), 100)
    late = cl.upserts(o.where("o_orderkey % 10 = 1").withColumn("o_orderstatus", F.lit("late")), 101)
    return cl.reduce(cl.initial_copy(o, 100, early.unionByName(late)), Identity.key("o_orderkey"), unique_keys=True)


@query("k13_recovery_replay_filter", "SELECT op, lsn, xact_id, event_id FROM (SELECT 'A' AS op, event_id AS lsn, CASE WHEN user_id % 4 = 0 THEN NULL ELSE (user_id % 4)::INTEGER END AS xact_id, event_id FROM events) WHERE (xact_id IS NULL AND lsn > 500) OR xact_id IN (2, 3)")
def k13(spark, sf_dir):
    """Persisted up to LSN 500. Transaction 1 ended before that, 2 commits later, 3 is open; the rest is the main one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    log = cl.appends(e, F.col("event_id"), 0, F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4))
    log = log.unionByName(cl.marks(log, [("C", 400, 1), ("C", 10**9, 2)]))
    return wal.replay(log, 500).where("op = 'A'").select("op", "lsn", "xact_id", "r.event_id")


@query("k14_table_status", "SELECT 4::BIGINT AS commit_lsn, (SELECT count(*) FROM orders) + (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS cardinality, (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0) AS live_rows")
def k14(spark, sf_dir):
    """Cardinality counts deleted rows; live rows don't."""
    log = orders_changelog(spark, sf_dir)
    live = cl.reduce(cl.resolve(log), ORDER, unique_keys=True).agg(F.count("*").alias("n")).select("n").scalar()
    return log.agg(F.max(F.when(F.col("op") == "C", F.col("lsn"))).alias("commit_lsn"), F.count(F.when(F.col("op") == "A", 1)).alias("cardinality")).withColumn("live_rows", live)


@query("k15_insert_duplicates_kept", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def k15(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    return cl.reduce(cl.appends(s, 1).unionByName(cl.appends(s.where("s_suppkey % 2 = 0"), 2)), Identity.key("s_suppkey"))


@query("k16_lifo_duplicate_delete", "SELECT s_suppkey, 'first' AS v FROM supplier UNION ALL SELECT s_suppkey, 'second' FROM supplier WHERE s_suppkey % 2 = 1")
def k16(spark, sf_dir):
    """Of two rows of a key, a keyed delete takes the later."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    twice = cl.appends(s.withColumn("v", F.lit("first")), 1).unionByName(cl.appends(s.withColumn("v", F.lit("second")), 2))
    return cl.reduce(twice.unionByName(cl.deletes(s.where("s_suppkey % 2 = 0").withColumn("v", F.lit(None).cast("string")), 3)), Identity.key("s_suppkey"))


@query("k17_cached_read_rule", "SELECT requested, requested <= 10 AS served FROM (SELECT unnest([1, 10, 11]) AS requested)")
def k17(spark, sf_dir):
    rows = [(r, policy.may_serve_cached(r, 10, 10, 20)) for r in (1, 10, 11)]
    return spark.createDataFrame(rows, "requested int, served boolean")
