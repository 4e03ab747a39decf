"""Group Q: SQL and DataFrame operators over live tables and the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.changelog_queries import LIVE_ORDERS_SQL, live_orders
from tidemark.plans.registry import query
from tidemark.streaming import windows

_LIVE = f"WITH live AS ({LIVE_ORDERS_SQL}) "


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c) -> F.Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("decimal(18,2)")


@query("q01_revenue_by_nation", _LIVE + "SELECT n_name, count(*) AS n_orders, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS revenue FROM live JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def q01(spark, sf_dir):
    """Revenue by nation over the live orders."""
    joined = live_orders(spark, sf_dir).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_orders"), _money("o_totalprice").alias("revenue"))


@query("q02_inner_join", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def q02(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part").where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")


@query("q03_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def q03(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return _t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("q04_semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def q04(spark, sf_dir):
    big = _t(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return _t(spark, sf_dir, "orders").join(big, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("q05_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q05(spark, sf_dir):
    pending = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return _t(spark, sf_dir, "customer").join(pending, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("q06_full_join", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = 2 * c_custkey")
def q06(spark, sf_dir):
    s, c = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "customer")
    return s.join(c, F.col("s_suppkey") == 2 * F.col("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("q07_range_join", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type <> b.event_type")
def q07(spark, sf_dir):
    """An interval join: equal users within an hour."""
    e = _t(spark, sf_dir, "events")
    a, b = e.alias("a"), e.alias("b")
    near = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.ts") > F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr("INTERVAL 1 HOUR"))
    return a.join(b, near & (F.col("a.event_type") != F.col("b.event_type"))).select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"))


@query("q08_asof_join", "SELECT a.event_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_id % 5 = 0) a ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 5 <> 0) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def q08(spark, sf_dir):
    """As-of: union both sides, carry the last right row forward within a key."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    left = e.where("event_id % 5 = 0").select("user_id", "ts", F.lit(1).alias("side"), "event_id", F.lit(None).cast("bigint").alias("right_id"))
    right = e.where("event_id % 5 <> 0").select("user_id", "ts", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("event_id"), F.col("event_id").alias("right_id"))
    w = Window.partitionBy("user_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return left.unionByName(right).withColumn("before_id", F.last("right_id", ignorenulls=True).over(w)).where("side = 1").select("event_id", "before_id")


@query("q09_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def q09(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


_AGG = "count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DECIMAL(18,2) AS q"


@query("q10_rollup", f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q10(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _money("l_quantity").alias("q"))


@query("q11_cube", f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def q11(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _money("l_quantity").alias("q"))


@query("q12_grouping_sets", f"SELECT l_returnflag, l_linenumber, {_AGG} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
def q12(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    return lines.groupingSets([[F.col("l_returnflag")], [F.col("l_linenumber")], []], "l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), _money("l_quantity").alias("q"))


@query("q13_ranking_windows", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w2 AS rk, dense_rank() OVER w2 AS dr, ntile(4) OVER w AS nt, percent_rank() OVER w2 AS pr, cume_dist() OVER w2 AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), w2 AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
def q13(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    w2 = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    big = lambda c: c.cast("bigint")
    return _t(spark, sf_dir, "orders").select("o_orderkey", big(F.row_number().over(w)).alias("rn"), big(F.rank().over(w2)).alias("rk"), big(F.dense_rank().over(w2)).alias("dr"), big(F.ntile(4).over(w)).alias("nt"), F.percent_rank().over(w2).alias("pr"), F.cume_dist().over(w2).alias("cd"))


@query("q14_rows_frame", "SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DECIMAL(18,2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM orders")
def q14(spark, sf_dir):
    rows = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    near = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-100, 100)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(rows).cast("decimal(18,2)").alias("s"), F.count("*").over(near).alias("near"))


@query("q15_lag_lead", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(event_type) OVER w AS first_type, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def q15(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _t(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after"), F.first("event_type").over(w).alias("first_type"), F.nth_value("event_id", 2).over(w).alias("second"))


@query("q16_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def q16(spark, sf_dir):
    """A top-k report: the limit is what it is for."""
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(25).select("o_orderkey", "o_totalprice")


@query("q17_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def q17(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.union(s).distinct().union(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")))


@query("q18_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def q18(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("q19_except", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def q19(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("q20_scalar_functions", "SELECT o_orderkey, upper(o_orderpriority) AS u, substr(o_orderpriority, 3, 4) AS s, length(o_orderpriority)::INTEGER AS n, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS t, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS c, floor(o_totalprice)::BIGINT AS f, coalesce(nullif(o_orderstatus, 'F'), '-') AS z, regexp_replace(o_orderpriority, '[0-9]-', '') AS r FROM orders")
def q20(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.upper("o_orderpriority").alias("u"), F.substring("o_orderpriority", 3, 4).alias("s"), F.length("o_orderpriority").alias("n"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("t"), F.when(F.col("o_totalprice") > 100000, "high").otherwise("low").alias("c"), F.floor("o_totalprice").alias("f"), F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("-")).alias("z"), F.regexp_replace("o_orderpriority", "[0-9]-", "").alias("r"))


@query("q21_array_functions", "SELECT vec_id, len(embedding)::INTEGER AS n, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS pos, embedding[1] AS first, list_max(embedding) AS high, list_position(embedding, list_min(embedding))::BIGINT AS low_at FROM embeddings")
def q21(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.size("embedding").alias("n"), F.size(F.filter("embedding", lambda x: x > 0)).alias("pos"), F.col("embedding")[0].alias("first"), F.array_max("embedding").alias("high"), F.array_position("embedding", F.array_min("embedding")).alias("low_at"))


@query("q22_correlated_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)")
def q22(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("q22_orders")
    return spark.sql("WITH o AS (SELECT * FROM q22_orders) SELECT o_orderkey FROM o WHERE o_totalprice > (SELECT avg(i.o_totalprice) * 1.5D FROM q22_orders i WHERE i.o_custkey = o.o_custkey)")


@query("q23_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_orderkey) FILTER (WHERE l_quantity > 25) AS big FROM lineitem GROUP BY l_returnflag")
def q23(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("supps"), F.countDistinct(F.when(F.col("l_quantity") > 25, F.col("l_orderkey"))).alias("big"))


@query("q24_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def q24(spark, sf_dir):
    return windows.tumbling(_t(spark, sf_dir, "events"), "ts", "1 hour", [F.count("*").alias("n")], ["event_type"])


@query("q25_session_window", "WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, g")
def q25(spark, sf_dir):
    return windows.sessions(_t(spark, sf_dir, "events"), "ts", "30 minutes", [F.count("*").alias("n")], ["user_id"])


@query("q26_sliding_window", "SELECT b AS window_start, b + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY b")
def q26(spark, sf_dir):
    return windows.sliding(_t(spark, sf_dir, "events"), "ts", "2 hours", "1 hour", [F.count("*").alias("n")])


@query("q27_pivot", "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS A, count(*) FILTER (WHERE l_returnflag = 'N') AS N, count(*) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY l_linestatus")
def q27(spark, sf_dir):
    pivoted = _t(spark, sf_dir, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count()
    return pivoted.na.fill(0)


@query("q28_pricing_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DECIMAL(18,2) AS qty, sum((l_extendedprice::DECIMAL(18,2)) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(24,4) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q28(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _money("l_quantity").alias("qty"), F.sum(price).cast("decimal(24,4)").alias("revenue"))


@query("q29_theta_join", "SELECT a.n_name AS a, b.n_name AS b, r_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey CROSS JOIN region")
def q29(spark, sf_dir):
    """No equal keys: the small side is broadcast, and pairs are tested as they are made."""
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    a, b = (n.select(*[F.col(c).alias(f"{side}_{c}") for c in n.columns]) for side in "ab")
    pairs = a.join(F.broadcast(b), (F.col("a_n_nationkey") < F.col("b_n_nationkey")) & (F.col("a_n_regionkey") != F.col("b_n_regionkey")))
    return pairs.crossJoin(F.broadcast(_t(spark, sf_dir, "region").select("r_name"))).select(F.col("a_n_name").alias("a"), F.col("b_n_name").alias("b"), "r_name")


@query("q30_approx_count_distinct", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def q30(spark, sf_dir):
    """The estimate is within five standard errors of the exact count."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.countDistinct("l_partkey").alias("n"))
    return lines.select("l_returnflag", (F.abs(F.col("about") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))
