"""Changelog reduction against a stack model, and the rules of visibility."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changelog as cl
from tidemark.operators.changelog import Identity

EVENTS = "op string, lsn bigint, seq int, xact_id int, delete_if_exists boolean, r struct<k:int,v:int>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def model(events):
    """Per key a stack of live rows: a delete takes the top, if there is one."""
    live = defaultdict(list)
    for op, _, _, _, _, (k, v) in sorted(events, key=lambda e: (e[1], e[2], e[0] != "D")):
        if op == "A":
            live[k].append((k, v))
        elif live[k]:
            live[k].pop()
    return sorted((r for s in live.values() for r in s), key=repr)


def test_reduce_equals_stack_model(spark):
    rng = random.Random(7)
    events = []
    for seed in range(60):
        for n in range(rng.randint(1, 14)):
            key = None if rng.random() < 0.05 else seed * 10 + rng.randint(0, 2)
            events.append((rng.choice("AAD"), len(events), n, None, True, (key, rng.randint(0, 3))))
    df = spark.createDataFrame(events, EVENTS)
    assert rows(cl.reduce(df, Identity.key("k"))) == model(events)


def test_full_row_multiset(spark):
    a = spark.createDataFrame([(1, 1)] * 5 + [(2, 2)], "k int, v int")
    d = spark.createDataFrame([(1, 1)] * 3, "k int, v int")
    events = cl.appends(a, 1).unionByName(cl.deletes(d, 2))
    expected = [(1, 1), (1, 1), (2, 2)]
    assert rows(cl.reduce(events, Identity.full_row())) == expected
    assert rows(cl.net_multiset(events)) == expected


def test_strict_delete_of_nothing_raises(spark):
    d = spark.createDataFrame([(1, 1)], "k int, v int")
    with pytest.raises(Exception, match="strict delete"):
        cl.reduce(cl.appends(d.withColumn("k", F.lit(2)), 1).unionByName(cl.deletes(d, 1)), Identity.key("k"), strict=True).collect()
    assert cl.reduce(cl.deletes(d, 1, if_exists=True), Identity.key("k"), strict=True).count() == 0


def test_commit_makes_smaller_lsns_visible(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    log = cl.appends(a, F.col("k") * 10)
    log = log.unionByName(cl.marks(log, [("C", 20, None)]))
    assert rows(cl.resolve(log).select("r.k")) == [(1,)]
    assert cl.resolve(log, at_lsn=19).count() == 0


def test_transactions(spark):
    base = cl.appends(spark.createDataFrame([(1, 0)], "k int, v int"), 1)
    log = base
    for xact in (1, 2, 3):
        log = log.unionByName(cl.appends(spark.createDataFrame([(10 + xact, xact)], "k int, v int"), 5, 0, F.lit(xact)))
    own = cl.deletes(spark.createDataFrame([(11, 1)], "k int, v int"), 5, 1, F.lit(1))
    log = log.unionByName(own).unionByName(cl.marks(log, [("C", 9, None), ("C", 12, 1), ("X", 12, 2)]))
    assert rows(cl.reduce(cl.resolve(log), Identity.key("k"))) == [(1, 0)]


def test_initial_copy_drops_changes_up_to_the_boundary(spark):
    copy = spark.createDataFrame([(1, 0)], "k int, v int")
    late = cl.upserts(spark.createDataFrame([(1, 5)], "k int, v int"), 11)
    early = cl.upserts(spark.createDataFrame([(1, 4)], "k int, v int"), 10)
    assert rows(cl.reduce(cl.initial_copy(copy, 10, early.unionByName(late)), Identity.key("k"))) == [(1, 5)]


def test_unique_keys_path_needs_no_window(spark):
    log = cl.upserts(spark.createDataFrame([(1, 5)], "k int, v int"), 1)
    plan = cl.reduce(log, Identity.key("k"), unique_keys=True)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_matching_has_no_frame_up_to_the_end_of_a_key(spark):
    """Spark computes a frame up to UNBOUNDED FOLLOWING anew for each row: a key's time was the square of its rows."""
    d = spark.createDataFrame([(1, 1)], "k int, v int")
    plan = cl.reduce(cl.appends(d, 1).unionByName(cl.deletes(d, 2)), Identity.key("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower() and "unboundedpreceding" in plan.lower()


def test_equal_positions_of_one_key_lose_one_row_a_delete(spark):
    """40,000 appends of one (lsn, seq): their order is open, and the count isn't."""
    a = spark.range(40_000).selectExpr("CAST(NULL AS int) AS k", "CAST(id AS int) AS v")
    gone = cl.deletes(a.where("v < 7"), 2)
    kept = cl.reduce(cl.appends(a, 1).unionByName(gone).unionByName(cl.appends(a.where("v < 3"), 3)), Identity.key("k"))
    assert kept.count() == 40_000 - 7 + 3
