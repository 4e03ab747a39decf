"""Tables: life cycle, recovery, maintenance, and a randomised model run."""

import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument, Permanent, Temporary
from tidemark.operators import changelog as cl
from tidemark.operators.changelog import Identity
from tidemark.sources import rows as sources
from tidemark.tables.engine import Engine
from tidemark.tables.table import Table

SCHEMA = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType())])


def make(spark, tmp_path, identity=None):
    return Table.create(spark, str(tmp_path / "t"), SCHEMA, identity or Identity.key("id"))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def read(table):
    return Counter(map(tuple, table.read().collect()))


def test_life_of_a_table(spark, tmp_path):
    t = make(spark, tmp_path)
    t.append(frame(spark, [(1, "a", 1), (2, "b", 2), (3, "c", 3)]), 1)
    assert not read(t)  # nothing is committed
    t.commit(2)
    assert sum(read(t).values()) == 3
    t.flush()
    t.delete(spark.createDataFrame([(2,)], "id int"), 3)
    t.upsert(frame(spark, [(3, "z", 9), (4, "d", 4)]), 4)
    t.commit(5)
    expected = Counter({(1, "a", 1): 1, (3, "z", 9): 1, (4, "d", 4): 1})
    assert read(t) == expected
    t.flush()
    assert read(t) == expected
    s = t.status()
    assert (s["commit_lsn"], s["flush_lsn"], s["cardinality"], s["persisted_live_rows"]) == (5, 5, 5, 3)
    assert read(Table(spark, t.path)) == expected  # from the manifest alone
    t.optimize("full")
    assert read(t) == expected and t.status()["cardinality"] == 3
    assert t.vacuum() > 0 and read(t) == expected


def test_read_waits_for_its_lsn(spark, tmp_path):
    t = make(spark, tmp_path)
    t.append(frame(spark, [(1, "a", 1)]), 1)
    t.commit(2)
    with pytest.raises(Temporary):
        t.read(min_lsn=99)
    assert t.read(min_lsn=2).count() == 1
    with pytest.raises(Temporary):
        t.create_snapshot(99)


def test_open_transaction_outlives_a_flush(spark, tmp_path):
    t = make(spark, tmp_path)
    from pyspark.sql import functions as F

    t.write_events(cl.appends(frame(spark, [(7, "x", 7)]), 1, 0, F.lit(5)))
    t.append(frame(spark, [(1, "a", 1)]), 2)
    t.commit(3)
    t.flush()
    assert read(t) == Counter({(1, "a", 1): 1})
    t.commit(9, xact_id=5)
    assert read(t) == Counter({(1, "a", 1): 1, (7, "x", 7): 1})
    t.flush()
    assert read(t) == Counter({(1, "a", 1): 1, (7, "x", 7): 1})


def test_a_batch_counts_once(spark, tmp_path):
    t = make(spark, tmp_path)
    log = cl.appends(frame(spark, [(1, "a", 1)]), 1)
    log = log.unionByName(cl.marks(log, [("C", 2, None)]))
    for _ in range(3):
        t.write_events(log, "stream", 0)
    assert sum(read(t).values()) == 1


def test_load_alter_and_index(spark, tmp_path):
    t = make(spark, tmp_path)
    frame(spark, [(i, str(i), i) for i in range(50)]).write.parquet(str(tmp_path / "in"))
    t.load_files([str(tmp_path / "in")], 3)
    with pytest.raises(InvalidArgument):
        t.load_files([str(tmp_path / "in")], 4)
    t.build_index()
    assert [r["id"] for r in t.lookup(spark.createDataFrame([(7,), (77,)], "id int")).collect()] == [7]
    t.alter(drop=["age"], add=[T.StructField("note", T.StringType())])
    assert t.read().columns == ["id", "name", "note"] and t.read().where("note IS NULL").count() == 50
    assert t.persisted(prune={"id": (100, 200)}).count() == 0
    with pytest.raises(InvalidArgument):
        t.alter(drop=["id"])


def test_append_only_ignores_deletes(spark, tmp_path):
    t = make(spark, tmp_path, Identity.append_only())
    t.append(frame(spark, [(1, "a", 1)]), 1)
    t.delete(frame(spark, [(1, "a", 1)]), 2)
    t.commit(3)
    assert sum(read(t).values()) == 1


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    t = e.create_table("d", "people", SCHEMA, Identity.key("id"))
    sources.ingest_rows(t, frame(spark, [(1, "a", 1), (2, "b", 2)]))
    assert e.sql("SELECT count(*) AS n FROM people").first()["n"] == 2
    assert e.list_tables().first()["cardinality"] == 2 and e.schema("d", "people") == SCHEMA
    assert e.drop_table("d", "people") and not e.drop_table("d", "people")
    with pytest.raises(Permanent):
        e.table("d", "people")
    with pytest.raises(InvalidArgument):
        e.create_table("d", "x", SCHEMA, Identity.key("id"), config={"append_only": True})


@pytest.mark.parametrize("seed", range(4))
def test_random_life(spark, tmp_path, seed):
    """Random appends, deletes, upserts, commits, flushes, compactions and reopenings against a Counter of rows."""
    rng = random.Random(seed)
    keyed = seed % 2 == 0
    t = make(spark, tmp_path, Identity.key("id") if keyed else Identity.full_row())
    live, pending, lsn = [], [], 1
    for _ in range(12):
        lsn += 1
        what = rng.choice(["append", "append", "delete", "upsert", "commit", "flush", "optimize", "reopen"])
        state = live + [r for op, r in pending if op == "A"]
        if what == "append":
            fresh = [(1000 * lsn + i, rng.choice("ab"), rng.randint(0, 2)) for i in range(3)]
            t.append(frame(spark, fresh), lsn)
            pending += [("A", r) for r in fresh]
        elif what == "delete" and [r for r in live if ("D", r) not in pending]:
            r = rng.choice([r for r in live if ("D", r) not in pending])
            t.write_events(cl.deletes(frame(spark, [r]), lsn))
            pending.append(("D", r))
        elif what == "upsert" and keyed:
            r = (state[0][0] if state else 5, "u", lsn)
            t.upsert(frame(spark, [r]), lsn)
            pending += [("U", r)]
        elif what in ("commit", "flush", "optimize"):
            t.commit(lsn)
            for op, r in pending:
                if op == "A":
                    live.append(r)
                elif op == "D":
                    live.remove(r) if r in live else live.remove(next(x for x in live if x[0] == r[0])) if any(x[0] == r[0] for x in live) else None
                else:
                    live = [x for x in live if x[0] != r[0]] + [r]
            pending = []
            if what != "commit":
                t.flush()
            if what == "optimize":
                t.optimize("full")
        else:
            t = Table(spark, t.path)
        assert read(t) == Counter(live), (seed, what)


def test_vacuum_leaves_adopted_files(spark, tmp_path):
    outside = tmp_path / "given"
    frame(spark, [(1, "a", 1), (2, "b", 2)]).coalesce(1).write.parquet(str(outside))
    before = sorted(p.name for p in outside.iterdir())
    t = make(spark, tmp_path)
    t.load_files([str(outside)], 1)
    t.delete(spark.createDataFrame([(2,)], "id int"), 2)
    t.commit(3)
    t.flush()
    t.optimize("full")
    assert t.vacuum() > 0
    assert sorted(p.name for p in outside.iterdir()) == before
    assert read(t) == Counter({(1, "a", 1): 1})


def test_a_pinned_state_outlives_vacuum(spark, tmp_path):
    t = make(spark, tmp_path)
    t.append(frame(spark, [(1, "a", 1), (2, "b", 2)]), 1)
    t.commit(2)
    t.flush()
    state, pin = t.begin_scan()
    t.delete(spark.createDataFrame([(2,)], "id int"), 3)
    t.commit(4)
    t.flush()
    t.optimize("full")
    t.vacuum()
    assert t.persisted(state).count() == 2
    t.end_scan(pin)
    t.vacuum()
    assert not any(t.files.exists(f.path) for f in state.files) and t.read().count() == 1


def test_deletes_do_not_shuffle_the_base(spark, tmp_path):
    t = make(spark, tmp_path)
    t.append(frame(spark, [(i, "a", i) for i in range(100)]), 1)
    t.commit(2)
    t.flush()
    t.delete(spark.createDataFrame([(2,)], "id int"), 3)
    t.commit(4)
    t.flush()
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan
    assert t.read(prune={"id": (10, 19)}).count() == 10 and not t.read(prune={"id": (1000, None)}).count()


def test_thresholds_query_holds_for_tables_of_any_size(spark, tmp_path):
    """A fiftieth of 6,000 customers is more than 100 rows, which was the threshold whatever the table."""
    from tidemark.plans import QUERIES

    spark.range(6000).selectExpr("id AS c_custkey", "'S' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    assert tuple(QUERIES["e43_thresholds"](spark, str(tmp_path)).first()) == (2, 6000, 120)


def test_appends_alone_are_read_without_matching(spark, tmp_path):
    t = make(spark, tmp_path)
    t.append(frame(spark, [(1, "a", 1), (1, "a", 1)]), 1)
    t.commit(2)
    assert read(t) == Counter({(1, "a", 1): 2})
    assert "Window" not in t.read()._jdf.queryExecution().optimizedPlan().toString()
    t.flush()
    t.append(frame(spark, [(2, "b", 2)]), 3)
    t.commit(4)
    assert read(t) == Counter({(1, "a", 1): 2, (2, "b", 2): 1})
    t.delete(spark.createDataFrame([(1,)], "id int"), 5)
    t.commit(6)
    assert read(t) == Counter({(1, "a", 1): 1, (2, "b", 2): 1})
