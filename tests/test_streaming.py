"""Streams into tables."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import changelog as cl
from tidemark.operators.changelog import Identity
from tidemark.streaming import ingest, transactions, wal, windows
from tidemark.tables.table import Table

SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.IntegerType())])


def test_rows_stream_survives_a_restart(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), SCHEMA, Identity.append_only())
    for part in (1, 2):
        spark.createDataFrame([(part, i) for i in range(5)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        ingest.append_rows(t, stream, "rows", str(tmp_path / "cp")).awaitTermination()
        assert t.read().count() == 5 * part


def test_changelog_stream(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), SCHEMA, Identity.key("k"))
    log = cl.upserts(spark.createDataFrame([(1, 1), (2, 2)], SCHEMA), 1)
    log = log.unionByName(cl.deletes(spark.createDataFrame([(2, 2)], SCHEMA), 2)).unionByName(cl.marks(log, [("C", 3, None)]))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    ingest.follow(t, stream, "log", str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in t.read().collect()] == [(1, 1)] and t.status()["flush_lsn"] == 3


def test_transactions_are_held_until_their_commit(spark, tmp_path):
    base = cl.appends(spark.createDataFrame([(1, 1)], SCHEMA), 1, 0, F.lit(1)).unionByName(cl.appends(spark.createDataFrame([(2, 2)], SCHEMA), 2, 0, F.lit(2))).unionByName(cl.appends(spark.createDataFrame([(3, 3)], SCHEMA), 2, 0, F.lit(3)))
    ends = cl.marks(base, [("C", 9, 1), ("X", 9, 3)])
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    for part in (base, ends):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = transactions.release_on_commit(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(transactions.RELEASED).parquet(str(tmp_path / "out")).collect()
    assert [(r["xact_id"], r["lsn"], r["payload"]) for r in got] == [(1, 9, '{"k":1,"v":1}')]


class State(dict):
    """A map and a value state, in memory."""

    updateValue, getValue = dict.__setitem__, dict.get  # noqa: N815

    def removeKey(self, key):  # noqa: N802
        del self[key]

    def update(self, value):
        self["v"] = value

    def get(self, key="v"):
        return dict.get(self, key)


def test_a_transaction_is_never_in_memory_as_a_whole():
    class Handle:
        def __init__(self):
            self.rows, self.count = State(), State()

        getMapState = lambda self, *_: self.rows  # noqa: E731, N815
        getValueState = lambda self, *_: self.count  # noqa: E731, N815

    rows = lambda a, b: pd.DataFrame({"op": "A", "lsn": range(a, b), "seq": 0, "payload": [None if i % 2 else f"p{i}" for i in range(a, b)]})
    end = lambda op: pd.DataFrame({"op": [op], "lsn": [99], "seq": [0], "payload": [None]})
    for op in ("C", "X"):
        handle, hold = Handle(), transactions.HoldUntilCommit()
        hold.init(handle)
        assert not list(hold.handleInputRows((7,), iter([rows(0, 25_000), rows(25_000, 25_001)]), None))
        out = list(hold.handleInputRows((7,), iter([end(op), rows(25_001, 25_005)]), None))
        assert not handle.rows and not handle.count
        if op == "X":
            assert not out
            continue
        assert max(map(len, out)) <= 10_000
        got = pd.concat(out)
        assert got["payload"].tolist() == rows(0, 25_005)["payload"].tolist() and set(got["lsn"]) == {99} and set(got["xact_id"]) == {7}


def test_replay_and_truncation(spark):
    log = cl.appends(spark.createDataFrame([(1, 1)], SCHEMA), 4).unionByName(cl.appends(spark.createDataFrame([(2, 2)], SCHEMA), 6))
    assert [r["lsn"] for r in wal.replay(log, 4).collect()] == [6]
    files = spark.createDataFrame([(1, 3, False), (2, 5, True), (3, 4, False)], "file_id int, highest_lsn int, has_open_xact boolean")
    assert [r["file_id"] for r in wal.truncate_below(files, 4).collect()] == [1]


def test_stream_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) AS ts, id % 2 AS k FROM range(12)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = windows.tumbling(stream, "ts", "1 hour", [F.count("*").alias("n")], ["k"], "10 minutes")
    out.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == 12 and spark.table("win").count() == 4
