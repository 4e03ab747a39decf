"""Streamed transactions held back in state until their commit.

Rows are kept per xact_id in the state store, which spills to disk, and come out with the
commit's LSN; an abort drops them.  Open transactions have no time limit.  The state's form
is not that of checkpoints made when rows were a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RELEASED = "xact_id int, op string, lsn bigint, seq int, payload string"


#: Rows of a chunk at most; a chunk is one value of the state.
CHUNK = 10_000
_KINDS = pa.schema([("op", pa.string()), ("lsn", pa.int64()), ("seq", pa.int32()), ("payload", pa.string())])


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows[_KINDS.names], _KINDS, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _KINDS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class HoldUntilCommit(StatefulProcessor):
    """Rows are held in packed chunks under their number, so that neither taking nor releasing a transaction has more than a chunk at once in Python or in the JVM, whose list state reads a key's list as one value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "n bigint", "chunk binary")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        commit, aborted = None, False
        before = held[0] if (held := self.count.get()) else 0
        n = before
        for pdf in rows:
            committed = pdf.loc[pdf["op"] == "C", "lsn"]
            if len(committed):
                commit = int(committed.iloc[-1])
            aborted = aborted or bool((pdf["op"] == "X").any())
            fresh = pdf[~pdf["op"].isin(["C", "X"])]
            for start in range(0, len(fresh), CHUNK):
                self.rows.updateValue((n,), (_packed(fresh.iloc[start : start + CHUNK]),))
                n += 1
        if commit is not None and not aborted:
            for i in range(n):
                chunk = pa.ipc.open_stream(self.rows.getValue((i,))[0]).read_pandas()
                yield pd.DataFrame({"xact_id": int(key[0]), "op": chunk["op"], "lsn": commit, "seq": chunk["seq"], "payload": chunk["payload"]})
        if commit is not None or aborted:
            for i in range(n):
                self.rows.removeKey((i,))
            self.count.clear()
        elif n > before:
            self.count.update((n,))

    def close(self) -> None:
        pass


def release_on_commit(events: DataFrame) -> DataFrame:
    """Streaming changelog rows (op, lsn, seq, xact_id, r) of transactions, as (xact_id, op, lsn, seq, payload) once they commit; payload is r as JSON. Needs the RocksDB state store."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = events.where(F.col("xact_id").isNotNull()).select("xact_id", "op", "lsn", "seq", F.to_json("r").alias("payload"))
    return keyed.groupBy("xact_id").transformWithStateInPandas(statefulProcessor=HoldUntilCommit(), outputStructType=RELEASED, outputMode="Append", timeMode="None")
