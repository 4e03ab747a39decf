"""Streams into tables: exactly once by the number of the micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import changelog as cl
from tidemark.tables.table import Table


def follow(table: Table, events: DataFrame, name: str, checkpoint: str, trigger: dict | None = None, flush: bool | None = True) -> StreamingQuery:
    """Write a streaming changelog to the table; the manifest keeps `name`'s last batch, so a repeated batch is a no-op.

    flush: after each batch with a commit; None: when the table's thresholds are reached.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        before = table.manifest
        after = table.write_events(batch, name, batch_id)
        if flush is None:
            table.tick()
        elif flush and after.commit_lsn > before.commit_lsn:
            table.flush()

    writer = events.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_rows(table: Table, rows: DataFrame, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of plain rows: each micro-batch is one commit."""
    def write(batch: DataFrame, batch_id: int) -> None:
        lsn = table.manifest.commit_lsn + 1
        events = cl.appends(batch, lsn)
        table.write_events(events.unionByName(cl.marks(events, [("C", lsn + 1, None)])), name, batch_id)
        table.flush()

    return rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def upsert_latest(table: Table, rows: DataFrame, keys: list[str], order: str, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch's last row per key, by `order`, replaces the key's row."""
    def write(batch: DataFrame, batch_id: int) -> None:
        lsn = table.manifest.commit_lsn + 1
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        events = cl.upserts(last, lsn)
        table.write_events(events.unionByName(cl.marks(events, [("C", lsn + 1, None)])), name, batch_id)
        table.flush()

    return rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
