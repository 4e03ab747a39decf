"""Decisions about flushing, persistence, compaction, index merges and LSNs.

Pure functions over small values, or filters over manifest rows; the defaults are those of
a release build.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIB = 1 << 20


@dataclass(frozen=True)
class TableConfig:
    """The defaults of the knobs."""

    mem_slice_rows: int = 131_072
    batch_rows: int = 4096
    snapshot_deletes: int = 1000
    persist_new_files: int = 1
    persist_deletes: int = 1000
    file_bytes: int = 128 * MIB
    skip_index_merge: bool = False
    skip_data_compaction: bool = False


@dataclass(frozen=True)
class CompactionConfig:
    min_files: int = 16
    max_files: int = 32
    final_bytes: int = 512 * MIB
    deleted_percent: int = 50

    def forced(self) -> CompactionConfig:
        return CompactionConfig(2, self.max_files, self.final_bytes, self.deleted_percent)

    def full(self) -> CompactionConfig:
        """Everything that has any deleted row, or can be merged."""
        return CompactionConfig(1, 1 << 30, self.final_bytes, 1)


@dataclass(frozen=True)
class IndexMergeConfig:
    min_files: int = 16
    max_files: int = 32
    final_bytes: int = 512 * MIB

    def forced(self) -> IndexMergeConfig:
        return IndexMergeConfig(2, self.max_files, self.final_bytes)


def select_for_compaction(files: DataFrame, config: CompactionConfig = CompactionConfig(), full: bool = False) -> DataFrame:
    """Manifest rows (file, bytes, num_rows, deleted) to compact: small or mostly deleted files, smallest first.

    None at all when fewer than config.min_files qualify.  `files` is a table's manifest,
    so it fits one task.
    """
    percent = F.expr("CASE WHEN num_rows = 0 THEN 0 ELSE deleted * 100 div num_rows END")
    chosen = files.withColumn("deleted_percent", percent)
    if not full:
        chosen = chosen.where((F.col("bytes") < config.final_bytes) | (F.col("deleted_percent") >= config.deleted_percent))
    total = F.count("*").over(Window.partitionBy())
    ranked = chosen.withColumn("__n", total).withColumn("__rank", F.row_number().over(Window.orderBy("bytes", "file")))
    return ranked.where((F.col("__n") >= config.min_files) & (F.col("__rank") <= config.max_files)).drop("__n", "__rank")


def select_indexes_to_merge(indexes: DataFrame, config: IndexMergeConfig = IndexMergeConfig()) -> DataFrame:
    """Index rows (file, bytes) to merge."""
    small = indexes.where(F.col("bytes") < config.final_bytes)
    ranked = small.withColumn("__n", F.count("*").over(Window.partitionBy())).withColumn("__rank", F.row_number().over(Window.orderBy("bytes", "file")))
    return ranked.where((F.col("__n") >= config.min_files) & (F.col("__rank") <= config.max_files)).drop("__n", "__rank")


def should_flush(buffered_rows: int, config: TableConfig = TableConfig()) -> bool:
    return buffered_rows >= config.mem_slice_rows


def should_snapshot(new_commits: bool, transactions: bool, deletes: int, results: bool, config: TableConfig = TableConfig()) -> bool:
    return new_commits or transactions or results or deletes >= config.snapshot_deletes


def should_persist(new_files: int, deletes: int, maintenance_results: int, flush_lsn: int | None, oldest_ongoing_flush: int | None, config: TableConfig = TableConfig()) -> bool:
    """Enough to persist, and no earlier flush is still under way."""
    enough = new_files >= config.persist_new_files or deletes >= config.persist_deletes or maintenance_results >= 1
    ordered = oldest_ongoing_flush is None or (flush_lsn is not None and flush_lsn < oldest_ongoing_flush)
    return enough and ordered


def visible_at(row_lsn, delete_lsn):
    """A delete sees rows flushed or committed no later than itself; for numbers or Columns."""
    return row_lsn <= delete_lsn


def confirmed_flush_lsn(tables: DataFrame) -> DataFrame:
    """Over tables (wal_flush_lsn, persisted_lsn): what the source may forget: the least of each table's WAL LSN, or persisted LSN where it has none."""
    effective = F.when(F.col("wal_flush_lsn") > 0, F.col("wal_flush_lsn")).otherwise(F.col("persisted_lsn"))
    return tables.agg(F.min(effective).alias("confirmed_lsn"))


def persisted_table_lsn(persisted: int | None, commit: int | None, replication: int) -> int | None:
    """A table with nothing unpersisted is as fresh as its source."""
    if persisted is None:
        return None if commit is not None else replication
    return replication if commit is not None and persisted >= commit else persisted


def may_serve_cached(requested: int | None, cached: int, snapshot: int | None, commit: int) -> bool:
    """A cached read serves a request that it is fresh enough for, and the latest only when nothing newer is committed."""
    if requested is None:
        return snapshot is not None and cached >= commit and snapshot == cached
    return requested <= cached


def may_read(requested: int | None, snapshot: int | None, commit: int, replication: int) -> bool:
    """A requested LSN is a lower bound of freshness; a clean snapshot counts as of the replication LSN."""
    if snapshot is None:
        return False
    if requested is None or requested <= snapshot:
        return True
    return requested <= replication and snapshot == commit


def wal_files_to_keep(files: DataFrame, persisted_lsn: int) -> DataFrame:
    """WAL files (file_id, highest_lsn, has_open_xact): from the lowest one that recovery could still need."""
    needed = files.where((F.col("highest_lsn") > persisted_lsn) | F.col("has_open_xact")).agg(F.min("file_id").alias("low")).select("low").scalar()
    return files.where(F.col("file_id") >= needed)


def range_shards(blocks: int, shards: int) -> list[tuple[int, int | None]]:
    """Disjoint block ranges that cover a table; the last is unbounded, so rows added meanwhile are in it."""
    shards = max(1, min(shards, max(1, blocks)))
    step = -(-max(1, blocks) // shards)
    starts = list(range(0, max(1, blocks), step))
    return [(s, starts[i + 1] if i + 1 < len(starts) else None) for i, s in enumerate(starts)]


def ctid_predicates(blocks: int, shards: int) -> list[str]:
    """The ranges as predicates on a heap table's row address, for a partitioned JDBC read."""
    return [f"ctid >= '({a},0)'::tid" + (f" AND ctid < '({b},0)'::tid" if b is not None else "") for a, b in range_shards(blocks, shards)]


@dataclass(frozen=True)
class IndexInfo:
    columns: tuple[str, ...]
    primary: bool = False
    unique: bool = True
    partial: bool = False
    deferrable: bool = False
    expression: bool = False


def discover_key(indexes: list[IndexInfo], not_null: set[str]) -> tuple[str, ...] | None:
    """The columns of the first usable unique index, primary first; None: the whole row is the identity."""
    for x in sorted(indexes, key=lambda x: not x.primary):
        if x.unique and not (x.partial or x.deferrable or x.expression) and set(x.columns) <= not_null:
            return x.columns
    return None
