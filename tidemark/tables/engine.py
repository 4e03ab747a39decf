"""The engine: a catalog of tables in a folder, and what a service would offer on them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument, Permanent
from tidemark.operators import policy
from tidemark.operators.changelog import Identity
from tidemark.tables.files import Files
from tidemark.tables.table import Table


class Engine:
    """<root>/<database>/<table>/ holds a table; <root>/<database>/<table>/entry.json what the catalog knows of its source."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _path(self, database: str, name: str) -> str:
        for part in (database, name):
            if not part or "/" in part or part.startswith("."):
                raise InvalidArgument(f"bad name {part!r}")
        return f"{self.root}/{database}/{name}"

    def create_table(self, database: str, name: str, schema: T.StructType, identity: Identity | None = None, source: str = "rest", source_uri: str | None = None, config: dict | None = None) -> Table:
        """config: settings: append_only, row_identity, skip_index_merge, skip_data_compaction, mem_slice_rows, ..."""
        config = dict(config or {})
        append_only = config.pop("append_only", None)
        if identity is None:
            identity = Identity.append_only() if append_only else Identity.full_row()
        known = set(policy.TableConfig.__dataclass_fields__)
        if not set(config) <= known:
            raise InvalidArgument(f"unknown settings {sorted(set(config) - known)}")
        table = Table.create(self.spark, self._path(database, name), schema, identity, policy.TableConfig(**config), append_only)
        self.files.replace(f"{table.path}/entry.json", json.dumps({"database": database, "table": name, "source": source, "source_uri": source_uri}))
        return table

    def table(self, database: str, name: str) -> Table:
        path = self._path(database, name)
        if not self.files.exists(f"{path}/entry.json"):
            raise Permanent(f"no table {database}.{name}")
        return Table(self.spark, path)

    def drop_table(self, database: str, name: str) -> bool:
        """False when there was none."""
        path = self._path(database, name)
        there = self.files.exists(path)
        if there:
            self.files.delete(path)
        return there

    def rename_table(self, database: str, old: str, new: str) -> Table:
        """Only of a table without data: manifests name files by their whole path."""
        table, to = self.table(database, old), self._path(database, new)
        if table.manifest.files or table.manifest.wal:
            raise Permanent("a table with data can't be renamed")
        fs, p = self.files._at(table.path)
        fs.rename(p, self.files._at(to)[1])
        return Table(self.spark, to)

    def databases(self) -> list[str]:
        return self.files.folders(self.root)

    def names(self) -> list[tuple[str, str]]:
        return [(d, t) for d in self.databases() for t in self.files.folders(f"{self.root}/{d}") if self.files.exists(f"{self.root}/{d}/{t}/entry.json")]

    def list_tables(self) -> DataFrame:
        """database, table, commit_lsn, flush_lsn, cardinality, persisted_live_rows, location."""
        rows = []
        for d, t in self.names():
            s = self.table(d, t).status()
            rows.append((d, t, s["commit_lsn"], s["flush_lsn"], s["cardinality"], s["persisted_live_rows"], s["location"]))
        return self.spark.createDataFrame(rows, "database string, table string, commit_lsn bigint, flush_lsn bigint, cardinality bigint, persisted_live_rows bigint, location string")

    tables = list_tables

    def schema(self, database: str, name: str) -> T.StructType:
        return self.table(database, name).schema

    def read(self, database: str, name: str, min_lsn: int | None = None) -> DataFrame:
        return self.table(database, name).read(min_lsn)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the live tables; each is a view <database>__<table>, and <table> where the name is unique."""
        names = self.names()
        for d, t in names:
            df = self.table(d, t).read()
            df.createOrReplaceTempView(f"{d}__{t}")
            if sum(n == t for _, n in names) == 1:
                df.createOrReplaceTempView(t)
        return self.spark.sql(text)

    def optimize(self, database: str, name: str, mode: str = "data"):
        return self.table(database, name).optimize(mode)

    def create_snapshot(self, database: str, name: str, lsn: int):
        return self.table(database, name).create_snapshot(lsn)

    def flush(self, database: str, name: str, lsn: int | None = None):
        return self.table(database, name).flush(lsn)

    def load_files(self, database: str, name: str, paths: list[str], lsn: int | None = None):
        table = self.table(database, name)
        return table.load_files(paths, table.manifest.commit_lsn + 1 if lsn is None else lsn)

    def recover(self) -> list[Table]:
        """Open every table from its latest manifest; unflushed events are in the write-ahead log."""
        return [self.table(d, t) for d, t in self.names()]
