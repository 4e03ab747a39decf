"""Row sources of a table: JSON, protobuf, Avro and Parquet, as appended, upserted or deleted rows.

Each row is a transaction of its own: the n-th row of a call has the LSN base + 2n and its
commit base + 2n + 1; a Parquet file's rows have one LSN each and one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.errors import InvalidArgument
from tidemark.functions import binary_rows, json_rows, otlp
from tidemark.functions.types import struct_from_avro
from tidemark.operators import changelog as cl
from tidemark.tables.manifest import Manifest
from tidemark.tables.table import Table

OPERATIONS = ("insert", "upsert", "delete")


def ingest_rows(table: Table, rows: DataFrame, operation: str = "insert") -> Manifest:
    """Typed rows of one call, committed together at the next LSN."""
    operation = operation.lower()
    if operation not in OPERATIONS:
        raise InvalidArgument(f"unknown operation {operation!r}")
    lsn = table.manifest.commit_lsn + 1
    seq = F.monotonically_increasing_id() % (1 << 29)
    if operation == "insert":
        events = cl.appends(rows, lsn, 0)
    elif operation == "upsert":
        events = cl.upserts(rows, lsn, seq)
    else:
        events = cl.deletes(table._padded(rows), lsn, 0, if_exists=True)
    return table.write_events(events.unionByName(cl.marks(events, [("C", lsn + 1, None)])))


def ingest_json(table: Table, lines: DataFrame, operation: str = "insert", column: str = "value") -> tuple[Manifest, DataFrame]:
    """Valid rows go in; the rejected lines and their errors come back."""
    good, bad = json_rows.rows_and_errors(lines, table.schema, column)
    return ingest_rows(table, good, operation), bad


def ingest_protobuf(table: Table, data: DataFrame, operation: str = "insert", column: str = "value") -> Manifest:
    return ingest_rows(table, binary_rows.decode_protobuf(data, table.schema, column), operation)


class AvroSource:
    """Avro data for one table, by schemas that are registered under ids and must match the table."""

    def __init__(self, table: Table):
        self.table, self.schemas = table, {}

    def set_schema(self, schema_id: int, schema: str) -> None:
        if schema_id in self.schemas:
            return
        kind, own = struct_from_avro(schema), self.table.schema
        if [(f.name, f.dataType.simpleString()) for f in kind.fields] != [(f.name, f.dataType.simpleString()) for f in own.fields]:
            raise InvalidArgument("the schema isn't the table's")
        self.schemas[schema_id] = schema

    def ingest(self, data: DataFrame, schema_id: int, column: str = "value") -> Manifest:
        if schema_id not in self.schemas:
            raise InvalidArgument(f"no schema {schema_id}")
        return ingest_rows(self.table, binary_rows.decode_avro(data, self.schemas[schema_id], column), "insert")


def upload(spark: SparkSession, table: Table, paths: list[str], operation: str = "insert") -> Manifest:
    """insert: rows go through the changelog, one commit per file; upload: files are adopted as they are."""
    if operation == "upload":
        return table.load_files(paths, table.manifest.commit_lsn + 1)
    if operation != "insert":
        raise InvalidArgument(f"unknown operation {operation!r}")
    m = table.manifest
    for path in paths:
        base = m.commit_lsn + 1
        rows = spark.read.schema(table.schema).parquet(path)
        events = parquet_events(rows, base)
        end = events.agg(F.max("lsn")).first()[0]
        m = table.write_events(events.unionByName(cl.marks(events, [("C", (end if end is not None else base) + 1, None)])))
    return m


def parquet_events(rows: DataFrame, base_lsn: int) -> DataFrame:
    """Appends with the LSNs base + row number, in each file's physical order."""
    place = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = place.groupBy("__file").agg(F.max("__row").alias("__last"))
    before = sizes.select("__file", F.coalesce(F.sum(F.col("__last") + 1).over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = place.join(before, "__file").withColumn("__lsn", F.lit(base_lsn) + F.col("__before") + F.col("__row"))
    return cl._events(numbered.select(*rows.columns, "__lsn"), "A", F.col("__lsn"), 0, None, False).select("op", "lsn", "seq", "xact_id", "delete_if_exists", F.struct(*[F.col(f"r.`{c}`") for c in rows.columns]).alias("r"))


def ingest_otlp_json(requests: DataFrame, column: str = "value") -> DataFrame:
    """Points with the table that each is for; see otlp.flatten_metrics and otlp.route."""
    return otlp.route(otlp.flatten_metrics(requests, column))
