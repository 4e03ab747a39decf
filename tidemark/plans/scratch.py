"""Tables that a query makes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidemark.operators.changelog import Identity
from tidemark.tables.table import Table


_roots: dict[tuple[str, str], str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this session's folder under spark.checkpoint.dir, which is deleted when Python ends. A local folder serves a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    key = (base, spark.sparkContext.applicationId)
    if key not in _roots:
        _roots[key] = f"{base.rstrip('/')}/tidemark/{uuid.uuid4().hex}"
        path, conf = spark._jvm.org.apache.hadoop.fs.Path(_roots[key]), spark._jsc.hadoopConfiguration()

        def forget() -> None:
            try:
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # noqa: BLE001, S110 - the JVM is gone already
                pass

        atexit.register(forget)
    return f"{_roots[key]}/{name}-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession, schema: T.StructType, identity: Identity) -> Table:
    return Table.create(spark, scratch_path(spark, "table"), schema, identity)
