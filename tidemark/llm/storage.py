"""Where operators write tables that cut their lineage: the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: texts are long, so a batch of the default 10,000 rows could be large. A row above the bytes is a batch of its own.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20
#: Rows of a written table that are broadcast at most; they hold an id and a digest, about 100 bytes each in memory.
BROADCAST_ROWS = 1_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small. A lower setting stays."""
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = in_bytes(spark.conf.get(key))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_roots: dict[tuple[str, str], str] = {}


def _root(spark: SparkSession) -> str:
    """This session's folder under spark.checkpoint.dir, deleted when Python ends. Without that setting a local folder serves a local master alone: on a cluster no other machine would see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    key = (base, spark.sparkContext.applicationId)
    if key not in _roots:
        _roots[key] = f"{base.rstrip('/')}/tidemark/{uuid.uuid4().hex}"
        path, jvm = spark._jvm.org.apache.hadoop.fs.Path(_roots[key]), spark._jsc.hadoopConfiguration()

        def forget() -> None:
            try:
                path.getFileSystem(jvm).delete(path, True)
            except Exception:  # noqa: BLE001, S110 - the JVM is gone already
                pass

        atexit.register(forget)
    return _roots[key]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the executors share; it lives as long as this Python process."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor can't lose it."""
    return write(df, shared_dir(df.sparkSession, name))


class Scratch:
    """Tables that one call writes for itself, deleted when the call is done: its result must be a table that was cut elsewhere."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, shared_dir(spark, name), count()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.path)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return write(df, f"{self.path}/{next(self.n)}-{name}")

    def drop(self, table: DataFrame) -> None:
        """Delete a table of this scratch that no other reads any more."""
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(self.spark, folder)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it, so that df has no column of that name (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def match_written(rows: DataFrame, written: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join wide rows to a written table of small ones: by broadcast when a count shows the table to be small, else by shuffling both, whatever Spark estimates."""
    small = written.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(written) if small else written.hint("merge"), on, how)
