"""Change data: decoded replication messages, initial copies and COPY text as changelogs.

Messages come as a DataFrame, in the shape that logical decoding to JSON has: op (I, U, D,
B, C, and SS, SC, SA for the start, commit and abort of a streamed transaction), lsn, seq,
xact_id, and the old and new row as structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument
from tidemark.functions.scalars import postgres_value
from tidemark.operators import changelog as cl
from tidemark.operators.policy import ctid_predicates
from tidemark.tables.table import nullable


def changelog_from_messages(messages: DataFrame, toast: str = "keep", keys: list[str] | None = None) -> DataFrame:
    """messages (op, lsn, seq, xact_id, old, new) as changelog events.

    An update is a strict delete of the old row, then an append.  toast: columns that the
    source left out of `new` because they didn't change are null there; "keep" takes
    them from `old`, "default" leaves them.  An update without an old row is one by key.
    """
    if toast not in ("keep", "default"):
        raise InvalidArgument("toast is keep or default")
    row: T.StructType = nullable(messages.schema["new"].dataType)
    messages = messages.withColumn("old", F.col("old").cast(row)).withColumn("new", F.col("new").cast(row))
    new, old = F.col("new"), F.coalesce("old", "new")
    if toast == "keep":
        fixed = set(keys or [])
        new = F.when(new.isNotNull(), F.struct(*[(new[f] if f in fixed else F.coalesce(new[f], F.when(F.col("old").isNotNull() & F.array_contains(F.coalesce("unchanged", F.array().cast("array<string>")), f), F.col("old")[f]))).alias(f) if "unchanged" in messages.columns else new[f].alias(f) for f in row.names]))
    null = F.lit(None).cast(row)
    event = lambda op, n, r: F.struct(F.lit(op).alias("op"), (F.col("seq") * 2 + n).cast("int").alias("seq"), r.cast(row).alias("r"))
    events = (
        F.when(F.col("op") == "I", F.array(event("A", 1, new)))
        .when(F.col("op") == "D", F.array(event("D", 0, old)))
        .when(F.col("op") == "U", F.array(event("D", 0, old), event("A", 1, new)))
        .when(F.col("op").isin("C", "SC"), F.array(event("C", 0, null)))
        .when(F.col("op") == "SA", F.array(event("X", 0, null)))
        .when(F.col("op") == "T", F.raise_error(F.lit("truncate isn't supported")).cast("array<struct<op:string,seq:int,r:" + row.simpleString() + ">>"))
    )
    out = messages.select(F.explode(events).alias("e"), F.col("lsn").cast("bigint").alias("lsn"), F.col("xact_id").cast("int").alias("xact_id"))
    return out.select("e.op", "lsn", "e.seq", "xact_id", F.lit(False).alias("delete_if_exists"), "e.r")


def after_frame(messages: DataFrame, watermark: int, end: str = "lsn") -> DataFrame:
    """Frames that end after the watermark; earlier ones were seen before."""
    return messages.where(F.col(end) > watermark)


def initial_copy_jdbc(spark: SparkSession, url: str, table: str, blocks: int, shards: int = 4, properties: dict | None = None) -> DataFrame:
    """A table read in disjoint ranges of row addresses, one task each."""
    return spark.read.jdbc(url, table, predicates=ctid_predicates(blocks, shards), properties=properties or {})


def copy_text(lines: DataFrame, columns: list[tuple[str, str]], column: str = "value") -> DataFrame:
    r"""COPY text rows: tab separated, \N null, backslash escapes."""
    parts = F.split(F.col(column), r"\t")
    escapes = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}

    def plain(x: Column) -> Column:
        out = F.regexp_replace(x, r"\\\\", "\x00")  # an escaped backslash, out of the others' way
        for letter, char in escapes.items():
            out = F.regexp_replace(out, rf"\\{letter}", char)
        return F.replace(F.regexp_replace(out, r"\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))

    values = [F.when(F.get(parts, i) != r"\N", plain(F.get(parts, i))) for i in range(len(columns))]
    wrong = F.size(parts) != len(columns)
    first = F.when(wrong, F.raise_error(F.lit("wrong number of columns"))).otherwise(values[0])
    return lines.select(*[postgres_value(v, t).alias(n) for v, (n, t) in zip([first, *values[1:]], columns, strict=True)])


def write_copy(df: DataFrame, path: str, writers: int = 4, rows_per_file: int = 1_000_000) -> None:
    """Parquet by a number of writers, with files of bounded size."""
    df.repartition(writers).write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def copy_then_follow(snapshot: DataFrame, boundary_lsn: int, messages: DataFrame) -> DataFrame:
    return cl.initial_copy(snapshot, boundary_lsn, changelog_from_messages(messages))
