"""A write-ahead log of events as a DataFrame: what recovery replays, and what may be dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.changelog import discard_persisted


def replay(events: DataFrame, persisted_lsn: int) -> DataFrame:
    """Committed and not yet persisted records, and all of open transactions; a transaction that was aborted isn't replayed."""
    aborted = events.where((F.col("op") == "X") & F.col("xact_id").isNotNull()).select("xact_id").distinct()
    return discard_persisted(events, persisted_lsn).join(aborted, "xact_id", "left_anti").select(events.columns)


def truncate_below(files: DataFrame, persisted_lsn: int) -> DataFrame:
    """Log files (file_id, highest_lsn, has_open_xact) that recovery no longer needs."""
    needed = files.where((F.col("highest_lsn") > persisted_lsn) | F.col("has_open_xact")).agg(F.min("file_id").alias("low")).select("low").scalar()
    return files.where(needed.isNull() | (F.col("file_id") < needed))
