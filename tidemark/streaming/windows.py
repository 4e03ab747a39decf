"""Event-time windows, the same for streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, lateness: str | None) -> DataFrame:
    return df.withWatermark(time, lateness) if lateness and df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, aggregates: list[Column], keys: list[str] | None = None, lateness: str | None = None) -> DataFrame:
    return sliding(df, time, size, size, aggregates, keys, lateness)


def sliding(df: DataFrame, time: str, size: str, step: str, aggregates: list[Column], keys: list[str] | None = None, lateness: str | None = None) -> DataFrame:
    out = _late(df, time, lateness).groupBy(F.window(time, size, step).alias("w"), *(keys or [])).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, aggregates: list[Column], keys: list[str], lateness: str | None = None) -> DataFrame:
    out = _late(df, time, lateness).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def deduplicate(df: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """Each key once, as long as repeats come within the lateness."""
    return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
