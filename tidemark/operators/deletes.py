"""Row-level deletes: sets of (file, row_index), kept and merged as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import policy

SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("row_index", T.LongType())])


def plain_path(path: Column) -> Column:
    """A file path without its scheme, so that file:/x and file:///x are one."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def with_position(files: DataFrame) -> DataFrame:
    """A Parquet scan with each row's place: file and physical row_index, which pushed filters don't change."""
    return files.select("*", plain_path(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__row"))


def mask(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Positioned rows that aren't deleted. Spark broadcasts the deletes when their measured size allows, and shuffles by position otherwise."""
    d = deleted.select(F.col("file").alias("__file"), F.col("row_index").alias("__row"))
    return rows.join(d, ["__file", "__row"], "left_anti")


def committed_visible(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows (file, row_index, lsn, ...) that no delete (file, row_index, lsn) covers that sees them: one of an LSN at or after the row's."""
    d = deleted.select(F.col("file").alias("__f"), F.col("row_index").alias("__r"), F.col("lsn").alias("__lsn"))
    same = (F.col("file") == F.col("__f")) & (F.col("row_index") == F.col("__r"))
    return rows.join(d, same & policy.visible_at(F.col("lsn"), F.col("__lsn")), "left_anti")


def merge(*sets: DataFrame) -> DataFrame:
    """The union of delete sets, each position once."""
    out = sets[0].select("file", "row_index")
    for s in sets[1:]:
        out = out.unionByName(s.select("file", "row_index"))
    return out.distinct()


def counts(deleted: DataFrame) -> DataFrame:
    return deleted.groupBy("file").agg(F.count("*").alias("deleted"))


def percentages(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """files (file, num_rows) with deleted and the whole-number deleted_percent."""
    out = files.join(counts(deleted), "file", "left").withColumn("deleted", F.coalesce("deleted", F.lit(0).cast("bigint")))
    return out.withColumn("deleted_percent", F.expr("CASE WHEN num_rows = 0 THEN 0 ELSE deleted * 100 div num_rows END"))


def active(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """The positions that aren't deleted of files (file, num_rows)."""
    every = files.where("num_rows > 0").select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("num_rows") - 1)).alias("row_index"))
    return every.join(deleted, ["file", "row_index"], "left_anti")


def committed_before(log: DataFrame, flush_lsn: int) -> DataFrame:
    """The delete log (file, row_index, lsn) up to a flush, as one sorted array of positions per file."""
    return log.where(F.col("lsn") < flush_lsn).groupBy("file").agg(F.sort_array(F.collect_set("row_index")).alias("row_indexes"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
