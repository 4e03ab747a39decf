"""Changelogs and their reduction to a table's rows.

A changelog is a DataFrame with the columns

    op string, lsn bigint, seq int, xact_id int, delete_if_exists boolean, r struct<...>

op: 'A' append, 'D' delete, 'C' commit, 'X' abort.  A row with an xact_id belongs to a
streamed transaction; its commit or abort carries the same xact_id.  (lsn, seq) orders
events, and seq comes from the producer.

Reading at LSN x sees every record committed at an LSN <= x; a commit at LSN x commits
the records of the main transaction with a smaller LSN.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Identity:
    """How rows are told apart: by key columns, by all columns (a multiset), or not at all (append only)."""

    kind: str
    keys: tuple[str, ...] = ()

    @classmethod
    def key(cls, *columns: str) -> Identity:
        return cls("key", tuple(sorted(columns)))

    @classmethod
    def full_row(cls) -> Identity:
        return cls("full_row")

    @classmethod
    def append_only(cls) -> Identity:
        return cls("append_only")

    def columns(self, schema: list[str]) -> list[str]:
        if self.kind == "key" and not set(self.keys) <= set(schema):
            raise ValueError(f"key columns {self.keys} aren't all in {schema}")
        return list(self.keys) if self.kind == "key" else list(schema)


class StrictDeleteError(ValueError):
    """A strict delete had no row to remove."""


def appends(rows: DataFrame, lsn: Column | int, seq: Column | int = 0, xact_id: Column | None = None) -> DataFrame:
    return _events(rows, "A", lsn, seq, xact_id, False)


def deletes(rows: DataFrame, lsn: Column | int, seq: Column | int = 0, xact_id: Column | None = None, if_exists: bool = False) -> DataFrame:
    return _events(rows, "D", lsn, seq, xact_id, if_exists)


def upserts(rows: DataFrame, lsn: Column | int, seq: Column | int = 0) -> DataFrame:
    """A delete_if_exists, then an append, of one LSN."""
    seq = F.lit(seq) if isinstance(seq, int) else seq
    pair = F.array(F.struct(F.lit("D").alias("op"), (seq * 2).cast("int").alias("seq"), F.lit(True).alias("delete_if_exists")), F.struct(F.lit("A").alias("op"), (seq * 2 + 1).cast("int").alias("seq"), F.lit(False).alias("delete_if_exists")))
    lsn = F.lit(lsn) if isinstance(lsn, int) else lsn
    kept = rows.select(lsn.cast("bigint").alias("lsn"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"), F.explode(pair).alias("e"))
    return kept.select("e.op", "lsn", "e.seq", F.lit(None).cast("int").alias("xact_id"), "e.delete_if_exists", "r")


def updates(changes: DataFrame, old: str, new: str, lsn: Column, seq: Column | int = 0, xact_id: Column | None = None) -> DataFrame:
    """Change-data updates: a strict delete of the struct column `old`, then an append of `new`."""
    seq = F.lit(seq) if isinstance(seq, int) else seq
    one = lambda op, r, n: F.struct(F.lit(op).alias("op"), (seq * 2 + n).cast("int").alias("seq"), F.col(r).alias("r"))
    kept = changes.select(lsn.cast("bigint").alias("lsn"), (F.lit(None) if xact_id is None else xact_id).cast("int").alias("xact_id"), F.explode(F.array(one("D", old, 0), one("A", new, 1))).alias("e"))
    return kept.select("e.op", "lsn", "e.seq", "xact_id", F.lit(False).alias("delete_if_exists"), "e.r")


def _events(rows: DataFrame, op: str, lsn: Column | int, seq: Column | int, xact_id: Column | None, if_exists: bool) -> DataFrame:
    lsn = F.lit(lsn) if isinstance(lsn, int) else lsn
    seq = F.lit(seq) if isinstance(seq, int) else seq
    xact = F.lit(None) if xact_id is None else xact_id
    return rows.select(F.lit(op).alias("op"), lsn.cast("bigint").alias("lsn"), seq.cast("int").alias("seq"), xact.cast("int").alias("xact_id"), F.lit(if_exists).alias("delete_if_exists"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"))


def marks(like: DataFrame, rows: list[tuple[str, int, int | None]]) -> DataFrame:
    """Commit and abort events (op, lsn, xact_id) to union with the changelog `like`."""
    base = like.sparkSession.createDataFrame(rows, "op string, lsn bigint, xact_id int")
    return base.select("op", "lsn", F.lit(0).cast("int").alias("seq"), "xact_id", F.lit(False).alias("delete_if_exists"), F.lit(None).cast(like.schema["r"].dataType).alias("r"))


def commit_lsn(events: DataFrame) -> DataFrame:
    """One row: the highest commit LSN (null: nothing is committed)."""
    return events.where(F.col("op") == "C").agg(F.max("lsn").alias("commit_lsn"))


def resolve(events: DataFrame, at_lsn: int | None = None) -> DataFrame:
    """The visible appends and deletes with their effective LSN.

    Records of the main transaction are visible once a later commit exists.  Records of
    a streamed transaction take its commit's LSN; aborted and open transactions have
    none.  Commits later than at_lsn don't count.  A transaction's id is its own: the
    source doesn't use one again while the changelog holds events of it.
    """
    ends = events.where(F.col("op") == "C")
    if at_lsn is not None:
        ends = ends.where(F.col("lsn") <= at_lsn)
    records = events.where(F.col("op").isin("A", "D"))
    baseline = ends.where(F.col("xact_id").isNull()).agg(F.max("lsn").alias("commit")).select("commit").scalar()
    main = records.where(F.col("xact_id").isNull()).where(F.col("lsn") < baseline)
    aborted = events.where((F.col("op") == "X") & F.col("xact_id").isNotNull()).select("xact_id").distinct()
    committed = ends.where(F.col("xact_id").isNotNull()).groupBy("xact_id").agg(F.max("lsn").alias("__commit")).join(aborted, "xact_id", "left_anti")
    streamed = records.where(F.col("xact_id").isNotNull()).join(committed, "xact_id").withColumn("lsn", F.col("__commit")).select(records.columns)
    return main.select(records.columns).unionByName(streamed)


def discard_persisted(events: DataFrame, persisted_lsn: int) -> DataFrame:
    """Recovery: what the table already has is left out; streamed records are decided by their commit's LSN."""
    ends = events.where((F.col("op") == "C") & F.col("xact_id").isNotNull()).groupBy("xact_id").agg(F.max("lsn").alias("__end"))
    joined = events.join(ends, "xact_id", "left")
    decided = F.when(F.col("xact_id").isNull(), F.col("lsn")).otherwise(F.col("__end"))
    return joined.where(decided.isNull() | (decided > persisted_lsn)).select(events.columns)


def initial_copy(snapshot: DataFrame, boundary_lsn: int, changes: DataFrame) -> DataFrame:
    """A copied table as appends at the boundary, and the changes after it; earlier ones are in the copy already."""
    copied = appends(snapshot, boundary_lsn)
    return copied.unionByName(changes.where(F.col("lsn") > boundary_lsn))


def reduce(events: DataFrame, identity: Identity, unique_keys: bool = False, strict: bool = False) -> DataFrame:
    """The live rows after resolved events ('A' and 'D' with effective LSNs).

    unique_keys: the source promises at most one live row per key; then the last event of
    a key decides, by a partial aggregate that no hot key slows down.  Otherwise each
    delete removes the latest live row of its key: an ordered matching by window
    functions.  strict: a delete without delete_if_exists that finds no row raises.
    """
    columns = events.schema["r"].dataType.names
    if identity.kind == "append_only":
        return events.where(F.col("op") == "A").select("r.*")
    keys = [F.col(f"r.`{c}`") for c in identity.columns(columns)]
    if identity.kind == "key" and unique_keys:
        named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
        last = events.groupBy(*named).agg(F.max_by(F.struct("op", "r"), F.struct("lsn", "seq")).alias("last"))
        return last.where("last.op = 'A'").select("last.r.*")
    return matched(events, keys, strict).where("__live").select("r.*")


def net_multiset(events: DataFrame) -> DataFrame:
    """Full-row tables whose deletes are all strict: a row's copies are its appends less its deletes.

    Signed counts are added up before the shuffle, so one row with very many copies is one
    row per map task; a negative count raises.
    """
    signed = events.groupBy("r").agg(F.sum(F.when(F.col("op") == "A", 1).otherwise(-1)).alias("n"))
    n = F.when(F.col("n") < 0, F.raise_error(F.lit("a delete found no row"))).otherwise(F.col("n"))
    return signed.select("r", n.cast("int").alias("n")).where("n > 0").select("r", F.explode(F.sequence(F.lit(1), F.col("n")))).select("r.*")


def matched(events: DataFrame, keys: list[Column], strict: bool = False) -> DataFrame:
    """events with __live: whether an append is still there at the end.

    In a key's order, S counts appends less deletes.  L = S - min(0, lowest S so far) is the
    number of live rows, because a delete that finds none is a no-op.  The append that
    brought the number to L survives when it never falls below L again: deletes take the
    latest row first.  Nulls in keys are equal to nulls, as partitioning has them.

    The lowest L later on is taken along the reversed order: a frame that only grows takes
    one step a row, where Spark computes one up to the partition's end anew for each row.
    """
    order = (F.col("lsn"), F.col("seq"), F.when(F.col("op") == "D", 0).otherwise(1))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*keys).orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumns({"__s": F.sum(F.when(F.col("op") == "A", 1).otherwise(-1)).over(upto), "__n": F.row_number().over(upto)})
    if strict:
        # optional deletes are no-ops where nothing is live; a strict one must never go below the floor
        floor = F.coalesce(F.min("__s").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bad = (F.col("op") == "D") & ~F.coalesce("delete_if_exists", F.lit(False)) & (F.col("__s") < F.least(F.lit(0), floor))
        out = out.withColumn("__s", F.when(bad, F.raise_error(F.lit("a strict delete found no row"))).otherwise(F.col("__s")))
    out = out.withColumn("__l", F.col("__s") - F.least(F.lit(0), F.min("__s").over(upto)))
    out = out.withColumn("__low", F.min("__l").over(later))
    live = (F.col("op") == "A") & (F.col("__low").isNull() | (F.col("__low") >= F.col("__l")))
    return out.withColumn("__live", live).drop("__s", "__n", "__l", "__low")
