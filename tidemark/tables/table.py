"""A table: persisted Parquet files less row-level deletes, and committed events on top.

    <path>/metadata/   manifests (see manifest.py)
    <path>/data/       Parquet files, each set in a folder of its own
    <path>/deletes/    Parquet (file, row_index): deletes of persisted rows
    <path>/wal/        Parquet changelogs that aren't flushed yet
    <path>/index/      optional key -> position sidecars
    <path>/pins/       versions that a scan still reads

Files are only ever added; a manifest says which ones count.  A read resolves the
manifest on the driver and is then one DataFrame plan.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
from dataclasses import asdict, replace
from functools import reduce as fold

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument, Permanent, Temporary
from tidemark.operators import changelog as cl
from tidemark.operators import deletes as dv
from tidemark.operators import policy
from tidemark.operators.changelog import Identity
from tidemark.tables.files import Files
from tidemark.tables.manifest import DataFile, Manifest, ManifestLog


#: Deletes that a scan broadcasts at most, and blocks of files that it is split into for it; beyond, rows are shuffled by position.
BROADCAST_DELETES, BLOCKS = 1_000_000, 64
#: Characters of a text's bounds that the manifest keeps.
BOUND_CHARS = 64


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._cached: tuple[Manifest, DataFrame] | None = None
        self.files = Files(spark)
        self.log = ManifestLog(self.files, self.path)

    # --- creation and state

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, identity: Identity, config: policy.TableConfig = policy.TableConfig(), append_only: bool | None = None) -> Table:
        if append_only is not None and append_only != (identity.kind == "append_only"):
            raise InvalidArgument("append_only goes with no row identity, and only with it")
        identity.columns(schema.names)
        table = cls(spark, path)
        table.log.create(Manifest(0, schema.jsonValue(), identity.kind, identity.keys, asdict(config)))
        return table

    @property
    def manifest(self) -> Manifest:
        return self.log.latest()

    @property
    def schema(self) -> T.StructType:
        return self.manifest.struct

    @staticmethod
    def _identity(m: Manifest) -> Identity:
        return Identity(m.identity, tuple(m.keys))

    def _config(self, m: Manifest) -> policy.TableConfig:
        return policy.TableConfig(**m.config)

    def status(self) -> dict:
        """commit and flush LSN, cardinality with deleted rows counted, and live rows of the persisted part."""
        m = self.manifest
        total, gone = sum(f.rows for f in m.files), sum(f.deleted for f in m.files)
        return {"commit_lsn": m.commit_lsn, "flush_lsn": m.flush_lsn, "cardinality": total + sum(w["rows"] for w in m.wal), "persisted_live_rows": total - gone, "files": len(m.files), "version": m.version, "location": self.path}

    # --- events

    def _event_schema(self, m: Manifest) -> T.StructType:
        fields = [("op", T.StringType()), ("lsn", T.LongType()), ("seq", T.IntegerType()), ("xact_id", T.IntegerType()), ("delete_if_exists", T.BooleanType()), ("r", nullable(m.struct))]
        return T.StructType([T.StructField(n, t) for n, t in fields])

    def write_events(self, events: DataFrame, source: str | None = None, batch_id: int | None = None) -> Manifest:
        """Append a changelog to the write-ahead log. A micro-batch of a source counts once, however often it is repeated."""
        m = self.manifest
        if source is not None and batch_id is not None and m.batches.get(source, -1) >= batch_id:
            return m
        folder = f"{self.path}/wal/{uuid.uuid4().hex}"
        wanted = self._event_schema(m)
        events = events.select("op", F.col("lsn").cast("bigint"), F.col("seq").cast("int"), F.col("xact_id").cast("int"), "delete_if_exists", F.col("r").cast(nullable(m.struct)).alias("r"))
        events.write.parquet(folder)
        kept = self.spark.read.schema(wanted).parquet(folder)
        stats = kept.agg(F.max("lsn"), F.max(F.when(F.col("op") == "C", F.col("lsn"))), F.count(F.when(F.col("op") == "A", 1)), F.count("*"), F.count(F.when(F.col("op") == "D", 1))).first()
        entry = {"path": folder, "max_lsn": stats[0], "rows": stats[2], "events": stats[3], "deletes": stats[4], "version": m.version + 1}

        def change(old: Manifest) -> Manifest:
            batches = dict(old.batches)
            if source is not None and batch_id is not None:
                if batches.get(source, -1) >= batch_id:
                    return old
                batches[source] = batch_id
            return replace(old, wal=(*old.wal, entry), commit_lsn=max(old.commit_lsn, stats[1] or 0), batches=batches, replication_lsn=max(old.replication_lsn, stats[0] or 0))

        return self.log.commit(change)

    def append(self, rows: DataFrame, lsn: int) -> Manifest:
        return self.write_events(cl.appends(rows, lsn))

    def delete(self, rows: DataFrame, lsn: int, if_exists: bool = False) -> Manifest:
        return self.write_events(cl.deletes(self._padded(rows), lsn, if_exists=if_exists))

    def upsert(self, rows: DataFrame, lsn: int) -> Manifest:
        return self.write_events(cl.upserts(rows, lsn))

    def _padded(self, keys: DataFrame) -> DataFrame:
        """Key rows as table rows: other columns are null."""
        return keys.select(*[(F.col(f"`{f.name}`") if f.name in keys.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    def commit(self, lsn: int, xact_id: int | None = None) -> Manifest:
        m = self.manifest
        if lsn < m.commit_lsn:
            raise InvalidArgument(f"commit LSN {lsn} is before {m.commit_lsn}")
        return self.write_events(self._marks([("C", lsn, xact_id)]))

    def abort(self, xact_id: int, lsn: int) -> Manifest:
        return self.write_events(self._marks([("X", lsn, xact_id)]))

    def _marks(self, rows: list[tuple[str, int, int | None]]) -> DataFrame:
        return cl.marks(self.spark.createDataFrame([], self._event_schema(self.manifest)), rows)

    def keepalive(self, lsn: int) -> Manifest:
        """The source is at lsn, and has nothing new for this table."""
        return self.log.commit(lambda old: replace(old, replication_lsn=max(old.replication_lsn, lsn)))

    def _wait(self, done, timeout: float, what: str) -> Manifest:
        deadline = time.monotonic() + timeout
        while not done(m := self.manifest):
            if time.monotonic() >= deadline:
                raise Temporary(what)
            time.sleep(0.05)
        return m

    def wait_for_wal(self, lsn: int, timeout: float = 0.0) -> Manifest:
        """Until the write-ahead log holds what the source sent up to lsn; Temporary after timeout."""
        return self._wait(lambda m: m.replication_lsn >= lsn, timeout, f"the log isn't at LSN {lsn}")

    def begin_copy(self) -> Manifest:
        """An initial copy starts: events that come meanwhile are logged, and neither read nor flushed."""
        return self.log.commit(lambda old: replace(old, copying=True))

    def finish_copy(self, paths: list[str], boundary_lsn: int) -> Manifest:
        """The copied files hold everything up to the boundary; waiting events after it count from now on."""
        self.load_files(paths, boundary_lsn)
        return self.log.commit(lambda old: replace(old, copying=False, copy_lsn=max(old.copy_lsn, boundary_lsn)))

    def _resolved(self, m: Manifest, at_lsn: int | None = None) -> DataFrame:
        """Visible events; what an initial copy has is left out, a streamed transaction being decided by its commit."""
        events = cl.resolve(self._events(m), at_lsn)
        return events.where(F.col("lsn") > m.copy_lsn) if m.copy_lsn else events

    def _events(self, m: Manifest) -> DataFrame:
        paths = [w["path"] for w in m.wal]
        schema = self._event_schema(m)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- reads

    def persisted(self, m: Manifest | None = None, positions: bool = False, prune: dict[str, tuple] | None = None) -> DataFrame:
        """The flushed rows. Files without deletes are read without a join; prune: {column: (low, high)} skips files by their stats."""
        m = m or self.manifest
        chosen = [f for f in m.files if not prune or all(_overlaps(f, c, lo, hi) for c, (lo, hi) in prune.items())]
        parts = []
        for group, masked in (([f for f in chosen if not f.deleted], False), ([f for f in chosen if f.deleted], True)):
            if group:
                for block in _blocks(group) if masked else [group]:
                    scan = self.spark.read.schema(m.struct).parquet(*[f.path for f in block])
                    if masked or positions:
                        scan = dv.with_position(scan)
                    if masked:
                        gone = self.deleted(m)
                        if len(block) < len(group):
                            gone = gone.where(F.col("file").isin([_plain(f.path) for f in block]))
                        small = sum(f.deleted for f in block) <= BROADCAST_DELETES
                        scan = dv.mask(scan, F.broadcast(gone) if small else gone)
                    parts.append(scan.select(*m.struct.names, *(["__file", "__row"] if positions else [])))
        if parts:
            return fold(DataFrame.unionByName, parts)
        extra = [T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType())] if positions else []
        return self.spark.createDataFrame([], T.StructType(m.struct.fields + extra))

    def deleted(self, m: Manifest | None = None) -> DataFrame:
        m = m or self.manifest
        return self.spark.read.schema(dv.SCHEMA).parquet(*m.deletes) if m.deletes else dv.empty(self.spark)

    def read(self, min_lsn: int | None = None, timeout: float = 0.0, at_lsn: int | None = None, prune: dict[str, tuple] | None = None) -> DataFrame:
        """Persisted and buffered rows together.

        min_lsn: how fresh the answer must be; when nothing that fresh is committed within
        timeout, Temporary is raised.  at_lsn: leave out commits after it that aren't
        flushed.  prune: {column: (low, high)}, either end None: only rows in these ranges,
        and files whose bounds are outside them aren't read.
        """
        m = self._wait(lambda m: policy.may_read(min_lsn, m.commit_lsn, m.commit_lsn, m.replication_lsn), timeout, f"LSN {min_lsn} isn't committed")
        wanted = fold(Column.__and__, [F.col(f"`{c}`") >= lo for c, (lo, _) in (prune or {}).items() if lo is not None] + [F.col(f"`{c}`") <= hi for c, (_, hi) in (prune or {}).items() if hi is not None], F.lit(True))
        if not m.wal or m.copying:
            return self.persisted(m, prune=prune).where(wanted)
        removed, fresh = self._apply(m, self._resolved(m, at_lsn))
        base = self.persisted(m, prune=prune) if removed is None else dv.mask(self.persisted(m, positions=True, prune=prune), removed).select(*m.struct.names)
        return base.unionByName(fresh).where(wanted)

    def read_cached(self, min_lsn: int | None = None, timeout: float = 0.0) -> DataFrame:
        """The last plan again where its state is fresh enough for the request, else a new one."""
        m = self.manifest
        if self._cached is None or not policy.may_serve_cached(min_lsn, self._cached[0].commit_lsn, self._cached[0].commit_lsn, m.commit_lsn):
            df = self.read(min_lsn, timeout)
            self._cached = (m, df)
        return self._cached[1]

    def begin_scan(self) -> tuple[Manifest, str]:
        """(the state to read, a pin): until the pin is given back, vacuum keeps that state's files."""
        pin, m = f"{self.path}/pins/{uuid.uuid4().hex}.json", self.manifest
        self.files.replace(pin, json.dumps({"version": m.version}))
        return m, pin

    def end_scan(self, pin: str) -> None:
        self.files.delete(pin)

    def _pinned(self) -> set[str]:
        """Paths that states with a pin need."""
        out: set[str] = set()
        for path, _ in self.files.list(f"{self.path}/pins"):
            if path.endswith(".json"):
                out |= _paths(self.log.at(json.loads(self.files.read(path))["version"]))
        return out

    def _apply(self, m: Manifest, events: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """(positions of persisted rows that the events remove, rows that they leave). Only persisted rows with a key among the deletes take part; without any delete all appends stay."""
        identity = self._identity(m)
        if identity.kind == "append_only" or all(w.get("deletes") == 0 for w in m.wal):
            return None, cl.reduce(events, Identity.append_only())
        names = m.struct.names
        keys = identity.columns(names)
        touched = events.where(F.col("op") == "D").select(*[F.col(f"r.`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
        base = self.persisted(m, positions=True)
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        met = base.join(touched, fold(Column.__and__, same), "left_semi")
        order = F.lit(-1).cast("bigint")
        old = met.select(F.lit("A").alias("op"), order.alias("lsn"), F.lit(0).alias("seq"), F.lit(None).cast("int").alias("xact_id"), F.lit(False).alias("delete_if_exists"), F.struct(*names).alias("r"), "__file", "__row")
        new = events.select("op", "lsn", "seq", "xact_id", "delete_if_exists", "r", F.lit(None).cast("string").alias("__file"), F.lit(None).cast("bigint").alias("__row"))
        both = cl.matched(old.unionByName(new), [F.col(f"r.`{k}`") for k in keys])
        removed = both.where(F.col("__file").isNotNull() & ~F.col("__live")).select(F.col("__file").alias("file"), F.col("__row").alias("row_index"))
        fresh = both.where(F.col("__file").isNull() & F.col("__live")).select("r.*")
        return removed, fresh

    # --- flush

    def flush(self, lsn: int | None = None) -> Manifest:
        """Persist all committed events: new rows as data files, deletes as positions, in one manifest commit. Events of open transactions stay."""
        m = self.manifest
        if lsn is not None and lsn > m.commit_lsn:
            raise Temporary(f"LSN {lsn} isn't committed")
        if m.copying:
            raise Temporary("an initial copy is under way")
        if not m.wal:
            return m
        events = self._events(m)
        removed, fresh = self._apply(m, self._resolved(m))
        added = self._write_rows(fresh, m, m.commit_lsn)
        delete_paths, per_file = self._write_deletes(removed)
        open_ = self._open(events)
        left = self._keep_open(m, open_)
        taken = {w["path"] for w in m.wal}
        gone = tuple(taken)

        def change(old: Manifest) -> Manifest:
            if [f.path for f in old.files] != [f.path for f in m.files] or old.deletes != m.deletes:
                raise Temporary("the table's files changed during the flush")
            files = tuple(replace(f, deleted=f.deleted + per_file.get(_plain(f.path), 0)) for f in old.files)
            wal = (*left, *(w for w in old.wal if w["path"] not in taken))
            return replace(old, files=(*files, *added), deletes=(*old.deletes, *delete_paths), wal=wal, flush_lsn=max(old.flush_lsn, m.commit_lsn), removed=(*old.removed, *gone))

        return self.log.commit(change)

    def tick(self) -> Manifest:
        """What a timer does: flush when there is a reason for a snapshot and enough to persist, then maintain, as the table's settings say."""
        m = self.manifest
        config = self._config(m)
        rows, deletes = sum(w["rows"] for w in m.wal), sum(w.get("deletes", 0) for w in m.wal)
        if m.copying or not policy.should_snapshot(m.commit_lsn > m.flush_lsn, False, deletes, False, config):
            return m
        if not policy.should_persist(int(policy.should_flush(rows, config)), deletes, 0, m.commit_lsn, None, config):
            return m
        m = self.flush()
        if not config.skip_data_compaction:
            m = self.optimize("data", forced=False)
        if not config.skip_index_merge:
            m = self.merge_indexes(forced=False)
        return m

    def _open(self, events: DataFrame) -> DataFrame:
        """Events that a later commit may still need: of transactions without an end, and after the last main commit."""
        ended = events.where(F.col("op").isin("C", "X") & F.col("xact_id").isNotNull()).select("xact_id").distinct()
        last = events.where((F.col("op") == "C") & F.col("xact_id").isNull()).agg(F.coalesce(F.max("lsn"), F.lit(-1).cast("bigint")).alias("l")).select("l").scalar()
        records = events.where(F.col("op").isin("A", "D"))
        main = records.where(F.col("xact_id").isNull() & (F.col("lsn") >= last))
        return main.unionByName(records.where(F.col("xact_id").isNotNull()).join(ended, "xact_id", "left_anti").select(events.columns))

    def _keep_open(self, m: Manifest, open_: DataFrame) -> tuple[dict, ...]:
        folder = f"{self.path}/wal/{uuid.uuid4().hex}"
        open_.write.parquet(folder)
        stats = self.spark.read.schema(self._event_schema(m)).parquet(folder).agg(F.count("*"), F.max("lsn"), F.count(F.when(F.col("op") == "A", 1))).first()
        if not stats[0]:
            self.files.delete(folder)
            return ()
        return ({"path": folder, "max_lsn": stats[1], "rows": stats[2], "events": stats[0], "version": m.version + 1},)

    def _write_rows(self, rows: DataFrame, m: Manifest, lsn: int, compression: str = "snappy", partitions: int | None = None) -> list[DataFile]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        if partitions:
            rows = rows.repartition(partitions)
        rows.select(*m.struct.names).write.option("compression", compression).option("maxRecordsPerFile", max(1, self._config(m).mem_slice_rows * 8)).parquet(folder)
        return self.describe(folder, lsn, m.struct)

    def describe(self, path: str, lsn: int, schema: T.StructType) -> list[DataFile]:
        """Manifest entries of a folder's Parquet files, from their footers; empty files are left out."""
        found = self.files.parquet(path)
        out = []
        for (p, size), raw in zip(found, self.files.footers([p for p, _ in found]), strict=True):
            rows, stats = footer_stats(raw)
            if rows:
                out.append(DataFile(p, rows, size, lsn, 0, {c: stats[c] for c in bounded_columns(schema) if c in stats}))
        return sorted(out, key=lambda f: f.path)

    def _write_deletes(self, removed: DataFrame | None) -> tuple[list[str], dict[str, int]]:
        if removed is None:
            return [], {}
        folder = f"{self.path}/deletes/{uuid.uuid4().hex}"
        removed.sortWithinPartitions("file", "row_index").write.parquet(folder)
        counted = {r["file"]: r["deleted"] for r in dv.counts(self.spark.read.schema(dv.SCHEMA).parquet(folder)).collect()}  # a row per data file, as the manifest has
        if not counted:
            self.files.delete(folder)
            return [], {}
        return [folder], counted

    def create_snapshot(self, lsn: int, timeout: float = 0.0) -> Manifest:
        """Persist everything up to lsn; Temporary when it isn't committed within timeout."""
        m = self._wait(lambda m: m.flush_lsn >= lsn or m.commit_lsn >= lsn, timeout, f"LSN {lsn} isn't committed")
        if m.flush_lsn >= lsn:
            return m
        return self.flush(lsn)

    def load_files(self, paths: list[str], lsn: int) -> Manifest:
        """Adopt Parquet files as they are, at one LSN; nothing is rewritten."""
        m = self.manifest
        added = [f for p in paths for f in self.describe(p, lsn, m.struct)]
        known = {f.path for f in m.files}
        if any(f.path in known for f in added):
            raise InvalidArgument("a file is in the table already")
        return self.log.commit(lambda old: replace(old, files=(*old.files, *added), commit_lsn=max(old.commit_lsn, lsn), flush_lsn=max(old.flush_lsn, lsn), replication_lsn=max(old.replication_lsn, lsn)))

    # --- maintenance

    def file_rows(self, m: Manifest | None = None) -> DataFrame:
        m = m or self.manifest
        rows = [(f.path, f.rows, f.bytes, f.deleted, f.lsn) for f in m.files]
        return self.spark.createDataFrame(rows, "file string, num_rows bigint, bytes bigint, deleted bigint, lsn bigint")

    def optimize(self, mode: str = "data", forced: bool = True, config: policy.CompactionConfig = policy.CompactionConfig()) -> Manifest:
        """mode data: compact chosen files; full: all; index: merge index sidecars. With nothing to do the state is returned."""
        if mode not in ("data", "index", "full"):
            raise InvalidArgument(f"unknown mode {mode}")
        if mode == "index":
            return self.merge_indexes()
        m = self.manifest
        config = config.full() if mode == "full" else config.forced() if forced else config
        chosen = {r["file"] for r in policy.select_for_compaction(self.file_rows(m), config, mode == "full").select("file").collect()}
        return self.compact(chosen) if chosen else m

    def compact(self, paths: set[str]) -> Manifest:
        """Rewrite files without their deleted rows. A delete that another writer added meanwhile makes it start over."""
        for _ in range(ManifestLog.TRIES):
            m = self.manifest
            old_files = [f for f in m.files if f.path in paths]
            rows = self.persisted(replace(m, files=tuple(old_files)))
            size = sum(f.bytes * (f.rows - f.deleted) / max(1, f.rows) for f in old_files)
            added = self._write_rows(rows, m, max(f.lsn for f in old_files), "zstd", max(1, round(size / policy.CompactionConfig().final_bytes)))
            rest = self.deleted(m).join(self.spark.createDataFrame([(_plain(f.path),) for f in old_files], "file string"), "file", "left_anti")
            kept, _ = self._write_deletes(rest) if m.deletes else ([], {})

            def change(now: Manifest, m: Manifest = m, added: list = added, kept: list = kept) -> Manifest:
                if now.deletes != m.deletes or not {f.path for f in old_files} <= {f.path for f in now.files}:
                    raise Temporary("deletes changed")
                files = (*(f for f in now.files if f.path not in paths), *added)
                return replace(now, files=files, deletes=tuple(kept), indexes=(), removed=(*now.removed, *(f.path for f in old_files), *m.deletes))

            try:
                return self.log.commit(change)
            except Temporary:
                continue
        raise Temporary("the table keeps changing")

    def build_index(self) -> Manifest:
        """A key -> position sidecar over all files."""
        m = self.manifest
        keys = self._identity(m).columns(m.struct.names)
        folder = f"{self.path}/index/{uuid.uuid4().hex}"
        places = self.persisted(m, positions=True)
        places.select(F.xxhash64(*[f"`{k}`" for k in keys]).alias("hash"), *[f"`{k}`" for k in keys], F.col("__file").alias("file"), F.col("__row").alias("row_index")).repartition("hash").sortWithinPartitions("hash").write.parquet(folder)
        entry = {"path": folder, "bytes": sum(n for _, n in self.files.parquet(folder)), "files": [f.path for f in m.files]}
        return self.log.commit(lambda old: replace(old, indexes=(*old.indexes, entry)))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Positions of the rows with these keys, from the sidecars."""
        m = self.manifest
        names = self._identity(m).columns(m.struct.names)
        if not m.indexes:
            raise Permanent("the table has no index")
        index = self.spark.read.parquet(*[i["path"] for i in m.indexes])
        wanted = keys.select(*names).distinct().withColumn("hash", F.xxhash64(*[f"`{k}`" for k in names])).select("hash", *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(names)])
        same = [index["hash"] == wanted["hash"]] + [index[k].eqNullSafe(wanted[f"__k{i}"]) for i, k in enumerate(names)]
        found = index.join(wanted, fold(Column.__and__, same), "left_semi").distinct()
        return found.join(self.deleted(m), ["file", "row_index"], "left_anti")

    def index_sizes(self, m: Manifest | None = None) -> DataFrame:
        """file and bytes of each sidecar."""
        m = m or self.manifest
        return self.spark.createDataFrame([(i["path"], i["bytes"]) for i in m.indexes], "file string, bytes bigint")

    def merge_indexes(self, forced: bool = True, config: policy.IndexMergeConfig = policy.IndexMergeConfig()) -> Manifest:
        """The chosen sidecars as one: small ones, when there are enough of them (forced: two)."""
        m = self.manifest
        if len(m.indexes) < 2:
            return m
        config = config.forced() if forced else config
        names = {r["file"] for r in policy.select_indexes_to_merge(self.index_sizes(m), config).select("file").collect()}
        chosen = [i for i in m.indexes if i["path"] in names]
        if len(chosen) < 2:
            return m
        folder = f"{self.path}/index/{uuid.uuid4().hex}"
        self.spark.read.parquet(*[i["path"] for i in chosen]).distinct().repartition("hash").sortWithinPartitions("hash").write.parquet(folder)
        entry = {"path": folder, "bytes": sum(n for _, n in self.files.parquet(folder)), "files": sorted({f for i in chosen for f in i["files"]})}

        def change(old: Manifest) -> Manifest:
            if not all(i in old.indexes for i in chosen):
                raise Temporary("indexes changed")
            return replace(old, indexes=(*(i for i in old.indexes if i not in chosen), entry), removed=(*old.removed, *(i["path"] for i in chosen)))

        return self.log.commit(change)

    def alter(self, drop: list[str] | None = None, add: list[T.StructField] | None = None) -> Manifest:
        """Drop columns, then append new ones, which read as null in older files.

        Committed events are flushed first, by the old schema; those of open transactions
        stay buffered, and are read by the new one once they commit.
        """
        drop, add = drop or [], add or []
        if self.manifest.wal:
            self.flush()

        def change(old: Manifest) -> Manifest:
            if set(drop) & set(old.keys):
                raise InvalidArgument("a key column can't be dropped")
            fields = [f for f in old.struct.fields if f.name not in drop]
            if {f.name for f in fields} & {f.name for f in add} or not set(drop) <= set(old.struct.names):
                raise InvalidArgument("unknown or repeated column")
            if any(not f.nullable for f in add) and old.files:
                raise InvalidArgument("a new column of a table with rows must be nullable")
            return replace(old, schema=T.StructType([*fields, *add]).jsonValue())

        return self.log.commit(change)

    def vacuum(self) -> int:
        """Delete folders and files that no longer count, but for those that a pinned state needs.

        Only what lies in the table's own folder is deleted: files that load_files adopted
        elsewhere belong to whoever put them there, and are merely forgotten.
        """
        m = self.manifest
        live = _paths(m) | self._pinned()
        gone = [p for p in m.removed if p not in live]
        own = f"{_plain(self.path)}/"
        for p in gone:
            if _plain(p).startswith(own) and ".." not in p.split("/"):
                self.files.delete(p)
        self.log.commit(lambda old: replace(old, removed=tuple(p for p in old.removed if p not in gone)))
        return len(gone)


def _paths(m: Manifest) -> set[str]:
    return {f.path for f in m.files} | set(m.deletes) | {w["path"] for w in m.wal} | {i["path"] for i in m.indexes}


def _blocks(files: list[DataFile]) -> list[list[DataFile]]:
    """Files with deletes in blocks whose deletes can be broadcast, unless that takes too many blocks."""
    blocks: list[list[DataFile]] = [[]]
    held = 0
    for f in files:
        if blocks[-1] and held + f.deleted > BROADCAST_DELETES:
            blocks.append([])
            held = 0
        blocks[-1].append(f)
        held += f.deleted
    return blocks if len(blocks) <= BLOCKS else [files]


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed throughout: a delete by key has no other values, a commit has none."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind.fields])
    return T.ArrayType(nullable(kind.elementType), True) if isinstance(kind, T.ArrayType) else kind


def bounded_columns(schema: T.StructType) -> list[str]:
    """Columns with an order."""
    return [f.name for f in schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType, T.VariantType))]


def file_stats(scan: DataFrame, schema: T.StructType) -> DataFrame:
    """Per file: num_rows, and each ordered column's minimum, maximum and number of nulls."""
    path = dv.plain_path(F.col("_metadata.file_path"))
    aggregates = [a for c in bounded_columns(schema) for a in (F.min(f"`{c}`").alias(f"{c}__min"), F.max(f"`{c}`").alias(f"{c}__max"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"{c}__nulls"))]
    return scan.select("*", path.alias("__file")).groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("num_rows"), *aggregates)


def footer_stats(footer: bytes) -> tuple[int, dict[str, list]]:
    """(rows, {top-level column: [min, max, nulls]}) of a footer's Thrift bytes. Long texts' bounds are cut to a shorter bound."""
    meta = pq.read_metadata(pa.BufferReader(b"PAR1" + footer + struct.pack("<I", len(footer)) + b"PAR1"))
    found: dict[str, list] = {}
    lacking: set[str] = set()
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for k in range(group.num_columns):
            column = group.column(k)
            name, s = column.path_in_schema, column.statistics
            if "." in name or s is None or not s.has_null_count or not (s.has_min_max or s.null_count == group.num_rows):
                lacking.add(name)
                continue
            low, high = (_bound(s.min, False), _bound(s.max, True)) if s.has_min_max else (None, None)
            if name not in found:
                found[name] = [low, high, s.null_count]
                continue
            old = found[name]
            found[name] = [min((x for x in (old[0], low) if x is not None), default=None), max((x for x in (old[1], high) if x is not None), default=None), old[2] + s.null_count]
    return meta.num_rows, {c: [_plain_value(v[0]), _plain_value(v[1]), v[2]] for c, v in found.items() if c not in lacking}


def _bound(value, upper: bool):
    if isinstance(value, bytes):
        return None
    if isinstance(value, str) and len(value) > BOUND_CHARS:
        return value[:BOUND_CHARS] + ("\U0010ffff" if upper else "")
    return value


def _plain(path: str) -> str:
    scheme, colon, rest = path.partition(":")
    return "/" + rest.lstrip("/") if colon and scheme.isalnum() else "/" + path.lstrip("/")


def _plain_value(value):
    return value if value is None or isinstance(value, (int, float, str, bool)) else str(value)


def _overlaps(f: DataFile, column: str, low, high) -> bool:
    lo, hi, _ = f.stats.get(column, (None, None, None))
    if lo is None or hi is None or type(lo) is not type(low if low is not None else high):
        return True
    return (high is None or lo <= high) and (low is None or hi >= low)
