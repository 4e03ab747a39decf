"""Secret scans through an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text.  A
ledger keeps, for each (digest, rule version), that it was scanned, and the spans
found.  A scan takes the versions whose (digest, rule version) the ledger lacks,
scans each distinct blob once, appends to the ledger, and joins the findings back
to all paths and versions that hold the blob.

Ledger layout, under one folder: `scanned/` (digest, rules) and `findings/`
(digest, rules, kind, start, stop).  Both are append-only Parquet; a run that dies
between the two writes is repeated safely, because findings are written first and
read as a set.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.storage import BROADCAST_ROWS, Scratch, cut, free_name, match_written, shared_dir


@dataclass(frozen=True)
class Rule:
    """pattern: a Java regular expression; least: code points that `group` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds. For access and hex the floor stands in the pattern: runs are maximal, so the matches are the same.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further kinds; they only add spans.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + EXTRA_RULES
#: Of what a rule version means besides its rules, such as how spans are told: blobs are scanned again for a new one.
RULES_VERSION = "1"
MARK = "[SECRET]"

_SPAN = "array<struct<start:bigint,stop:bigint,kind:int>>"
#: Pieces of a text that are cut out of one part of it at a time.
_AT_ONCE = 128


def version_of(rules: tuple[Rule, ...], version: str = RULES_VERSION) -> str:
    """A rule version's name: other rules have another, so findings of one set never stand for another's."""
    return f"{version}-{hashlib.sha256(repr(rules).encode()).hexdigest()[:16]}"


def may_match(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether any rule's pattern is in the text: no span is anywhere else."""
    found = F.lit(False)
    for r in rules:
        found = found | F.coalesce(text.rlike(r.pattern), F.lit(False))
    return found


def _hits(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Every rule's leftmost non-overlapping matches: struct(kind, nth, gap, size, keep), gap being the code points since the match before."""
    parts = []
    for number, r in enumerate(rules):
        found = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        tested = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)) if r.group else found
        # text between the matches and the matches themselves alternate
        rows = F.arrays_zip(F.split(text, r.pattern, -1).alias("gap"), found.alias("hit"), tested.alias("part"))
        one = F.transform(rows, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["part"]) >= r.least).alias("keep")))  # noqa: B023 - called at once
        parts.append(F.when(text.rlike(r.pattern), one))
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,keep:boolean>>")
    return F.concat(*[F.coalesce(p, none) for p in parts])


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs (digest, text), each digest once, as (digest, spans): all rules' spans by start, then kind as listed.

    Matches become rows and a running sum gives their places, so the time is linear in
    their number; rows stay in the partitions that blobs have by digest.
    """
    rows = blobs.select("digest", F.inline_outer(_hits(F.col("text"), rules)))
    upto = Window.partitionBy("digest", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("stop", F.sum((F.col("gap") + F.coalesce("size", F.lit(0))).cast("bigint")).over(upto))
    span = F.struct((F.col("stop") - F.col("size")).alias("start"), "stop", "kind")
    return placed.groupBy("digest").agg(F.array_sort(F.collect_list(F.when(F.col("keep"), span))).cast(_SPAN).alias("spans"))


def joined(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:stop, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


class BlobLedger:
    """Scanned blobs and their findings, kept in a folder that the executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    _scanned = T.StructType([T.StructField("digest", T.StringType()), T.StructField("rules", T.StringType())])
    _found = T.StructType(_scanned.fields + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("kind", T.IntegerType())])))])

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._there(name) else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", self._scanned).distinct()

    def findings(self) -> DataFrame:
        """One row per (digest, rules) with spans; blobs without spans have none."""
        return self._read("findings", self._found).dropDuplicates(["digest", "rules"])

    def scan(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION) -> DataFrame:
        """Bring the ledger up to date with `versions`; returns the findings of this rule version by digest.

        versions: any DataFrame with the named text column (null: empty).  Equal texts
        are reduced before the shuffle (a partial aggregate by digest), so a blob with
        very many copies reaches one task as one row per map task, and is scanned once.
        """
        version = version_of(rules, rules_version)
        blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
        blobs = blobs.select(F.sha2("text", 256).alias("digest"), "text")
        with Scratch(self.spark, "secret-scan") as scratch:
            if self._there("scanned"):
                seen = scratch.cut(self.scanned().where(F.col("rules") == version).select("digest"), "seen")
                blobs = match_written(blobs, seen, ["digest"], "left_anti")
            unseen = blobs.groupBy("digest").agg(F.first("text").alias("text"))
            fresh = scratch.cut(find_spans(unseen, rules).select("digest", F.lit(version).alias("rules"), "spans"), "fresh")
            fresh.where(F.size("spans") > 0).write.mode("append").parquet(f"{self.path}/findings")
            fresh.select("digest", "rules").write.mode("append").parquet(f"{self.path}/scanned")
        return self.findings().where(F.col("rules") == version).select("digest", "spans")


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """The secrets of every document.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans.  Null and empty
    texts have no spans; a null doc_id stays null; repeated rows each give a row; other
    columns of `docs` are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark, shared_dir(spark, "secret-ledger"))
    docs = docs.select("doc_id", "text")
    findings = ledger.scan(docs)
    addressed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    found = addressed.join(findings, "digest", "left").select("doc_id", F.coalesce("spans", F.array().cast(_SPAN)).alias("found"))
    base = F.filter("found", lambda x: x["kind"] < len(BASE_RULES))
    kinds = F.col("found.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _covers(findings: DataFrame) -> DataFrame:
    """digest and its spans without overlaps (start, stop): spans that overlap are one."""
    rows = findings.select("digest", F.inline("spans"))
    order = ("start", "stop", "kind")
    before = Window.partitionBy("digest").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("digest").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.coalesce(F.col("start") >= F.max("stop").over(before), F.lit(True))
    parts = rows.withColumn("opens", opens).withColumn("part", F.sum(F.col("opens").cast("int")).over(upto))
    one = parts.groupBy("digest", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return one.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("covers"))


def _without(text: Column, covers: Column) -> Column:
    """The text with MARK in place of each cover.

    Cutting a piece out takes time up to its place in the text, so every _AT_ONCE pieces
    are cut out of the part of the text that they are in.
    """
    bind = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    whole = lambda x: x.cast("int")
    start_of = lambda i: F.when(i > 0, F.get(covers, i - 1)["stop"]).otherwise(F.lit(0))  # noqa: E731 - of the i-th piece between covers
    stop_of = lambda i: F.coalesce(F.get(covers, i)["start"], F.length(text).cast("bigint"))

    def part(k: Column) -> Column:
        low, high = k * _AT_ONCE, F.least(k * _AT_ONCE + _AT_ONCE - 1, F.size(covers))
        begin = start_of(low)
        here = F.substring(text, whole(begin + 1), whole(stop_of(high) - begin))
        return bind(here, lambda t: F.array_join(F.transform(F.sequence(low, high), lambda i: F.substring(t, whole(start_of(i) - begin + 1), whole(stop_of(i) - start_of(i)))), MARK))

    return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(covers) / _AT_ONCE).cast("int")), part), MARK)


def redact(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """docs with MARK in place of every span, of overlapping ones once; rows, columns and their order stay.

    Null and empty texts stay as they are, repeated rows are redacted alike, and an empty
    table gives an empty result.  Texts move once, for the scan of equal ones; findings
    too many to be broadcast are joined to the texts that hold a rule's pattern, and no
    other text moves.
    """
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark, shared_dir(spark, "secret-ledger"))
    key, at = free_name(docs, "digest"), free_name(docs, "covers")
    covers = cut(_covers(ledger.scan(docs.select("text"))).select(F.col("digest").alias(key), F.col("covers").alias(at)), "covers")
    text = F.when(F.col(f"`{at}`").isNotNull(), _without(F.col("text"), F.col(f"`{at}`"))).otherwise(F.col("text"))
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    keyed = lambda df: df.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    if covers.count() <= BROADCAST_ROWS // 10:  # a row may hold many spans
        return keyed(docs).join(F.broadcast(covers), key, "left").select(*out)
    maybe = may_match(F.col("text"))
    return keyed(docs.where(maybe)).join(covers.hint("merge"), key, "left").select(*out).unionByName(docs.where(~maybe).select(*docs.columns))
