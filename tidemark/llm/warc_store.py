"""A content-addressed WARC archive.

A payload is stored once, under the SHA-256 of its bytes.  Record headers are kept
apart, byte for byte, one row per record.  A record is rebuilt by joining the two:
a response takes its payload from the store, a revisit has no block of its own and
names the response that has it.

Layout: `headers/` (digest, header) and `payloads/` (digest, payload), both Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import shared_dir

#: The alphabet of base32, and the profile URI of a revisit by identical payload.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1: 160 bits are four groups of 40, eight letters each."""
    sha = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(sha, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _header_value(value: Column) -> Column:
    """A URL as a header value: line ends can't stand there, so they are percent-encoded."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "\r", "%0D"), "\n", "%0A")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("null")), digest), 256)
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, i, n) for i, n in at]), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = WARC_DATE) -> None:
    """Archive every row of pages (page_id, url, html) under `path`.

    Of records with equal payloads of at least min_bytes, that with the largest page_id
    is a response and others are revisits of it.  A null html is an empty payload; a null
    page_id is smaller than any other, and is recorded as an empty value.  Rows equal in
    page_id and payload tie: they are captures of one record and stay of one type.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    raw = pages.select("page_id", "url", payload.alias("payload"))
    keyed = raw.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    # Small rows only: the payloads stay where they are while each digest's response is chosen.
    heads = raw.select("page_id", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("bigint").alias("size"))
    first = heads.groupBy("digest").agg(F.max("page_id").alias("holder"))
    heads = heads.join(first, "digest")
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    id_text = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    refers = F.when(revisit, F.concat(line("WARC-Profile", _PROFILE), line("WARC-Refers-To", _record_id(F.col("holder"), F.col("digest"))), line("X-Refers-To-Page", F.coalesce(F.col("holder").cast("string"), F.lit(""))))).otherwise("")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-SHA256", F.col("digest")),
        line("X-Page", id_text),
        refers,
        line("Content-Type", "text/html; charset=utf-8"),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
    )
    heads.select("digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    # A partial aggregate keeps one payload per digest and map task, so copies don't travel.
    keyed.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def header_field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)\r\n", 1)


def payload_index(spark: SparkSession, path: str) -> DataFrame:
    """digest, measured size and SHA-1 of each stored payload; a payload whose bytes don't have its digest raises."""
    stored = spark.read.parquet(f"{path}/payloads")
    ok = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(ok, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), F.col("digest"))))
    return stored.select(checked.alias("digest"), F.length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "payload")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: page_id, payload_bytes, payload_digest, record_type, refers_to, header, payload.

    Size and digest are measured on the stored bytes and held against the header; what
    isn't asked for, such as the payload, isn't shuffled.
    """
    # a line's value never holds \r or \n, so fields can be told apart
    text = F.decode("header", "UTF-8")
    heads = spark.read.parquet(f"{path}/headers").select(
        "header",
        "digest",
        F.nullif(header_field(text, "X-Page"), F.lit("")).cast("bigint").alias("page_id"),
        header_field(text, "WARC-Type").alias("record_type"),
        F.nullif(header_field(text, "X-Refers-To-Page"), F.lit("")).cast("bigint").alias("refers_to"),
        F.substring(header_field(text, "WARC-Payload-Digest"), 6, 32).alias("named_digest"),
    )
    joined = heads.join(payload_index(spark, path), "digest")
    same = F.col("named_digest") == F.col("payload_digest")
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload differ")))
    return joined.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "header", "payload")


def record_bytes() -> Column:
    end = F.encode(F.lit("\r\n"), "UTF-8")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header"), end, block, end, end)


def rebuild(records: DataFrame) -> DataFrame:
    """page_id and the exact bytes of each WARC record."""
    return records.select("page_id", record_bytes().alias("record"))


def measure_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, from its rebuilt bytes.

    A response's payload is the block that is cut from the record; a revisit has none, so
    its payload is the one it is joined to.  A record that is longer or shorter than its
    header says, or whose payload hasn't its digest, raises.
    """
    head = F.concat(F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1), F.lit("\r\n"))
    whole = records.select(record_bytes().alias("record"), "payload").select("record", "payload", head.alias("head"))
    field = lambda name: header_field(F.col("head"), name)
    at = F.octet_length("head") + 2
    size = field("Content-Length").cast("int")
    block = F.when(F.octet_length("record") == at + size + 4, F.substring(F.col("record"), at + 1, size)).otherwise(F.raise_error(F.lit("record damaged")).cast("binary"))
    payload = F.when(field("WARC-Type") == "response", block).when(F.length(block) == 0, F.col("payload")).otherwise(F.raise_error(F.lit("revisit with a block")).cast("binary"))
    cut = whole.select("head", payload.alias("payload")).select("head", F.length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"))
    same = F.substring(field("WARC-Payload-Digest"), 6, 32) == F.col("digest")
    return cut.select(
        F.nullif(field("X-Page"), F.lit("")).cast("bigint").alias("page_id"),
        "payload_bytes",
        F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("header and payload differ"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.nullif(field("X-Refers-To-Page"), F.lit("")).cast("bigint").alias("refers_to"),
    )


def parse_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC file."""
    out, at = [], 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        out.append((fields, data[stop + 4 : stop + 4 + size]))
        at = stop + 4 + size + 4
    return out


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of standard .warc files (one task per file): page URL, type, block."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = parse_warc(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([f.get("WARC-Target-URI") for f, _ in rows], pa.string()), pa.array([f["WARC-Type"] for f, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.binary())], ["url", "record_type", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "url string, record_type string, block binary")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive, read it back; see write_archive and read_records. An empty table gives no records."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_archive(pages, path)
    return read_records(spark, path)
