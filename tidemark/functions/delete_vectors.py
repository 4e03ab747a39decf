"""The portable blob of a deletion vector: a 64-bit roaring bitmap with a length, a magic number and a checksum.

    length (4, big endian) | magic D1 D3 39 64 | bitmap (portable, little endian) | CRC-32 of magic and bitmap (4, big endian)

`encode` and `decode` take one set through the RoaringBitmap classes that Spark ships;
`blobs` and `positions` work in tasks, and write the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the blob's magic number.
MAGIC = bytes.fromhex("D1D33964")


def encode(spark: SparkSession, rows: list[int]) -> bytes:
    jvm = spark._jvm
    bitmap = jvm.org.roaringbitmap.longlong.Roaring64NavigableMap()
    for r in sorted(rows):
        bitmap.addLong(r)
    bitmap.runOptimize()
    sink = jvm.java.io.ByteArrayOutputStream()
    bitmap.serializePortable(jvm.java.io.DataOutputStream(sink))
    body = MAGIC + bytes(sink.toByteArray())
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def decode(spark: SparkSession, blob: bytes) -> list[int]:
    """Raises ValueError for a blob whose length, magic number or checksum is wrong."""
    (size,) = struct.unpack_from(">I", blob)
    body = blob[4 : 4 + size]
    if len(blob) != size + 8 or body[:4] != MAGIC or struct.unpack_from(">I", blob, 4 + size)[0] != zlib.crc32(body):
        raise ValueError("damaged deletion vector")
    jvm = spark._jvm
    bitmap = jvm.org.roaringbitmap.longlong.Roaring64NavigableMap()
    bitmap.deserializePortable(jvm.java.io.DataInputStream(jvm.java.io.ByteArrayInputStream(bytearray(body[4:]))))
    return list(bitmap.toArray())


#: Fixed values of the bitmap's format: cookies without and with runs, the largest array, a bitset's bytes, and the containers from which runs have offsets too.
_PLAIN, _RUNS, _ARRAY, _BITSET, _OFFSETS = 12346, 12347, 4096, 8192, 4
#: Rows and bytes that a task hands on at once.
_ROWS, _BYTES = 1 << 16, 1 << 22


def _container(low: np.ndarray) -> tuple[bool, bytes]:
    """(whether it is in runs, bytes) of sorted 16-bit values: the smallest of runs, array and bitset."""
    ends = np.append(np.flatnonzero(np.diff(low.astype(np.int32)) != 1), len(low) - 1)
    if 2 + 4 * len(ends) < (2 * len(low) if len(low) <= _ARRAY else _BITSET):
        starts = np.append(0, ends[:-1] + 1)
        return True, struct.pack("<H", len(ends)) + np.column_stack([low[starts], ends - starts]).astype("<u2").tobytes()
    if len(low) <= _ARRAY:
        return False, low.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    return False, np.packbits(bits, bitorder="little").tobytes()


def _bitmap(parts: list[tuple[int, bool, int, bytes]]) -> bytes:
    """A 32-bit bitmap of containers (key, in runs, cardinality, bytes)."""
    n, runs = len(parts), any(p[1] for p in parts)
    if runs:
        head = struct.pack("<I", _RUNS | (n - 1) << 16) + np.packbits([p[1] for p in parts], bitorder="little").tobytes()
    else:
        head = struct.pack("<II", _PLAIN, n)
    head += np.array([(p[0], p[2] - 1) for p in parts], "<u2").tobytes()
    if not runs or n >= _OFFSETS:
        head += (len(head) + 4 * n + np.cumsum([0, *[len(p[3]) for p in parts[:-1]]])).astype("<u4").tobytes()
    return head + b"".join(p[3] for p in parts)


def _blob(parts: list[tuple[int, bool, int, bytes]]) -> bytes:
    """The blob of containers (position >> 16, in runs, cardinality, bytes), in order."""
    maps: dict[int, list] = {}
    for high, *rest in parts:
        maps.setdefault(high >> 16 & 0xFFFFFFFF, []).append((high & 0xFFFF, *rest))
    body = MAGIC + struct.pack("<q", len(maps)) + b"".join(struct.pack("<I", k) + _bitmap(m) for k, m in maps.items())
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def _decoded(blob: bytes) -> Iterator[np.ndarray]:
    """A blob's positions, a container at a time."""
    (size,) = struct.unpack_from(">I", blob)
    body = memoryview(blob)[4 : 4 + size]
    if len(blob) != size + 8 or body[:4] != MAGIC or struct.unpack_from(">I", blob, 4 + size)[0] != zlib.crc32(body):
        raise ValueError("damaged deletion vector")
    (maps,), at = struct.unpack_from("<q", body, 4), 12
    for _ in range(maps):
        high, cookie = struct.unpack_from("<II", body, at)
        at += 8
        if cookie & 0xFFFF == _RUNS:
            n = (cookie >> 16) + 1
            in_runs = np.unpackbits(np.frombuffer(body, np.uint8, (n + 7) // 8, at), bitorder="little")
            at += (n + 7) // 8
        else:
            (n,), in_runs = struct.unpack_from("<I", body, at), None
            at += 4
        keys = np.frombuffer(body, "<u2", 2 * n, at).reshape(n, 2)
        at += 4 * n + (4 * n if in_runs is None or n >= _OFFSETS else 0)
        for i, (key, less) in enumerate(keys.tolist()):
            if in_runs is not None and in_runs[i]:
                (count,) = struct.unpack_from("<H", body, at)
                pairs = np.frombuffer(body, "<u2", 2 * count, at + 2).reshape(count, 2).astype(np.int64)
                at += 2 + 4 * count
                lengths = pairs[:, 1] + 1
                low = np.repeat(pairs[:, 0] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            elif less < _ARRAY:
                low = np.frombuffer(body, "<u2", less + 1, at).astype(np.int64)
                at += 2 * (less + 1)
            else:
                low = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8, _BITSET, at), bitorder="little")).astype(np.int64)
                at += _BITSET
            yield low + np.array(high << 32 | key << 16, np.uint64).view(np.int64)


def _to_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, high, row_index), sorted, as (file, high, runs, n, bytes): a container each."""
    held: list[np.ndarray] = []
    key: tuple | None = None
    out: list[tuple] = []
    names = ["file", "high", "runs", "n", "bytes"]
    kinds = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()], strict=True)))
    full = lambda: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], kinds)

    def close() -> None:
        low = np.unique(np.concatenate(held) & 0xFFFF)
        out.append((*key, *(lambda c: (c[0], len(low), c[1]))(_container(low))))
        held.clear()

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column("file").dictionary_encode()
        codes, high, rows = (np.asarray(files.indices.fill_null(-1)), np.asarray(batch.column("high")), np.asarray(batch.column("row_index")))
        starts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(high) != 0)) + 1).tolist(), len(rows)]
        for a, b in zip(starts, starts[1:], strict=False):
            new = (files[a].as_py(), int(high[a]))
            if held and new != key:
                close()
                size += len(out[-1][-1])
                if len(out) >= _ROWS or size >= _BYTES:
                    yield full()
                    out.clear()
                    size = 0
            key = new
            held.append(rows[a:b])
            if len(held) > 64:  # positions that are repeated
                held[:] = [np.unique(np.concatenate(held))]
    if held:
        close()
    if out:
        yield full()


def _to_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers, sorted by file and place, as a blob per file."""
    parts: list[tuple] = []
    file: str | None = None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([_blob(parts)], pa.binary())], ["file", "blob"])
    for batch in batches:
        for new, *part in zip(*[batch.column(c).to_pylist() for c in ("file", "high", "runs", "n", "bytes")], strict=True):
            if parts and new != file:
                yield done()
                parts.clear()
            file = new
            parts.append(tuple(part))
    if parts:
        yield done()


def _to_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, blob in zip(batch.column("file"), batch.column("blob"), strict=True):
            held, n = [], 0
            rows = lambda held: pa.RecordBatch.from_arrays([pa.repeat(file, sum(map(len, held))), pa.array(np.concatenate(held), pa.int64())], ["file", "row_index"])  # noqa: E731, B023
            for part in _decoded(blob.as_py()):
                held.append(part)
                n += len(part)
                if n >= _ROWS:
                    yield rows(held)
                    held, n = [], 0
            if held:
                yield rows(held)


def blobs(deleted: DataFrame) -> DataFrame:
    """A delete set (file, row_index) as one blob per file: file, blob.

    Positions are dealt by file and place, so that one file with most deletes is shared
    between tasks; only their containers come together, a file's in one task.
    """
    placed = deleted.where("row_index IS NOT NULL").select("file", F.shiftright("row_index", 16).alias("high"), "row_index")
    parts = placed.repartition("file", "high").sortWithinPartitions("file", "high").mapInArrow(_to_containers, "file string, high bigint, runs boolean, n int, bytes binary")
    return parts.repartition("file").sortWithinPartitions("file", F.col("high") < 0, "high").mapInArrow(_to_blobs, "file string, blob binary")


def positions(blobs_: DataFrame) -> DataFrame:
    """The delete set (file, row_index) of blobs."""
    return blobs_.select("file", "blob").mapInArrow(_to_positions, "file string, row_index bigint")
