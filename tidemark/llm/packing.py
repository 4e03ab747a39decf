"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised once, in Arrow batches, and cut into full sequences and
one remainder; only the pieces' numbers travel on.  The pieces are dealt into
randomised groups of about `group_docs` documents, and each group is packed on its
own: remainders by falling length, each into the first open sequence with room,
found by walking a tournament tree whose inner nodes hold the largest capacity
below them.  Group size is bounded, so memory is, and the padding left by the last
open sequences of a group is a fixed small share.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import bounded_batches

LENGTH = 2048
END_ID = 1
GROUP_DOCS = 8192
#: Groups are random, so one key with very many rows spreads; the seed makes a repeated task deal alike.
GROUP_SEED = 17
_PIECES = "doc_id bigint, grp int, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks of byte strings, special strings) of a byte-level BPE vocabulary in the tokenizers library's JSON."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}, special


#: Fixed value: how byte-level BPE of this family splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are split and merged here: the library's splitter runs out of stack in a run of white space of about a million.
LONG = 400_000
_SPLITTER = regex.compile(SPLIT)
_NEVER = 1 << 40


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: of neighbours whose union is in the vocabulary, those of the lowest id join first, from the left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 64:  # a heap only pays for itself in longer ones
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(piece[i : i + 2], _NEVER) for i in range(n - 1)]
        while pairs and (low := min(pairs)) < _NEVER:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
        return [ranks[x] for x in parts]
    stop, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]  # of the part that starts here
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01" * n)

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (r := ranks.get(piece[i : stop[j]])) is not None:
            heapq.heappush(heap, (r, i))

    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or ranks.get(piece[i : stop[j]]) != r:
            continue  # a neighbour has joined another since
        stop[i], after[i], alive[j] = stop[j], after[j], 0
        if after[i] >= 0:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[piece[i : stop[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Splits texts and merges their pieces, for one vocabulary."""

    def __init__(self, path: str):
        self.ranks, self.special = load_vocabulary(path)
        self.tiktoken = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Words and special strings, in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return _SPLITTER.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else _SPLITTER.findall(part)
        return out

    def ids_of(self, piece: str) -> list[int]:
        return [self.special[piece]] if piece in self.special else merge(piece.encode(), self.ranks)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONG:
            return self.tiktoken.encode_to_numpy(text, allowed_special="all")
        known: dict[str, list[int]] = {}
        return np.array([i for p in self.pieces(text) for i in (known[p] if p in known else known.setdefault(p, self.ids_of(p)))], "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class FirstFit:
    """Bins of equal capacity in the order they were opened.

    tree[1] is the root, tree[i] the largest free capacity among the leaves below i;
    leaves that are not open yet count as full-sized, so the first fit always exists.
    """

    def __init__(self, capacity: int, bins: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, free capacity before) of the leftmost bin that can take size."""
        tree, i = self.tree, 1
        while i < self.width:
            i *= 2
            if tree[i] < size:
                i += 1
        free = tree[i]
        bin_ = i - self.width
        tree[i] = free - size
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return bin_, free


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) for each length, by first-fit decreasing; ties keep their order."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    fit, out = FirstFit(capacity, len(lengths)), [(0, 0)] * len(lengths)
    for i in order:
        bin_, free = fit.place(lengths[i])
        out[i] = (bin_, capacity - free)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone.  A null doc_id stays null.
    Repeated rows are documents of their own.  Columns other than doc_id and text are
    not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    groups = max(1, -(-docs.count() // group_docs))
    docs = docs.select("doc_id", "text", F.floor(F.rand(GROUP_SEED) * groups).cast("int").alias("grp"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            ids, texts, grp = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            rows: list[tuple] = []
            for i, g, text in zip(ids, grp, texts, strict=True):
                tokens = np.append(enc.encode(text.as_py() or ""), end_id).astype("<u4")
                n = len(tokens)
                rows += [(i, g, at, min(length, n - at), zlib.crc32(tokens[at : at + length].tobytes()), n) for at in range(0, n, length)]
            names = ("doc_id", "grp", "start", "length", "ids_crc32", "doc_tokens")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_pylist()
        placed = pack_lengths(lengths, length)
        base = table.column("grp")[0].as_py() << 32
        columns = [table.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        columns += [pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
        return pa.table(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return docs.mapInArrow(tokenise, _PIECES).groupBy("grp").applyInArrow(pack, _PACKED)
