"""Vectorised text analysis over Arrow string columns.

The functions here look at a whole Arrow batch at once: the batch's UTF-8 bytes
are one numpy array, and words, lines and n-grams are index ranges in it.  No
Python object is made per word, so memory is bounded by the batch and the cost
is a few numpy passes per byte.  Batches are cut into slices of a bounded
number of bytes first (`slices`), a very long text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: An odd multiplier has an inverse modulo 2**64, which lets substring hashes be cut from prefix sums.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WINDOW = np.uint64(0xD6E8FEB86659FD93)
#: The white space that separates words, \x20 and \x09 to \x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _grown_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = -(-n >> 18) << 18  # small slices, as training takes on the driver, need short tables
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64's), elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs of texts with at most `limit` bytes, or one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, texts.slice(at, end - at)
        at = end


class Texts:
    """The bytes of some texts, with a newline put between them so that nothing spans two texts.

    data: bytes; doc_start, doc_end: each text's range. A null text is empty.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        self.n = n
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.empty(0, np.uint8)
        size = int(offsets[-1] - offsets[0]) if n else 0
        start = offsets[:-1] - offsets[0] + np.arange(n)
        data = np.full(size + n, 10, np.uint8)
        if size:
            put = np.ones(size + n, bool)
            put[start + np.diff(offsets)] = False
            data[put] = raw[offsets[0] : offsets[-1]]
        self.data = data
        self.doc_start, self.doc_end = start, start + np.diff(offsets)
        self.is_null = np.asarray(texts.is_null()) if n else np.empty(0, bool)
        self._prefix: np.ndarray | None = None

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, position, side="right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """The sum of a 0/1 array over the bytes of each text."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.doc_end] - total[self.doc_start]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number) of every maximal run without white space."""
        inside = ~_IS_SPACE[self.data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return start, end, self.doc_of(start)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range, its length included."""
        up, down = _grown_powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            if self._prefix is None:
                self._prefix = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=self._prefix[1:])
            return mix((self._prefix[end] - self._prefix[start]) * down[start] + (end - start).astype(np.uint64) * _WINDOW)

    def identities(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit name of each of some ranges that don't overlap and are in order, as words or lines are.

        Each (place in the range, byte) has a random number, and a range is the sum of its
        own: unlike for the polynomial of `hashes`, no texts that collide are known by
        construction.
        """
        length = end - start
        inside = np.repeat(np.arange(len(start)), length)
        place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
        byte = self.data[start[inside] + place]
        total = np.zeros(len(inside) + 1, np.uint64)
        with np.errstate(over="ignore"):
            value = _PLACED[(place & 63) << 8 | byte]
            far = np.flatnonzero(place >= 64)
            value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64) * _BASE)
            np.cumsum(value, out=total[1:])
            stop = np.cumsum(length)
            return mix(total[stop] - total[stop - length] + length.astype(np.uint64) * _WINDOW)

    def text(self, i: int) -> bytes:
        return self.data[self.doc_start[i] : self.doc_end[i]].tobytes()


_PLACED = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word's index, hash) of each run of `size` words of one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    with np.errstate(over="ignore"):
        h = np.zeros(len(first), np.uint64)
        for i in range(size):
            h = h * _WINDOW + hashes[first + i]
    return first, mix(h)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return start, np.diff(np.append(start, len(sorted_keys)))


def repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: (flag: an equal (doc, h) stands elsewhere, flag: an equal one stands earlier)."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    d, k = doc[order], h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (d[1:] == d[:-1]) & (k[1:] == k[:-1]) if len(h) else False
    twice, earlier = np.empty(len(h), bool), np.empty(len(h), bool)
    twice[order], earlier[order] = same[:-1] | same[1:], same[:-1]
    return twice, earlier
