"""Near-duplicate vectors by int8 tile products with rigorous bounds.

Equal vectors of a label are one node with a count, and are quantised once to int8 with a
scale of their own.  A label's nodes are dealt into tiles, and each pair of tiles is one
group, to which only codes travel.  The product of the codes, with both vectors' error
bounds, shows most pairs to be linked or not for certain.  The nodes of the others come to
their pair of tiles once more, in full precision, and only these pairs are recomputed.  A
group gives a count and a root for each linked node, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.storage import Scratch, cut

THRESHOLD = 0.93
TILE = 4096
_BLOCK = 256
_RECOMPUTED = 32_768


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: exact, and squares stay in range."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, bound) of the unit vectors of rows: |unit row - scale * codes| <= bound."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - scale[:, None] * codes) ** 2).sum(axis=1)) + 1e-12


class Side:
    """Codes, scales and bounds of a tile's nodes."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, bound: np.ndarray):
        self.codes, self.scale, self.bound = codes, scale, bound

    def take(self, rows: np.ndarray) -> Side:
        return Side(self.codes[rows], self.scale[rows], self.bound[rows])


def judged(a: Side, b: Side, threshold: float, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, surely linked, unsure) for blocks of a's rows against all of b's; with `same`, of one tile and each pair once.

    x.y - x'.y' = x.(y - y') + (x - x').y', so quantising moves a cosine of unit vectors by
    at most e_y + e_x (1 + e_y).  Sums of products of codes are whole numbers under 2**24 in
    up to 1024 dimensions, which single precision holds exactly; beyond, doubles are used.
    """
    kind = np.float32 if a.codes.shape[1] <= 1024 else np.float64
    right = b.codes.astype(kind).T
    for at in range(0, len(a.codes), _BLOCK):
        rows = slice(at, at + _BLOCK)
        estimate = (a.codes[rows].astype(kind) @ right).astype(np.float64) * a.scale[rows, None] * b.scale
        error = b.bound + a.bound[rows, None] * (1 + b.bound) + 1e-9
        sure, maybe = estimate - error >= threshold, estimate + error >= threshold
        if same:
            later = np.arange(len(b.codes)) > np.arange(at, at + len(estimate))[:, None]
            sure, maybe = sure & later, maybe & later
        yield at, sure, maybe & ~sure


class Links:
    """Counts and roots of nodes whose links come a block at a time."""

    def __init__(self, count: np.ndarray):
        self.count, self.links, self.root = count, np.zeros(len(count), np.int64), np.arange(len(count))

    def add(self, u: np.ndarray, v: np.ndarray, linked: np.ndarray) -> None:
        """linked [u, v]: which nodes u are linked to which nodes v, each pair once."""
        whole = linked.astype(np.float64)  # sums of counts below 2**53 are exact
        np.add.at(self.links, u, (whole @ self.count[v]).astype(np.int64))
        np.add.at(self.links, v, (self.count[u] @ whole).astype(np.int64))
        for k in np.flatnonzero(linked.any(axis=1)):
            met = np.unique(np.append(self.root[v[linked[k]]], self.root[u[k]]))
            if len(met) > 1:
                self.root[np.isin(self.root, met)] = met[0]

    def table(self, group: pa.Table, node: np.ndarray, unsure: np.ndarray) -> pa.Table:
        rows = np.flatnonzero((self.links > 0) | unsure)
        same = lambda name: pa.array(np.full(len(rows), group.column(name)[0].as_py() if group.num_rows else 0, np.int64))
        return pa.table([same("label"), same("dim"), same("i"), same("j"), pa.array(node[rows]), pa.array(self.links[rows]), pa.array(node[self.root[rows]]), pa.array(unsure[rows])], names=["label", "dim", "i", "j", "node", "links", "root", "unsure"])


_FOUND = "label bigint, dim bigint, i bigint, j bigint, node bigint, links bigint, root bigint, unsure boolean"


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Side, bool]:
    node, n, tile = (np.asarray(group.column(c)) for c in ("node", "n", "tile"))
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    codes = np.frombuffer(b"".join(c.as_py() for c in group.column("codes")), np.int8).reshape(len(node), -1)
    every = Side(codes, np.asarray(group.column("scale")), np.asarray(group.column("bound")))
    return node, n, np.flatnonzero(tile == i), np.flatnonzero(tile == j), every, i == j


def _by_codes(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, n, left, right, every, same = _sides(group)
        out, unsure = Links(n), np.zeros(len(node), bool)
        for at, sure, maybe in judged(every.take(left), every.take(right), threshold, same):
            rows = left[at : at + len(sure)]
            out.add(rows, right, sure)
            unsure[rows] |= maybe.any(axis=1)
            unsure[right] |= maybe.any(axis=0)
        return out.table(group, node, unsure)

    return run


def _in_full(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, n, left, right, every, same = _sides(group)
        x = np.frombuffer(b"".join(v.as_py() for v in group.column("vec")), np.float64).reshape(len(node), -1)
        norm, out = np.linalg.norm(x, axis=1), Links(n)
        for at, _, maybe in judged(every.take(left), every.take(right), threshold, same):
            rows, near = left[at : at + len(maybe)], np.zeros(maybe.shape, bool)
            p, q = np.nonzero(maybe)
            for k in range(0, len(p), _RECOMPUTED):
                a, b = p[k : k + _RECOMPUTED], q[k : k + _RECOMPUTED]
                near[a, b] = np.einsum("nd,nd->n", x[rows[a]], x[right[b]]) / (norm[rows[a]] * norm[right[b]]) >= threshold
            out.add(rows, right, near)
        return out.table(group, node, np.zeros(len(node), bool))

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their vector as codes, scale, bound, and doubles near 1 in size; a batch's vectors are taken together by length."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1).cast(pa.large_list(pa.float64()))
        start = np.asarray(lists.offsets)
        size, values = np.diff(start), np.asarray(lists.values)
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            x = scaled(values[start[rows][:, None] + np.arange(dim)] + 0.0)
            codes, scale, bound = quantise(x)
            binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[:-1]), binary(codes), pa.array(scale), pa.array(bound), binary(x)], [*batch.schema.names[:-1], "codes", "scale", "bound", "vec"])


def _comparable(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, label, embedding).

    Only vectors of one label (and one length) are compared.  Rows with a null label or
    vec_id, and vectors that are null, empty, zero or hold null or non-finite components,
    link with nothing and are their own component.  Repeated rows are vectors of their
    own: equal ones link.  Rows that share a vec_id are vectors of their own too, each with
    its own links and component, which is named by its smallest vec_id.  Other columns
    aren't read; an empty table gives an empty result.
    """
    rows = vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _comparable(F.col("v"))
    rows = rows.select("vec_id", F.when(good, F.col("label")).alias("label"), "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(0x5851F42D4C957F2D), "v").alias("k2"))
    with Scratch(vectors.sparkSession, "vectors") as scratch:
        # grouped by the vectors themselves; copies are one row per map task before the shuffle
        unique = rows.where(F.col("label").isNotNull()).groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"))
        unique = unique.select(F.monotonically_increasing_id().alias("node"), "label", F.size("v").cast("bigint").alias("dim"), "low", "n", "k1", "k2", "v")
        unique = scratch.cut(unique.mapInArrow(_coded, "node bigint, label bigint, dim bigint, low bigint, n bigint, k1 bigint, k2 bigint, codes binary, scale double, bound double, vec binary"), "nodes")
        tiles = unique.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).alias("tiles"))
        dealt = unique.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
        spread = dealt.select("label", "dim", "node", "n", "codes", "scale", "bound", "tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("other"))
        key = ("label", "dim", "i", "j")
        paired = spread.select("label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "n", "codes", "scale", "bound", "tile")
        found = scratch.cut(paired.groupBy(*key).applyInArrow(_by_codes(threshold), _FOUND), "by-codes")
        again = found.where("unsure").select(*key, "node").join(unique.join(tiles, ["label", "dim"]).select("node", "n", "codes", "scale", "bound", "vec", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile")), "node")
        exact = scratch.cut(again.groupBy(*key).applyInArrow(_in_full(threshold), _FOUND), "in-full")
        linked = found.where("links > 0").unionByName(exact).select("node", "links", "root")
        components = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
        counted = linked.groupBy("node").agg(F.sum("links").alias("links"))
        lowest = unique.select("node", "low").join(components, "node").groupBy("component").agg(F.min("low").alias("component_id"))
        named = components.join(lowest, "component").select("node", "component_id")
        known = unique.select("label", "k1", "k2", "node", "n", "low").join(counted, "node", "left").join(named, "node", "left")
        known = known.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
        out = rows.select("vec_id", "label", "k1", "k2").join(known, ["label", "k1", "k2"], "left")
        component = F.coalesce("component_id", "vec_id")
        return cut(out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), "vector-classes")
