"""Connected components by alternating large and small stars, each step a written table.

Few edges are joined in one task instead: a step of stars costs the driver and the
cluster a shuffle for each of its joins, however small its tables are.

An edge always leads from a node to a smaller one.  A large star links each node's larger
neighbours to its smallest neighbour, a small star does so with the smaller ones; when
neither changes anything, every node hangs from its component's minimum.  Nothing but a
count and a checksum comes to the driver, and a step's table is deleted once the next is
written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch

#: Edges that one task joins at most, at about 100 bytes each in memory; more take steps of stars.
LOCAL_EDGES = 250_000


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of the edges a[i], b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        # of two roots that an edge joins the larger goes below the smaller; then all nodes move up to their roots
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of all edges (a, b) of this task."""
    edges = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    found = pa.table(least_nodes(edges.column("a").to_numpy(), edges.column("b").to_numpy()), names=["node", "component"])
    yield from found.to_batches(max_chunksize=1 << 16)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: (a, b) of longs; gives (node, component): the smallest node of its component, for nodes with an edge to another.

    Null ends and loops are left out; repeated edges count once.  The result is read from
    the scratch.
    """
    pair = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.cut(edges.where((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull()).select(*pair).distinct(), "edges")
    state = _state(now)
    while state[0] > LOCAL_EDGES:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        starred = large.join(lowest, "a")
        small = starred.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        after = scratch.cut(small.distinct(), "edges")
        before, state = state, _state(after)
        scratch.drop(now)
        now = after
        if state == before:
            break
    else:
        return scratch.cut(now.coalesce(1).mapInArrow(_joined, "node bigint, component bigint"), "components")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
