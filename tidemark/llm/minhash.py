"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its set of runs of five words, each with a weight.  Each run sends arrivals
of a Poisson process, whose rate is its weight, to random registers; a register keeps its
first arrival's run, and a run stops sending once its time is past every register of the
document.  Two registers then agree with the probability Jaccard similarity of the
documents, and that is what pairs are checked on.  With equal weights (the default) it is
the plain Jaccard similarity of the sets; with weights from counts it is that of the
distributions of runs.

Documents with equal runs are one node from then on.  Registers in bands give buckets, and
pairs are checked on their whole sets:

1. Each member of a bucket against the bucket's leader.
2. What is then still in different components of one bucket: every such pair, but for
   those that a bound rules out for certain.  A bucket's largest component meets the
   others' members in a grid of tiles, and these meet each other; so a bucket of any size
   is split over tasks, and a few strays beside a very large component cost each of its
   members one check.

So a group of near copies costs a check for each copy and bucket leader, not for each
pair, and no candidate pair between different components is left out.  Texts are read
twice and don't move, unless more nodes than can be broadcast share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.storage import Scratch, bounded_batches, cut, free_name, match_written
from tidemark.llm.textvec import Texts, mix, runs, slices, windows

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearCopies:
    """bands * rows registers; at similarity 0.8 a pair misses all bands with probability 7e-5. weighted: a run weighs 1 + log(times it stands in the text), else 1. tile, tile_bytes: nodes of a tile, and bytes of their sets, in expectation."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    weighted: bool = False
    tile: int = 256
    tile_bytes: int = 16 << 20


def shingles(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, run, times) by text and run. A text of fewer words than `size` has one run, of all of them."""
    start, end, doc = t.words()
    h = t.identities(start, end)
    first, run = windows(h, doc, size)
    docs, run_s = [doc[first]], [run]
    n = np.bincount(doc, minlength=t.n)
    for short in range(1, size):
        few = n[doc] == short
        first, run = windows(h[few], doc[few], short)
        docs.append(doc[few][first])
        run_s.append(mix(run ^ np.uint64(short)))
    d, s = np.concatenate(docs), np.concatenate(run_s)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(d)))


def weights(times: np.ndarray, weighted: bool) -> np.ndarray:
    return 1 + np.log(times) if weighted else np.ones(len(times))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Register contents [n_docs, registers]: the element that arrived first. Texts without elements keep zeros.

    An element's arrivals are those of one Poisson process of rate 1, the same in every
    text, hurried by its weight there; all texts of a batch take their next arrivals
    together.
    """
    first = np.full(n_docs * registers, np.inf)
    held = np.zeros(n_docs * registers, np.uint64)
    time, seed = np.zeros(len(element)), element.copy()
    while len(element):
        with np.errstate(over="ignore"):
            seed = seed + _STEP
        bits = mix(seed)
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = doc * registers + (mix(bits) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        held[slot[won]] = element[won]
        going = time < first.reshape(n_docs, registers).max(axis=1)[doc]
        doc, element, weight, time, seed = doc[going], element[going], weight[going], time[going], seed[going]
    return held.reshape(n_docs, registers)


def _signatures(how: NearCopies):
    """doc_id, digest, the 128-bit name of the text's runs, their number and the buckets, of texts with a word."""
    names = ["doc_id", "digest", "k1", "k2", "n", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                t = Texts(texts)
                doc, run_, times = shingles(t, how.words)
                held = prob_minhash(doc, run_, weights(times, how.weighted), t.n, how.bands * how.rows)
                here, starts = np.unique(doc, return_index=True)
                with np.errstate(over="ignore"):
                    # sums over a set don't depend on order
                    named = mix(run_ + times.astype(np.uint64) * _STEP) if how.weighted else run_
                    k1 = np.add.reduceat(mix(named ^ np.uint64(0x1B873593)), starts) if len(doc) else np.empty(0, np.uint64)
                    k2 = np.add.reduceat(mix(named ^ np.uint64(0xCC9E2D51)), starts) if len(doc) else np.empty(0, np.uint64)
                    band = np.zeros((len(here), how.bands), np.uint64)
                    for r in range(how.rows):
                        band = mix(band * _STEP + held[here].reshape(-1, how.bands, how.rows)[:, :, r])
                    band = mix(band + np.arange(how.bands, dtype=np.uint64))
                offsets, rows = pa.array(np.arange(len(here) + 1) * how.bands, pa.int32()), pa.array(here)
                columns = [*(batch.column(c).slice(at, t.n).take(rows) for c in (0, 1)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(np.append(starts, len(doc))), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(band.ravel().view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _parts(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values[cuts[i]:cuts[i + 1]], for each i."""
    size = values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts.astype(np.int64) * size)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _sets(how: NearCopies):
    """node, the sorted names of its runs and, if they count, their weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                t = Texts(texts)
                doc, run_, times = shingles(t, how.words)
                cuts = np.searchsorted(doc, np.arange(t.n + 1))
                weight = _parts(weights(times, True), cuts) if how.weighted else pa.array([b""] * t.n, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, t.n), _parts(run_, cuts), weight], ["node", "runs", "weights"])

    return run


def _arrays(column: pa.Array, kind: type) -> list[np.ndarray]:
    """Views of a binary column's values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return []
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return [np.frombuffer(raw, kind, (b - a) // np.dtype(kind).itemsize, a) if b > a else np.empty(0, kind) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common i of 1 / sum over j of max(wa_j / wa_i, wb_j / wb_i): ratios in falling order split the inner sum in two."""
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)], y[np.searchsorted(every, b)] = wa, wb
    ratio = np.divide(x, y, out=np.full(len(every), np.inf), where=y > 0)
    order = np.argsort(-ratio, kind="stable")
    x, y = x[order], y[order]
    before, after = np.cumsum(x), np.cumsum(y[::-1])[::-1] - y
    both = (x > 0) & (y > 0)
    return float((1 / (before[both] / x[both] + after[both] / y[both])).sum())


def _similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    return probability_jaccard(a, wa, b, wb) if len(wa) or len(wb) else jaccard(a, b)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and their similarity."""
    for batch in batches:
        x, y = _arrays(batch.column(2), np.uint64), _arrays(batch.column(4), np.uint64)
        wx, wy = _arrays(batch.column(3), np.float64), _arrays(batch.column(5), np.float64)
        found = [_similarity(*four) for four in zip(x, wx, y, wy, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similarity of each pair (a, b). Sides are joined in turn, so a leader with very many members is a skewed key that Spark splits."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("x"), F.col("weights").alias("wx")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y"), F.col("weights").alias("wy")), "b")
    return both.select("a", "b", "x", "wx", "y", "wy").mapInArrow(_measured, "a bigint, b bigint, similarity double")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows equal in the first `keys` columns, of input sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.zeros(batch.num_rows, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(keys):
                code = mix(code * _STEP + np.asarray(batch.column(k)).astype(np.int64).view(np.uint64))
        for s, n in zip(*runs(code), strict=True):
            now = tuple(batch.column(k)[s].as_py() for k in range(keys))
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(s, n))
            last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_KEY = ("bucket", "across", "i", "j")
_GRID = (*_KEY, "left", "node", "component", "n", "far", "buckets", "runs", "weights")


def _linking(how: NearCopies):
    """Links among the nodes of each group: every candidate pair is checked on its sets, unless links found here join it already. So a group gives fewer links than it has nodes.

    Candidates are pairs of different components in the first bucket that the two share,
    but for those that can't be similar: whose sets differ too much in size, or whose
    distances from the bucket's leader differ by more than a link's distance (one less
    the similarity is a metric).
    """
    reach = 1 - how.similarity + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(_KEY)):
            bucket, across, i, j = (group.column(c)[0].as_py() for c in _KEY)
            left, node, component, n, far = (np.asarray(group.column(c)) for c in ("left", "node", "component", "n", "far"))
            bands = np.asarray(group.column("buckets").chunk(0).flatten()).reshape(len(node), -1)
            sets, weight = _arrays(group.column("runs"), np.uint64), _arrays(group.column("weights"), np.float64)
            joined, out = component.copy(), []
            one_side = not across and i == j
            first = np.arange(len(node)) if one_side else np.flatnonzero(left)
            second = first if one_side else np.flatnonzero(~left)
            for x in first:
                other = second[second > x] if one_side else second
                maybe = (joined[other] != joined[x]) & (np.abs(far[other] - far[x]) <= reach)
                if not how.weighted:
                    maybe &= np.minimum(n[other], n[x]) >= how.similarity * np.maximum(n[other], n[x]) - 1e-9
                other = other[maybe]
                if len(other):
                    other = other[bands[x][(bands[other] == bands[x]).argmax(axis=1)] == bucket]
                for y in other:
                    if joined[x] != joined[y] and _similarity(sets[x], weight[x], sets[y], weight[y]) >= how.similarity:
                        joined[joined == joined[y]] = joined[x]
                        out.append((node[x], node[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _across_components(shared: DataFrame, checked: DataFrame, components: DataFrame, unique: DataFrame, sets: DataFrame, how: NearCopies, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between different components of a bucket; None when no bucket has several that the leader hasn't met."""
    far = checked.select(F.col("a").alias("node"), F.col("b").alias("leader"), (1 - F.col("similarity")).alias("far"))
    members = shared.where("members > 2").join(far, ["node", "leader"], "left").join(components, "node", "left").join(unique.select("node", "n"), "node")
    members = scratch.cut(members.select("bucket", "node", F.coalesce("component", "node").alias("component"), F.coalesce("far", F.lit(0.0)).alias("far"), "n"), "members")
    size = members.groupBy("bucket", "component").agg(F.count("*").alias("nodes"), F.sum("n").alias("runs"))
    mixed = size.groupBy("bucket").agg(F.max(F.struct("nodes", "component", "runs")).alias("major"), F.count("*").alias("several"), F.sum("nodes").alias("nodes"), F.sum("runs").alias("runs")).where("several > 1")
    tiles = lambda nodes, runs_: F.ceil(F.greatest(nodes / how.tile, runs_ * 8 / how.tile_bytes)).cast("int")
    mixed = mixed.select("bucket", F.col("major.component").alias("major"), tiles(F.col("major.nodes"), F.col("major.runs")).alias("wide"), tiles(F.col("nodes") - F.col("major.nodes"), F.col("runs") - F.col("major.runs")).alias("high"))
    mixed = scratch.cut(mixed, "mixed")
    if not mixed.head(1):
        return None
    in_major = F.col("component") == F.col("major")
    dealt = members.join(mixed, "bucket").withColumn("left", in_major).withColumn("tile", F.pmod(F.xxhash64("node"), F.when(in_major, F.col("wide")).otherwise(F.col("high"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda across, i, j: F.struct(F.lit(across).alias("across"), i.alias("i"), j.alias("j"))
    tile = F.col("tile")
    meets = F.when(in_major, F.transform(every("high"), lambda o: place(True, tile, o))).otherwise(F.concat(F.transform(every("wide"), lambda o: place(True, o, tile)), F.transform(every("high"), lambda o: place(False, F.least(tile, o), F.greatest(tile, o)))))
    spread = dealt.select("bucket", F.explode(meets).alias("at"), "left", "tile", "node", "component", "n", "far")
    grid = spread.select("bucket", "at.across", "at.i", "at.j", F.when(F.col("at.across"), F.col("left")).otherwise(F.col("tile") == F.col("at.i")).alias("left"), "node", "component", "n", "far")
    grid = grid.join(unique.select("node", "buckets"), "node").join(sets, "node").select(*_GRID)
    return scratch.cut(grid.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_linking(how), "a bigint, b bigint").distinct(), "links")


def digest(text: str = "text") -> Column:
    """16 bytes that name a text; none for a null."""
    return F.coalesce(F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16), F.lit(b""))


def _no_word(text: str = "text") -> Column:
    return F.col(text).isNull() | ~F.col(text).rlike(r"[^\x20\x09-\x0D]")


def _decided(docs: DataFrame, how: NearCopies, scratch: Scratch) -> DataFrame:
    """doc_id, digest, class_id and first of each row with a doc_id and a word; first: it is the row (or one equal to it) that stands for its class."""
    bounded_batches(docs.sparkSession)
    addressed = docs.select("doc_id", digest().alias("digest"), "text")
    named = addressed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    signed = scratch.cut(named.mapInArrow(_signatures(how), "doc_id bigint, digest binary, k1 bigint, k2 bigint, n bigint, buckets array<bigint>"), "signatures")
    # equal sets are one node: a partial aggregate, so a group of copies of any size is small before the shuffle; written numbers are unique and stay
    unique = signed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "digest", "n", "buckets")).alias("one"))
    unique = scratch.cut(unique.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "one.*"), "nodes")
    placed = unique.select("node", F.explode("buckets").alias("bucket"))
    leaders = placed.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1")
    shared = scratch.cut(placed.join(leaders, "bucket").select("bucket", "node", "leader", "members"), "buckets")
    wanted = scratch.cut(unique.select("node", "doc_id", "digest").join(shared.select("node").distinct(), "node", "left_semi"), "wanted")
    # rows equal in doc_id and text give a node's text several times; one is kept before it moves
    text = match_written(addressed, wanted, ["doc_id", "digest"], "inner").groupBy("node").agg(F.min("text").alias("text"))
    sets = scratch.cut(text.select("node", "text").mapInArrow(_sets(how), "node bigint, runs binary, weights binary"), "run-sets")
    pairs = shared.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    checked = scratch.cut(_checked(pairs, sets), "checked")
    components = connected_components(checked.where(F.col("similarity") >= how.similarity), scratch)
    more = _across_components(shared, checked, components, unique, sets, how, scratch)
    if more is not None and more.head(1):
        # what the second pass links are components, so only these are joined further
        over = lambda side: components.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        joined = more.join(over("a"), "a", "left").join(over("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        above = connected_components(joined, scratch).select(F.col("node").alias("component"), F.col("component").alias("top"))
        alone = above.join(components.select("component"), "component", "left_anti").select(F.col("component").alias("node"), "top")
        components = components.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        components = scratch.cut(components.unionByName(alone.select("node", F.col("top").alias("component"))), "components")
    own = unique.select("node", "doc_id", "digest")
    best = own.join(components, "node").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("best"))
    best = components.join(best, "component").select("node", "best")
    chosen = unique.select("k1", "k2", "node", "doc_id", "digest").join(best, "node", "left").select("k1", "k2", F.coalesce("best", F.struct("doc_id", "digest")).alias("best"))
    rows = signed.select("doc_id", "digest", "k1", "k2").join(chosen, ["k1", "k2"])
    return rows.select("doc_id", "digest", F.col("best.doc_id").alias("class_id"), (F.struct("doc_id", "digest") == F.col("best")).alias("first"))


def near_copies(docs: DataFrame, how: NearCopies = NearCopies()) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept for every row.

    Two texts are linked when the similarity of their word runs is at least
    how.similarity; classes are the components of the links.  Words are what stands
    between ASCII white space, as it is.  kept: the row's text stands for its class, as
    that of the class's smallest doc_id does; of several such texts of one doc_id, one.
    Null texts and texts without a word link with nothing, and are kept.  Rows with a
    null doc_id have a null class and are kept.  Repeated rows each give a row, with the
    same class.  Rows that share a doc_id are classed by their own texts, so one doc_id
    can be in several classes, and classes that have it as the smallest share a number.
    Columns other than doc_id and text aren't read; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    alone = docs.where(F.col("doc_id").isNull() | _no_word()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    with Scratch(docs.sparkSession, "near-copies") as scratch:
        found = _decided(docs, how, scratch).select("doc_id", "class_id", F.col("first").alias("kept"))
        return cut(found.unionByName(alone), "classes")


def keep_one_of_each(docs: DataFrame, how: NearCopies = NearCopies()) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each class of texts (see near_copies).

    Rows that share a doc_id are compared by their texts like any others, so one stays of
    those with near texts and different texts all stay.  Of rows equal in doc_id and text
    one stays, which one is open; so it is with null texts and texts without a word.  Rows
    with a null doc_id all stay.  An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession, "near-copies") as scratch:
        rows = scratch.cut(_decided(docs.select("doc_id", "text"), how, scratch), "decided")
        dropped = cut(rows.where("NOT first").select("doc_id", "digest").distinct(), "dropped")
        blank = docs.where(F.col("doc_id").isNotNull() & _no_word()).select("doc_id", digest().alias("digest"))
        repeated = cut(rows.where("first").select("doc_id", "digest").unionByName(blank).groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"), "repeated")
    name = free_name(docs, "digest")
    on = ["doc_id", name]
    named = lambda df: df.select("doc_id", F.col("digest").alias(name))
    stays = match_written(docs.withColumn(name, digest()), named(dropped), on, "left_anti")
    if repeated.head(1):
        once = match_written(stays, named(repeated), on, "left_semi").dropDuplicates(on)
        stays = match_written(stays, named(repeated), on, "left_anti").unionByName(once)
    return stays.select(*[F.col(f"`{c}`") for c in docs.columns])
