"""Quality rules: measured base rules, and a hashed n-gram logistic regression with calibrated probability.

All measures are taken on whole texts, a slice of a batch at a time (see textvec).  The
classifier reads mean weights of hashed words, hashed pairs of words and hashed runs of
three characters; it is trained on labelled quality rows and calibrated on labelled rows kept apart.  Fixed
thresholds decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.linear import fit_logistic, fit_platt, give_back, held_out, labelled_sample, sigmoid, summed_by
from tidemark.llm.storage import bounded_batches
from tidemark.llm.textvec import Texts, repeated, slices, windows

#: The base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: A text is kept when its probability of good quality is at least this.
MIN_PROBABILITY = 0.3
BUCKETS = 1 << 18
GRAM = 3
#: Means over a text are small numbers; this brings a weight's effect to the order of 1.
SCALE = 20.0


@dataclass(frozen=True)
class Training:
    """docs: labelled texts at most, of at most max_chars each; a `calibrate` share of them is kept for calibration."""

    docs: int = 2500
    max_chars: int = 20_000
    calibrate: float = 0.25
    steps: int = 80


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, t: Texts) -> np.ndarray:
        doc, feature, value = entries(t)
        raw = np.bincount(doc, value * self.weights[feature], t.n) + self.bias
        return sigmoid(self.a * raw + self.b)


def entries(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of each word, each pair of words and each run of GRAM characters; words and pairs use the first half of the buckets."""
    start, end, doc = t.words()
    hashes = t.hashes(start, end)
    first_word, pair = windows(hashes, doc, 2)
    word = (np.concatenate([hashes, pair]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    doc = np.concatenate([doc, doc[first_word]])
    n = np.maximum(np.bincount(doc, minlength=t.n), 1)
    lead = np.flatnonzero((t.data & 0xC0) != 0x80)
    first, last = lead[:-GRAM], lead[GRAM:]
    lead_doc = t.doc_of(first)
    inside = last <= t.doc_end[lead_doc] if t.n else np.empty(0, bool)
    first, last, lead_doc = first[inside], last[inside], lead_doc[inside]
    gram = (t.hashes(first, last) & np.uint64(BUCKETS - 1)).astype(np.int64) + BUCKETS
    grams = np.maximum(np.bincount(lead_doc, minlength=t.n), 1)
    return np.concatenate([doc, lead_doc]), np.concatenate([word, gram]), np.concatenate([SCALE / n[doc], SCALE / grams[lead_doc]])


def summed(texts: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of texts, text, bucket, value): entries summed by text and bucket, a small slice of texts at a time, so that the driver never holds one for each character."""
    docs, features, values = [], [], []
    for at, part in slices(pa.array(texts, pa.large_string()), 1 << 17):
        doc, feature, value = entries(Texts(part))
        pair, inverse = np.unique(doc * (2 * BUCKETS) + feature, return_inverse=True)
        docs.append((at + pair // (2 * BUCKETS)).astype(np.int32))
        features.append((pair % (2 * BUCKETS)).astype(np.int32))
        values.append(np.bincount(inverse, value, len(pair)))
    columns = []
    for parts in (docs, features, values):
        columns.append(np.concatenate(parts))
        parts.clear()
    return len(texts), *columns


def measures(t: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    start, end, doc = t.words()
    lead = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum((t.data & 0xC0) != 0x80, out=lead[1:])
    word_chars = np.bincount(doc, lead[end] - lead[start], t.n).astype(np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    # lines: the byte after each text is a newline, so every line ends at one
    stop = np.flatnonzero(t.data == 10)
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    words_before = np.searchsorted(start, np.stack([begin, stop])) if len(stop) else np.zeros((2, 0), int)
    worded = words_before[1] > words_before[0]
    begin, stop = begin[worded], stop[worded]
    line_doc = t.doc_of(begin)
    _, earlier = repeated(line_doc, t.identities(begin, stop))
    n_dup = np.bincount(line_doc, earlier, t.n).astype(np.int64)
    first, h = windows(t.identities(start, end), doc, REPEAT_WINDOW)
    twice, _ = repeated(doc[first], h)
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": np.bincount(doc, minlength=t.n).astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": t.per_doc(is_symbol[t.data]),
        "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(doc, covered, t.n).astype(np.int64),
    }


def train(rows: list[tuple[str, int]], how: Training = Training()) -> QualityModel | None:
    """None when the rows don't show both labels, so that there is nothing to learn: then only the base rules decide. When a share of them kept apart wouldn't show both, all rows serve for both purposes."""
    y = np.array([label for _, label in rows], float)
    if not len(rows) or y.min() == y.max():
        return None
    apart = np.random.default_rng(3).random(len(rows)) < how.calibrate
    if min(y[~apart].sum(), (1 - y[~apart]).sum()) < 2 or y[apart].min(initial=1) == y[apart].max(initial=0):
        apart[:] = False
    part = lambda keep: summed([rows[i][0] for i in np.flatnonzero(keep)])
    n, doc, feature, value = part(~apart)
    w, bias = fit_logistic(doc, feature, value, n, 2 * BUCKETS, y[~apart], steps=how.steps, rate=0.05, l2=1e-6)
    keep = apart if apart.any() else ~apart
    del doc, feature, value
    n, doc, feature, value = part(keep)
    a, b = fit_platt(summed_by(doc, feature, value, w, n) + bias, y[keep])
    return QualityModel(w.astype(np.float32), bias, a, b)


def train_on(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> QualityModel | None:
    """Learns from rows that are not held out, as the other classifiers do."""
    model = train(labelled_sample(docs, labels, "quality", how.docs, how.max_chars, ~held_out()), how)
    give_back()
    return model


def _shared(docs: DataFrame, model: QualityModel | None):
    bounded_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: one weight per bucket


def _verdicts(texts: pa.Array, model: QualityModel | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(measures, base failed, probability) of each text."""
    t = Texts(texts)
    m = measures(t)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return m, failed, model.probability(t) if model is not None else np.ones(t.n)


def judge(docs: DataFrame, model: QualityModel | None, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, the measures, base_failed, probability and kept for every row.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT of the words stand
    in repeated windows.  kept: not base_failed, and the probability is high enough (or
    there is no model).  Null and empty texts have no words and fail.  Repeated rows each
    give a row; columns other than doc_id and text aren't read; an empty table gives an
    empty result.
    """
    shared = _shared(docs, model)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                m, failed, p = _verdicts(texts, shared.value)
                columns = [batch.column(0).slice(at, len(texts)), *(pa.array(m[k], pa.int64()) for k in names[1:6]), pa.array(failed), pa.array(~failed & (p >= min_probability)), pa.array(p.astype(float))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, model: QualityModel | None, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The rows of docs, with all their columns, that `judge` keeps.

    Null and empty texts go, a null doc_id makes no difference, repeated rows go or stay
    alike, and an empty table gives an empty result.
    """
    shared, at_text = _shared(docs, model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(at_text)):
                _, failed, p = _verdicts(texts, shared.value)
                yield batch.slice(at, len(texts)).filter(pa.array(~failed & (p >= min_probability)))

    return docs.mapInArrow(keep, docs.schema)
