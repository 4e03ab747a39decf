"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions, over words and lines alike, and gives
every position log-probabilities of the languages; a text's probability pools all its
positions.  Long texts are read in windows that overlap: each window's core follows the
last one's, and a margin on either side gives the states their context, so every position
is labelled once, with at least MARGIN bytes of the text before and after it.  The network
is trained here, in numpy, by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear import give_back, held_out
from tidemark.llm.storage import bounded_batches
from tidemark.llm.textvec import Texts, slices

UNKNOWN = "und"
#: Bytes of a window's core and of its margins, and windows that are read at once.
CORE, MARGIN, TOGETHER = 160, 12, 1024
#: A text's evidence is that of at most so many positions: positions of one text are far from independent.
SHARP = 40


@dataclass(frozen=True)
class Training:
    """docs: labelled texts at most, of at most max_chars; steps of batch windows drawn from them."""

    docs: int = 3000
    max_chars: int = 20_000
    hidden: int = 12
    embed: int = 12
    steps: int = 300
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteGRU:
    """Parameters by name; arrays are float32 [.., batch, width]."""

    def __init__(self, classes: int, hidden: int, embed: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"emb": draw(256, embed) * 4, "out": draw(2 * hidden, classes), "bias": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(embed, 3 * hidden), f"u{d}": draw(hidden, 2 * hidden), f"v{d}": draw(hidden, hidden), f"c{d}": np.zeros(3 * hidden, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, np.ndarray]:
        """States after each position of x [time, batch, 3h], where mask is 0 the state stays; and for learning, by position, the state before, both gates and the new state."""
        h, p, steps = self.h, self.p, x.shape[0]
        state = np.zeros((x.shape[1], h), np.float32)
        out, saved = np.empty((steps, x.shape[1], h), np.float32), np.empty((4, steps, x.shape[1], h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            zr = _sigmoid(x[t, :, : 2 * h] + state @ p[f"u{d}"])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + (r * state) @ p[f"v{d}"])
            saved[0, t], saved[1, t], saved[2, t], saved[3, t] = state, z, r, n
            state = out[t] = state + mask[t][:, None] * z * (n - state)
        return out, saved

    def forward(self, bytes_: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """Log-probabilities [time, batch, classes] of bytes_ [time, batch], and what learning needs."""
        p = self.p
        emb = p["emb"][bytes_]
        saved, both = {"emb": emb}, []
        for d in "fb":
            out, saved[d] = self._run(emb @ p[f"w{d}"] + p[f"c{d}"], mask, d)
            both.append(out)
        hidden = np.concatenate(both, axis=2)
        logits = hidden @ p["out"] + p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
        saved["hidden"] = hidden
        return logp, saved

    def read(self, bytes_: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """forward's log-probabilities, without what learning needs. mask None: all ones.

        Widths come before the batch here, so that every operation runs along the batch, in
        buffers that are used again; signs and factors of the exponents stand in the weights.
        """
        p, h, (steps, n) = self.p, self.h, bytes_.shape
        logits = np.broadcast_to(p["bias"][:, None], (steps, len(p["bias"]), n)).copy()
        zr, new, reset, x = (np.empty((k * h, n), np.float32) for k in (2, 1, 1, 3))
        for i, d in enumerate("fb"):
            table = (p["emb"] @ p[f"w{d}"] + p[f"c{d}"]) * np.repeat(np.float32([-1, -1, -2]), h)
            u, v = np.ascontiguousarray(-p[f"u{d}"].T), np.ascontiguousarray(-2 * p[f"v{d}"].T)
            state, out = np.zeros((h, n), np.float32), np.empty((steps, h, n), np.float32)
            with np.errstate(over="ignore"):  # an infinite exponential is a gate of 0, or a state of -1
                for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                    x[:] = table[bytes_[t]].T
                    np.matmul(u, state, out=zr)
                    zr += x[: 2 * h]
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    np.multiply(zr[h:], state, out=reset)
                    np.matmul(v, reset, out=new)
                    new += x[2 * h :]
                    np.exp(new, out=new)
                    new += 1
                    np.divide(2, new, out=new)
                    new -= 1
                    new -= state
                    new *= zr[:h]
                    if mask is not None:
                        new *= mask[t]
                    state = np.add(state, new, out=out[t])
            logits += np.matmul(np.ascontiguousarray(p["out"][i * h : (i + 1) * h].T), out)
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return np.moveaxis(logits, 1, 2)

    def gradients(self, bytes_: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions, and its gradients by backpropagation through time."""
        p, h = self.p, self.h
        logp, saved = self.forward(bytes_, mask)
        n = max(1.0, float(mask.sum()))
        classes = np.arange(p["bias"].shape[0])
        target = (label[None, :, None] == classes).astype(np.float32)
        loss = float(-(logp * target).sum(axis=2)[mask > 0].sum() / n)
        d_logits = (np.exp(logp) - target) * mask[:, :, None] / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = np.einsum("tbh,tbc->hc", saved["hidden"], d_logits, optimize=True)
        g["bias"] = d_logits.sum((0, 1))
        d_hidden = d_logits @ p["out"].T
        d_emb = np.zeros_like(saved["emb"])
        flat = lambda a: a.reshape(-1, a.shape[-1])
        m = mask[:, :, None]
        for i, d in enumerate("fb"):
            state, z, r, c = saved[d]
            u, v = np.ascontiguousarray(p[f"u{d}"].T), np.ascontiguousarray(p[f"v{d}"].T)
            to_z, to_r, to_c, stays = m * (c - state) * z * (1 - z), state * r * (1 - r), m * z * (1 - c * c), 1 - m * z
            d_out, carry = d_hidden[:, :, i * h : (i + 1) * h], np.float32(0)
            dx = np.empty((*bytes_.shape, 3 * h), np.float32)
            for t in range(len(bytes_) - 1, -1, -1) if d == "f" else range(len(bytes_)):
                d_new, at = carry + d_out[t], dx[t]
                at[:, 2 * h :] = d_new * to_c[t]
                d_rs = at[:, 2 * h :] @ v
                at[:, :h], at[:, h : 2 * h] = d_new * to_z[t], d_rs * to_r[t]
                carry = d_new * stays[t] + d_rs * r[t] + at[:, : 2 * h] @ u
            g[f"u{d}"] = flat(state).T @ flat(dx[:, :, : 2 * h])
            g[f"v{d}"] = flat(r * state).T @ flat(dx[:, :, 2 * h :])
            g[f"w{d}"] = flat(saved["emb"]).T @ flat(dx)
            g[f"c{d}"] = dx.sum((0, 1))
            d_emb += dx @ p[f"w{d}"].T
        np.add.at(g["emb"], bytes_, d_emb)
        return loss, g


@dataclass
class LanguageModel:
    languages: list[str]
    net: ByteGRU | None
    prior: np.ndarray

    def pooled(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the sum over all its positions of their log-probabilities, and their number."""
        start, stop, begin, end, doc = windows(t)
        out = np.zeros((t.n, len(self.languages)))
        order = np.argsort(stop - start, kind="stable")
        for at in range(0, len(order), TOGETHER):
            rows = order[at : at + TOGETHER]
            bytes_, mask = padded(t.data, start[rows], stop[rows])
            logp = self.net.read(bytes_, None if mask.all() else mask)
            place = np.arange(len(bytes_))[:, None] + start[rows]
            core = (place >= begin[rows]) & (place < end[rows])
            np.add.at(out, doc[rows], np.einsum("tbc,tb->bc", logp, core.astype(np.float32)))
        return out, t.doc_end - t.doc_start


def padded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    time = np.arange(int((end - start).max()))[:, None]
    mask = time < (end - start)[None, :]
    return np.where(mask, data[np.minimum(start[None, :] + time, len(data) - 1)], 0), mask.astype(np.float32)


def windows(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, start of the core, end of the core, text number) of the windows of all texts that aren't empty."""
    size = t.doc_end - t.doc_start
    number = -(-size // CORE)
    doc = np.repeat(np.arange(t.n), number)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    begin = t.doc_start[doc] + nth * CORE
    end = np.minimum(begin + CORE, t.doc_end[doc])
    return np.maximum(begin - MARGIN, t.doc_start[doc]), np.minimum(end + MARGIN, t.doc_end[doc]), begin, end, doc


def train(texts: list[str], labels: list[str], how: Training = Training()) -> LanguageModel:
    """Fit on (text, language) pairs; windows are drawn alike from each language. Texts without a word teach nothing, nor does a language that has no others."""
    t = Texts(pa.array(texts, pa.large_string()))
    start, end, _, _, doc = windows(t)
    # a slice at a time: the places of all words would take many times the texts' own memory
    worded_docs = np.concatenate([np.empty(0, int), *(at + np.unique(Texts(part).words()[2]) for at, part in slices(pa.array(texts, pa.large_string()), 1 << 18))])
    used = np.isin(doc, worded_docs)
    start, end, doc = start[used], end[used], doc[used]
    worded = [labels[i] for i in np.unique(doc)]
    languages = sorted(set(worded))
    counts = np.array([worded.count(x) for x in languages], float)
    prior = counts / max(1.0, counts.sum())
    if len(languages) < 2:
        return LanguageModel(languages, None, prior)
    rng = np.random.default_rng(how.seed)
    y = np.array([languages.index(x) if x in languages else -1 for x in labels])[doc]
    pools = [np.flatnonzero(y == c) for c in range(len(languages))]
    net = ByteGRU(len(languages), how.hidden, how.embed, how.seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, how.steps + 1):
        rows = np.concatenate([rng.choice(x, how.batch // len(pools) + 1) for x in pools])
        bytes_, mask = padded(t.data, start[rows], end[rows])
        _, g = net.gradients(bytes_, mask, y[rows])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = how.rate * min(1.0, step / 30) * (1 - step / (how.steps + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for k, v in g.items():
            v = v / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net.p[k] = (net.p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)
    return LanguageModel(languages, net, prior)


def score_texts(m: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, probability) of each text."""
    t = Texts(texts)
    total, count = m.pooled(t) if m.net is not None else (np.zeros((t.n, len(m.languages))), np.zeros(t.n))
    mean = total / np.maximum(count, 1)[:, None] * np.minimum(count, SHARP)[:, None] + 1e-9 * np.log(np.maximum(m.prior, 1e-12))
    mean -= mean.max(axis=1, keepdims=True) if len(m.languages) else 0
    prob = np.exp(mean)
    prob /= prob.sum(axis=1, keepdims=True)
    best = prob.argmax(axis=1) if len(m.languages) else np.zeros(t.n, int)
    names, score = [], np.zeros(t.n)
    for i, text in enumerate(texts):
        letters = text.is_valid and len(m.languages) and any(map(str.isalpha, text.as_py()))
        names.append(m.languages[best[i]] if letters else UNKNOWN)
        score[i] = prob[i, best[i]] if letters else 0.0
    return names, score


def training_sample(docs: DataFrame, how: Training) -> tuple[list[str], list[str]]:
    """At most how.docs labelled texts with a word, those whose ids have the smallest hashes."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]") & ~held_out() & (F.length("text") <= how.max_chars))
    ids = known.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(how.docs).select("doc_id").distinct()
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def train_on(docs: DataFrame, how: Training = Training()) -> LanguageModel:
    model = train(*training_sample(docs, how), how)
    give_back()
    return model


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from its whole text.

    Null texts and texts without a letter are `und` with score 0, as is every text when no
    language could be learned.  Repeated rows each give a row; columns other than doc_id,
    text and (for learning) lang aren't read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = model or train_on(docs)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                names, score = score_texts(model, texts)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(label, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: LanguageModel | None = None, languages: tuple[str, ...] | None = None, min_score: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that are in one of `languages` (None: any learned one) with at least min_score.

    Null texts and texts without a letter go, as do all when no language could be
    learned.  Repeated rows go or stay alike, a null doc_id makes no difference, and an
    empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = model or train_on(docs)
    at_text = docs.columns.index("text")
    wanted = set(model.languages if languages is None else languages)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(at_text)):
                names, score = score_texts(model, texts)
                mask = [n in wanted and s >= min_score for n, s in zip(names, score, strict=True)]
                yield batch.slice(at, len(texts)).filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
