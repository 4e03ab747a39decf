"""Toxicity scores by weak supervision.

Many voters look at a text: seed lexicons, patterns, and words and word beginnings that
labelled rows mine (inflected forms share a beginning).  A generative label model (two
classes; within a class the voters form a tree, so strongly correlated voters aren't
counted twice) is fitted by expectation maximisation to the votes on labelled and
unlabelled texts: it gives each voter's accuracies, the correlations, and a posterior for
each text.  A label is no vote: labels say which class is which, by where the fit starts
and by a prior on the voters' accuracies.  A linear classifier over the words and
beginnings present is trained on the posteriors and scores whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear import fit_logistic, held_out, labelled_sample, sigmoid
from tidemark.llm.storage import bounded_batches
from tidemark.llm.textvec import Texts, mix, slices, windows

#: Seed lexicons; each is one voter, and each of its words another.
LEXICONS = {
    "insult": "idiot moron fool imbecile dumbass jerk clown loser scum creep coward liar".split(),
    "contempt": "stupid pathetic worthless disgusting useless trash garbage filthy vile despicable".split(),
    "hostility": "hate kill destroy die shut ugly sick evil".split(),
}


@dataclass(frozen=True)
class Training:
    """docs, unlabelled: labelled and other texts at most, of at most max_chars each; anchor: rows that the voters' accuracies on labelled rows count for in the label model; mined: word voters at most; features: words of the classifier at most, each this many standard errors (surety) from even odds."""

    docs: int = 4000
    unlabelled: int = 2000
    max_chars: int = 20_000
    anchor: float = 200.0
    mined: int = 160
    features: int = 1000
    surety: float = 3.0
    rounds: int = 15


class Words(Texts):
    """Lower-cased runs of letters and digits as words; upper-case letters are counted first."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        self.upper = self.per_doc((self.data >= 65) & (self.data <= 90))
        self.bangs = self.per_doc(self.data == 33)
        self.letters = self.per_doc(_WORD[self.data])
        self.data = _LOWER[self.data]
        edge = np.diff(_WORD[self.data].astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = self.doc_of(self.start)
        self.hash = self.hashes(self.start, self.end)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, hash) of the words, then of their beginnings of each length in PREFIXES, where the word is longer."""
        yield self.doc, self.hash
        lead = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        at = np.searchsorted(lead, self.start)
        for k in PREFIXES:
            stop = lead[np.minimum(at + k, len(lead) - 1)]
            longer = stop < self.end
            yield self.doc[longer], self.hashes(self.start[longer], stop[longer]) ^ _BEGINNING

    def present(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature hash), each once."""
        parts = list(self.features())
        doc, hash_ = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((hash_, doc))
        d, h = doc[order], hash_[order]
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        return d[first], h[first]


PREFIXES = (4, 5, 6, 7, 8)
_BEGINNING = np.uint64(0xA5A5_5A5A_0F0F_F0F0)
_LOW = np.uint64(0xFFFF)
_NONE = np.uint64(np.iinfo(np.uint64).max)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(words: list[str]) -> np.ndarray:
    return Words(pa.array(words, pa.large_string())).hash


@dataclass
class Corpus:
    """What is learned from of n texts: (doc, hash) of each feature present, once for each text; votes of the patterns; and a weight of 1/size for each member of a family of near copies."""

    n: int
    doc: np.ndarray
    hash: np.ndarray
    patterns: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Corpus:
        """Read in small slices, so that the driver holds no entry for each word of all texts."""
        docs, hashes, patterns, lows = [], [], [], []
        for at, part in slices(pa.array(texts, pa.large_string()), 1 << 18):
            t = Words(part)
            doc, h = t.present()
            docs.append((doc + at).astype(np.int32))
            hashes.append(h)
            patterns.append(pattern_votes(t))
            lows.append(family_marks(t))
        low, size = np.concatenate(lows), np.ones(len(texts))
        for k in range(low.shape[1]):
            _, inverse, count = np.unique(low[:, k], return_inverse=True, return_counts=True)
            size = np.maximum(size, np.where(low[:, k] == _NONE, 1, count[inverse]))
        return cls(len(texts), np.concatenate(docs), np.concatenate(hashes), np.concatenate(patterns), 1 / size)


def family_marks(t: Words) -> np.ndarray:
    """[texts, 4]: minima over hashed word runs, which near copies often share; _NONE for texts without a run."""
    first, h = windows(t.hash, t.doc, 5)
    low = np.full((t.n, 4), _NONE, np.uint64)
    for seed in range(4):
        np.minimum.at(low[:, seed], t.doc[first], mix(h ^ np.uint64(0x51ED270B * (seed + 1))))
    return low


def mine_words(c: Corpus, y: np.ndarray, weight: np.ndarray, most: int) -> list[int]:
    """Hashes of the words that most surely stand more often in rows labelled toxic: by the log odds ratio less a standard error. Weak ones are let in: the label model estimates what they are worth."""
    keys, inverse = np.unique(c.hash, return_inverse=True)
    pos = np.bincount(inverse, (weight * y)[c.doc], len(keys))
    neg = np.bincount(inverse, (weight * (1 - y))[c.doc], len(keys))
    all_pos, all_neg = (weight * y).sum(), (weight * (1 - y)).sum()
    ratio = np.log((pos + 0.5) / (all_pos - pos + 0.5)) - np.log((neg + 0.5) / (all_neg - neg + 0.5))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5) + 1 / (all_pos - pos + 0.5) + 1 / (all_neg - neg + 0.5))
    low = ratio - error
    best = np.argsort(-low, kind="stable")[:most]
    return [int(keys[i]) for i in best if low[i] > 0.5 and pos[i] >= 2]


@dataclass
class LabelModel:
    """P(vote | class, parent's vote) for binary voters with a tree within each class, and the class prior."""

    prior: float = 0.1
    parent: np.ndarray = field(default_factory=lambda: np.empty(0, int))
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 2, 2)))  # voter, class, parent's vote -> P(fires)

    def fires(self, votes: np.ndarray, i: int) -> np.ndarray:
        """[class, row]: P(voter i votes as it did | class, its parent's vote)."""
        p = self.parent[i]
        given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
        on = self.table[i][:, given]
        return np.where(votes[:, i] == 1, on, 1 - on)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) of rows of votes [rows, voters] of 0/1."""
        score = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for i in range(votes.shape[1]):
            like = self.fires(votes, i)
            score += np.log(like[1]) - np.log(like[0])
        return sigmoid(score)

    def rates(self) -> np.ndarray:
        """[voter, class]: P(the voter fires | class), summed along the tree."""
        out = np.full((len(self.parent), 2), np.nan)

        def rate(i: int) -> np.ndarray:
            if np.isnan(out[i]).any():
                up = rate(self.parent[i]) if self.parent[i] >= 0 else np.zeros(2)
                out[i] = self.table[i][:, 1] * up + self.table[i][:, 0] * (1 - up)
            return out[i]

        for i in range(len(out)):
            rate(i)
        return out


def voter_tree(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1: root) in the maximum spanning tree of mutual information given the class."""
    n, info = votes.shape[1], 0.0
    for weight in (q, 1 - q):
        total = weight.sum() + 2.0
        both = (votes.T * weight) @ votes
        one = np.diag(both)
        p11, p1 = (both + 0.5) / total, (one + 1.0) / total
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = (p1 if a else 1 - p1)[:, None], (p1 if b else 1 - p1)[None, :]
                joint = {(1, 1): p11, (1, 0): p1[:, None] - p11, (0, 1): p1[None, :] - p11, (0, 0): 1 - p1[:, None] - p1[None, :] + p11}[a, b]
                joint = np.maximum(joint, 1e-9)
                info = info + weight.sum() / len(votes) * joint * np.log(joint / (pa_ * pb))
    parent, best, link, left = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1), set(range(n))
    at = 0
    while left:
        left.discard(at)
        for j in left:
            if info[at, j] > best[j]:
                best[j], link[j] = info[at, j], at
        if left:
            at = max(left, key=lambda j: best[j])
            parent[at] = link[at] if best[at] > 1e-3 else -1
    return parent


def fit_label_model(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int, anchor: float) -> tuple[LabelModel, np.ndarray]:
    """(model, posteriors) by expectation maximisation over the votes of all rows.

    label: 0, 1 or -1 for none.  Labels aren't votes: the first step counts the labelled
    rows alone, which names the classes, and its accuracies and class shares are a prior
    worth `anchor` rows of each class in later steps.
    """
    seen = label >= 0
    start, model = np.where(seen, label, 0).astype(float), LabelModel()
    model.parent = voter_tree(votes[seen], start[seen])
    rate = float(np.clip((weight[seen] @ start[seen] + 1) / (weight[seen].sum() + 4), 0.005, 0.5))
    q, prior = start, None
    for step in range(rounds + 1):
        counted = weight * seen if step == 0 else weight
        table = np.empty((votes.shape[1], 2, 2))
        for i, p in enumerate(model.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            for c, w in ((0, counted * (1 - q)), (1, counted * q)):
                overall = (w @ votes[:, i] + 0.1) / (w.sum() + 2)
                for g in (0, 1):
                    on = w * (given == g)
                    held, strength = (overall, 2.0) if prior is None else (prior[i, c, g], anchor * share[i, c, g])
                    table[i, c, g] = (on @ votes[:, i] + strength * held) / (on.sum() + strength)
        model.table = np.clip(table, 1e-4, 1 - 1e-4)
        model.prior = rate if step == 0 else float(np.clip((counted @ q + anchor * rate) / (counted.sum() + anchor), 0.005, 0.5))
        if prior is None:
            # an anchor row has its parent's vote as often as labelled rows do
            prior, share = model.table, np.ones((votes.shape[1], 2, 2))
            up = model.rates()
            for i, p in enumerate(model.parent):
                if p >= 0:
                    share[i, :, 1], share[i, :, 0] = up[p], 1 - up[p]
            share = np.maximum(share, 0.01)
        q = model.posterior(votes)
    return model, q


@dataclass
class ToxicityModel:
    buckets: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float

    def score(self, t: Words) -> np.ndarray:
        total = np.full(t.n, self.bias)
        n, pairs = len(self.buckets), []
        if n:
            maybe = np.zeros(1 << 16, bool)  # a quick test of 16 bits before the search
            maybe[self.buckets & _LOW] = True
            for doc, h in t.features():
                likely = np.flatnonzero(maybe[h & _LOW])
                slot = np.minimum(np.searchsorted(self.buckets, h[likely]), n - 1)
                hit = self.buckets[slot] == h[likely]
                pairs.append(doc[likely[hit]] * n + slot[hit])
            pair = np.unique(np.concatenate(pairs))
            total += np.bincount(pair // n, self.weights[pair % n], t.n)
        return sigmoid(total)


def pattern_votes(t: Words) -> np.ndarray:
    """[texts, 3]: many exclamation marks; shouting; "you ..." before a seed word."""
    words = np.maximum(np.bincount(t.doc, minlength=t.n), 1)
    votes = np.zeros((t.n, 3), np.int8)
    votes[:, 0] = t.bangs > 0.05 * words
    votes[:, 1] = t.upper > 0.5 * np.maximum(t.letters, 20)
    seeds = np.concatenate([word_hashes(words) for words in LEXICONS.values()])
    you = np.isin(t.hash, word_hashes(["you", "your", "youre"]))
    near = you[:-1] & np.isin(t.hash[1:], seeds) & (t.doc[1:] == t.doc[:-1])
    votes[t.doc[:-1][near], 2] = 1
    return votes


def vote(c: Corpus, mined: list[int]) -> np.ndarray:
    """[texts, voters] of 0/1: seed words, whole lexicons, mined words, patterns."""
    names = [np.unique(word_hashes([w])) for words in LEXICONS.values() for w in words]
    names += [np.unique(word_hashes(words)) for words in LEXICONS.values()]
    names += [np.array([h], np.uint64) for h in mined]
    any_ = np.isin(c.hash, np.concatenate(names))
    doc, h = c.doc[any_], c.hash[any_]
    votes = np.zeros((c.n, len(names)), np.int8)
    for i, known in enumerate(names):
        votes[doc[np.isin(h, known)], i] = 1
    return np.concatenate([votes, c.patterns], axis=1)


def posteriors(c: Corpus, label: np.ndarray, weight: np.ndarray, how: Training) -> tuple[LabelModel, np.ndarray, np.ndarray]:
    """(label model, votes, posteriors) of texts with labels 0, 1 or -1 for none."""
    seen = label >= 0
    votes = vote(c, mine_words(c, np.maximum(label, 0), weight * seen, how.mined))
    votes = votes[:, votes[seen].sum(0) >= 2]
    model, q = fit_label_model(votes, label, weight, how.rounds, how.anchor)
    return model, votes, q


def train(rows: list[tuple[str, int]], how: Training = Training(), more: list[str] | None = None) -> ToxicityModel:
    """rows: (text, label); more: texts without a label. Without rows of both labels only the seed lexicons speak: there is nothing to learn from."""
    seeds = np.unique(np.concatenate([word_hashes(words) for words in LEXICONS.values()]))
    y = np.array([int(label > 0) for _, label in rows])
    if not len(rows) or y.min() == y.max():
        return ToxicityModel(seeds, np.full(len(seeds), 3.0), -4.0)
    # each seed word is a short text without a label: the classifier hears of words that no labelled row has
    alone = [w for words in LEXICONS.values() for w in words]
    texts = [text for text, _ in rows] + (more or [])
    c = Corpus.of(texts + alone)
    label = np.concatenate([y, np.full(len(more or []), -1), np.full(len(alone), -1)])
    weight, real, doc = c.weight, np.arange(c.n) < len(texts), c.doc
    _, _, q = posteriors(c, label, weight * real, how)
    q[~real] = 0.9
    keys, inverse = np.unique(c.hash, return_inverse=True)
    pos, neg = np.bincount(inverse, (weight * q)[doc]), np.bincount(inverse, (weight * (1 - q))[doc])
    odds = np.log((pos + 1) / ((weight * q).sum() + 2)) - np.log((neg + 1) / ((weight * (1 - q)).sum() + 2))
    strength = np.where(pos + neg >= 2, np.abs(odds) / np.sqrt(1 / (pos + 1) + 1 / (neg + 1)), 0)
    chosen = np.argsort(-strength)[: how.features]
    chosen = np.sort(chosen[strength[chosen] > how.surety])
    place = np.full(len(keys), -1)
    place[chosen] = np.arange(len(chosen))
    used = place[inverse] >= 0
    w, bias = fit_logistic(doc[used], place[inverse[used]], np.ones(int(used.sum())), c.n, len(chosen), q, weight, steps=300, rate=0.1, l2=1e-4)
    return ToxicityModel(keys[chosen], w, bias)


def train_on(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> ToxicityModel:
    """Learns from labelled rows that aren't held out, and from texts of others: those whose ids have the smallest hashes, held out or labelled ones left out."""
    rows = labelled_sample(docs, labels, "toxic", how.docs, how.max_chars, ~held_out())
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.length("text") <= how.max_chars))
    first = texts.select("doc_id", F.xxhash64("doc_id").alias("h")).join(known, "doc_id", "left_anti").orderBy("h", "doc_id").limit(how.unlabelled).select("doc_id").distinct()
    more = texts.select("doc_id", "text").join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return train(rows, how, [r["text"] for r in more])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, from its whole text.

    Null and empty texts score as a text without words.  Repeated rows each give a row;
    columns other than doc_id and text aren't read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                s = model.score(Words(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(s)), batch.column(1).slice(at, len(s)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
