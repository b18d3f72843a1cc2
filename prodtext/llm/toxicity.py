"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct words of a text and their beginnings of four and five letters, hashed.
The machine adds to a weight for each term the inner product of the factors of each pair
of terms, so two terms can count together (an insult with a mention of a group) that say
little alone.  It is fitted by AdaGrad on logistic loss; a logistic link, fitted to a part
of the sample that the machine did not see, both labels weighing the same, gives scores.

The machine's terms are those that tell the labels apart by themselves and, where these leave
errors on the part not seen, also the terms of pairs whose co-occurrence differs between the
labels, however neutral each of them is alone; they stay if that lowers the loss on that part.

The fit uses a bounded sample of labelled rows (``per_class`` of each label); scoring reads
every whole text and nothing else.

Defined results: null and empty texts have no terms and score as the bias says; without rows
of both labels every score is the share of label 1 (0.5 without any); repeated rows are
scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodtext.llm.common import WORDS_HELD, ship
from prodtext.llm.decontamination import words_of
from prodtext.llm.labelled import class_counts, collect_features, logistic, platt, sampled_labels, score_column, scored

def buckets(word: bytes, bits: int) -> tuple[int, ...]:
    """A word's hashed terms: itself and its first four and five letters (the start value of
    the checksum tells the kinds apart)."""
    mask, crc = (1 << bits) - 1, zlib.crc32
    if word.isascii():
        size, four, five = len(word), word[:4], word[:5]
    else:
        w = word.decode("utf-8", "replace")
        size, four, five = len(w), w[:4].encode("utf-8", "replace"), w[:5].encode("utf-8", "replace")
    if size < 4:
        return (crc(word, 1) & mask,)
    if size < 5:
        return crc(word, 1) & mask, crc(four, 4) & mask
    return crc(word, 1) & mask, crc(four, 4) & mask, crc(five, 5) & mask


def terms(text: str, bits: int, slots: dict[int, int] | None = None, memo: dict[bytes, tuple[int, ...]] | None = None) -> np.ndarray:
    """Sorted distinct buckets of the text's terms, or the slots of those that have one.
    ``memo`` holds what words gave before, for the same ``bits`` and ``slots``."""
    memo, found = {} if memo is None else memo, set()
    for w in set(words_of(text.lower().encode("utf-8", "replace"))):
        t = memo.get(w)
        if t is None:
            if len(memo) >= WORDS_HELD:  # bounds a worker's memory
                memo.clear()
            t = buckets(w, bits)
            t = t if slots is None else tuple(slots[x] for x in t if x in slots)
            if len(w) <= 64:
                memo[w] = t
        if t:
            found.update(t)
    return np.array(sorted(found), dtype=np.int32)


def select_terms(rows: list[np.ndarray], y: np.ndarray, most: int, least_z: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose shares of documents differ most between the labels, by z-score, and
    the value each enters the machine with: its log ratio of shares, a ratio of e^2 or more
    counting 1.  The noise of thousands of neutral pairs in a long text would
    outweigh a few telling ones, and so would common words that lean to one label a little."""
    n1, n0 = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    every, place = np.unique(np.concatenate([np.empty(0, np.int64), *rows]), return_inverse=True)
    label = np.repeat(y, [len(r) for r in rows])
    c1, c0 = np.bincount(place, label == 1, len(every)), np.bincount(place, label == 0, len(every))
    p = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    best = np.argsort(-z, kind="stable")[:most]
    telling = best[z[best] >= least_z]
    best = np.sort(telling if len(telling) else best)  # of a handful of rows nothing stands out
    ratio = np.log((c1[best] + 0.5) / (n1 + 1)) - np.log((c0[best] + 0.5) / (n0 + 1))
    return every[best], np.minimum(np.abs(ratio) / 2, 1.0)


def pair_terms(rows: list[np.ndarray], y: np.ndarray, most: int, least_z: float = 7.0, least_rows: int = 20, block: int = 512) -> np.ndarray:
    """The buckets of pairs whose covariance differs between the labels by ``least_z`` standard errors
    or more (of 8 million pairs chance reaches 5.5).  Looked through are all pairs of the ``most``
    buckets with the highest variance, in blocks."""
    every, place = np.unique(np.concatenate([np.empty(0, np.int64), *rows]), return_inverse=True)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(place, minlength=len(every))
    p = seen / max(len(rows), 1)
    spread = p * (1 - p)
    best = np.sort(np.argsort(-spread, kind="stable")[:most])
    best = best[(seen[best] >= least_rows) & (spread[best] > 0)]
    slot = np.full(len(every), -1)
    slot[best] = np.arange(len(best))
    column = slot[place]
    of, column = of[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    sides = [np.flatnonzero(y == label) for label in (1, 0)]
    errors = spread[best] * np.sqrt(1 / len(sides[0]) + 1 / len(sides[1]))  # of a pair: sqrt of the two terms' product

    def centred(at: int) -> list[np.ndarray]:
        x = np.zeros((len(rows), min(block, len(best) - at)), dtype=np.float32)
        a, z = np.searchsorted(column, [at, at + block])
        x[of[a:z], column[a:z] - at] = 1
        return [x[side] - x[side].mean(axis=0) for side in sides]

    top = np.zeros(len(best))
    for at in range(0, len(best), block):
        left = centred(at)
        for to in range(at, len(best), block):
            right = left if to == at else centred(to)
            differ = np.abs(left[0].T @ right[0] / len(sides[0]) - left[1].T @ right[1] / len(sides[1]))
            z = differ / np.sqrt(np.outer(errors[at:at + block], errors[to:to + block]))
            if to == at:
                np.fill_diagonal(z, 0)
            top[at:at + block] = np.maximum(top[at:at + block], z.max(axis=1))
            top[to:to + block] = np.maximum(top[to:to + block], z.max(axis=0))
    return every[best[top >= least_z]]


class Machine:
    """The factorization machine over the buckets ``kept``, by slot; others weigh nothing."""

    def __init__(self, bits: int, factors: int, kept: np.ndarray, value: np.ndarray, seed: int = 3):
        self.bits, self.bias, self.slots = bits, 0.0, {int(x): i for i, x in enumerate(kept)}
        self.weight, self.value = np.zeros(len(kept)), value
        self.factor = np.random.default_rng(seed).normal(0, 0.01, (len(kept), factors))
        self.slope, self.shift = 1.0, 0.0
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def raw(self, ids: np.ndarray) -> float:
        if not len(ids):
            return self.bias
        v = self.factor[ids]
        total = v.sum(axis=0)
        return self.bias + float(self.weight[ids].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str) -> float:
        return logistic(self.slope * self.raw(terms(text, self.bits, self.slots, self.memo)) + self.shift)

    def train(self, rows: list[np.ndarray], y: np.ndarray, steps: int = 2000, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-3, seed: int = 4) -> None:
        """AdaGrad over small batches of documents, at least ``steps`` of them; decay acts on
        the terms of a batch."""
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-steps * batch // max(len(rows), 1)))
        g_w, g_v, g_b = np.full(len(self.weight), 1e-2), np.full(self.factor.shape, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at:at + batch]
                sizes = np.array([len(rows[i]) for i in part])
                if not sizes.sum():
                    continue
                ids, of = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), sizes)
                uniq, place = np.unique(ids, return_inverse=True)
                v, w, x = self.factor[uniq], self.weight[uniq], self.value[uniq]
                vi, wi = (v * x[:, None])[place], (w * x)[place]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                cum = np.concatenate((np.zeros((1, v.shape[1])), np.cumsum(vi, axis=0, dtype=np.float64)))
                total = cum[ends[1:]] - cum[ends[:-1]]
                cum_s = np.concatenate(([0.0], np.cumsum(wi - 0.5 * (vi * vi).sum(axis=1), dtype=np.float64)))
                z = self.bias + cum_s[ends[1:]] - cum_s[ends[:-1]] + 0.5 * (total * total).sum(axis=1)
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
                e = err[of]
                dw = x * np.bincount(place, e, len(uniq)) / len(part) + decay * w
                dv = x[:, None] * np.stack([np.bincount(place, e * (total[of, f] - vi[:, f]), len(uniq)) for f in range(v.shape[1])], axis=1) / len(part) + decay * v
                g_w[uniq] += dw * dw
                g_v[uniq] += dv * dv
                g_b += err.mean() ** 2
                self.weight[uniq] = w - rate * dw / np.sqrt(g_w[uniq])
                self.factor[uniq] = v - 0.2 * rate * dv / np.sqrt(g_v[uniq])
                self.bias -= rate * err.mean() / np.sqrt(g_b)
        self.weight *= self.value
        self.factor *= self.value[:, None]


def fit(rows: list[np.ndarray], y: np.ndarray, shares: tuple[int, int], bits: int = 30, factors: int = 4, most_terms: int = 8192, solved: float = 0.02) -> Machine:
    """``most_terms`` bounds the terms that count by themselves, half of it those that pairs are
    made of; pairs are looked for where the loss on the rows not seen is above ``solved``."""
    if not len(y) or y.min() == y.max():
        model = Machine(bits, factors, np.empty(0, np.int64), np.empty(0))
        n0, n1 = shares
        p = min(max(n1 / (n0 + n1) if n0 + n1 else 0.5, 1e-6), 1 - 1e-6)
        model.shift = float(np.log(p / (1 - p)))
        return model
    seen = np.arange(len(rows)) % 5 != 0 if len(rows) >= 50 else np.ones(len(rows), bool)
    unseen = ~seen if not seen.all() and len(np.unique(y[~seen])) == 2 else seen
    part, held = [rows[i] for i in np.flatnonzero(seen)], y[unseen]
    # both labels weigh the same, so a score of 0.5 lies between them and not at the many clean texts' edge
    weight = np.where(held == 1, 0.5 / max((held == 1).mean(), 1e-9), 0.5 / max((held == 0).mean(), 1e-9))

    def machine(kept: np.ndarray, value: np.ndarray) -> tuple[Machine, float]:
        model = Machine(bits, factors, kept, value)
        few = [np.searchsorted(kept, r[np.isin(r, kept)]) for r in rows]
        model.train([few[i] for i in np.flatnonzero(seen)], y[seen])
        raw = np.array([model.raw(few[i]) for i in np.flatnonzero(unseen)])
        model.slope, model.shift = platt(raw, held, weight)
        margin = np.where(held == 1, 1, -1) * (model.slope * raw + model.shift)
        return model, float(np.average(np.logaddexp(0, -margin), weights=weight))

    kept, value = select_terms(part, y[seen], most_terms)
    model, loss = machine(kept, value)
    if loss > solved and not (seen & unseen).any() and len(np.unique(y[seen])) == 2:
        pairs = pair_terms(part, y[seen], most_terms // 2)
        every = np.union1d(kept, pairs)
        known = np.ones(len(every))  # the terms of a pair enter with their whole value
        known[np.searchsorted(every, kept)] = value
        known[np.searchsorted(every, pairs)] = 1.0
        if len(pairs):
            both, less = machine(every, known)
            model = both if less < loss else model
    return model


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, per_class: int = 5000, bits: int = 30, factors: int = 4):
    """The fitted machine, shipped to the tasks (12,288 terms at most)."""
    rows, y = collect_features(docs, sampled_labels(labels, label, folds, per_class), lambda t: terms(t, bits))
    return ship(docs.sparkSession, fit(rows, y, class_counts(labels, label, folds), bits, factors))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document."""
    shared = fitted(docs, labels, folds=folds, **options)
    return scored(docs, lambda t: shared().score(t), folds, threshold)


def toxicity_column(docs: DataFrame, labels: DataFrame, **options) -> Column:
    """The score as a column for ``docs``, to filter by."""
    shared = fitted(docs, labels, **options)
    return score_column(lambda t: shared().score(t))(F.col("text"))
