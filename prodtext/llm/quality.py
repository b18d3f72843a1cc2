"""Quality classifier: naive Bayes support vectors.

n-gram indicators (words, word pairs, shapes of words and of pairs, and repeated words, hashed) are scaled by
the log ratio of their class frequencies; a linear model with squared hinge loss is fitted to
the scaled, length-normalised indicators by dual coordinate descent.  A logistic link, fitted
to a part of the sample that the model did not see and weighted to the class shares of
all labels, turns margins into scores.

The fit uses a bounded sample of labelled rows (``per_class`` of each label); scoring
reads every whole text and nothing else.

Defined results: null and empty texts have no n-grams and score as the bias says; without
rows of both labels every score is the share of label 1 (0.5 without any); repeated rows are
scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from prodtext.llm.common import ship
from prodtext.llm.labelled import class_counts, collect_features, logistic, platt, sampled_labels, scored

_RUNS = re.compile(r"(.)\1+")
_MEMO: dict[str, int] = {}


def _shape(word: str) -> str:
    """Letters as A or a, digits as 0, other characters as they are, runs as one and a plus."""
    if word.isalpha():  # the many plain words
        for case, first in ((word.islower(), "a"), (word.isupper(), "A")):
            if case:
                return first + "+" * (len(word) > 1)
        if word[0].isupper() and word[1:].islower():
            return "Aa" + "+" * (len(word) > 2)
    return _RUNS.sub(r"\1+", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def _token(word: str) -> int:
    """Hashes of a word, lower-cased, and of its shape, as one integer."""
    return zlib.crc32(word.lower().encode("utf-8", "replace"), 1) << 32 | zlib.crc32(_shape(word).encode("utf-8", "replace"), 2)


def ngrams(text: str, bits: int) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams."""
    memo = _MEMO
    codes = []
    for w in text.split():
        t = memo.get(w)
        if t is None:
            if len(memo) > 300_000:  # bounds a worker's memory
                memo.clear()
            t = memo[w] = _token(w)
        codes.append(t)
    if not codes:
        return np.empty(0, np.int32)
    packed = np.fromiter(codes, np.uint64, len(codes))
    both = np.stack((packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)), axis=1)
    pairs = (both[:-1] * np.uint64(0x9E3779B97F4A7C15) + both[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    # a word that follows itself, once and twice, whichever word it is
    same = both[1:, 0] == both[:-1, 0]
    again = np.array([zlib.crc32(k) for k, found in ((b"xx", same.any()), (b"xxx", (same[1:] & same[:-1]).any())) if found], dtype=np.uint64)
    return np.unique((np.concatenate((both.ravel(), pairs.ravel(), again)) & np.uint64((1 << bits) - 1)).astype(np.int32))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, t in zip(rows, y) if t == c] or [np.empty(0, np.int64)]), minlength=size) + alpha for c in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of the L2-regularised squared-hinge linear model; the last one is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    sign, diag = np.where(y == 1, 1.0, -1.0), 0.5 / cost
    norm = np.array([v @ v + 1.0 for v in values]) + diag
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = sign[i] * (w[r] @ v + w[size]) - 1 + diag * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(alpha[i] - g / norm[i], 0.0)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[r] += step * v
                w[size] += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-4:
            break
    return w


class Model:
    def __init__(self, weight: np.ndarray, ratio: np.ndarray, bits: int, slope: float, shift: float):
        self.weight, self.bias, self.square, self.bits = (weight[:-1] * ratio).astype(np.float32), float(weight[-1]), (ratio * ratio).astype(np.float32), bits
        self.slope, self.shift = slope, shift

    def margin(self, grams: np.ndarray) -> float:
        return float(self.weight[grams].sum(dtype=np.float64) / np.sqrt(max(self.square[grams].sum(dtype=np.float64), 1e-12))) + self.bias if len(grams) else self.bias

    def score(self, text: str) -> float:
        return logistic(self.slope * self.margin(ngrams(text, self.bits)) + self.shift)


def fit(rows: list[np.ndarray], y: np.ndarray, shares: tuple[int, int], bits: int = 18) -> Model:
    size = 1 << bits
    if not len(y) or y.min() == y.max():
        n0, n1 = shares
        p = min(max(n1 / (n0 + n1) if n0 + n1 else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size + 1), np.zeros(size), bits, 1.0, float(np.log(p / (1 - p))))
    seen = np.arange(len(rows)) % 5 != 0 if len(rows) >= 50 else np.ones(len(rows), bool)
    part = [rows[i] for i in np.flatnonzero(seen)]
    ratio = log_count_ratio(part, y[seen], size)
    scale = lambda r: ratio[r] / max(np.linalg.norm(ratio[r]), 1e-6)
    w = dual_descent(part, [scale(r) for r in part], y[seen], size)
    model = Model(w, ratio, bits, 1.0, 0.0)
    unseen = ~seen if not seen.all() and len(np.unique(y[~seen])) == 2 else seen
    margins, held = np.array([model.margin(rows[i]) for i in np.flatnonzero(unseen)]), y[unseen]
    weight = np.where(held == 1, shares[1] / max((held == 1).sum(), 1), shares[0] / max((held == 0).sum(), 1))
    model.slope, model.shift = platt(margins, held, weight * len(held) / max(sum(shares), 1))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, per_class: int = 8000, bits: int = 18, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document."""
    rows, y = collect_features(docs, sampled_labels(labels, label, folds, per_class), lambda t: ngrams(t, bits))
    shared = ship(docs.sparkSession, fit(rows, y, class_counts(labels, label, folds), bits))  # 2 MB at 18 bits
    return scored(docs, lambda t: shared().score(t), folds, threshold)
