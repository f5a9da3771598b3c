"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .linear import collect_features, count_features, labelled, sample_ids, score, sigmoid
from .textkit import alnum_table, lower_table, mix, owners, prefix_hash, space_table, span_hash

#: Hashed feature space, and labelled documents that a fit uses at most.
BITS = 20
TRAIN_DOCS = 6000


def tokens(buf: np.ndarray, offs: np.ndarray):
    """Runs of letters and digits, and runs of other signs: starts, ends, first token of each document (CSR), is word."""
    kind = np.where(alnum_table()[buf], 1, 2).astype(np.int8)
    kind[~space_table()[buf]] = 0
    n = len(buf)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offs[:-1][offs[:-1] < n]] = True
    at = np.flatnonzero(change)
    ends = np.append(at[1:], n)
    keep = kind[at] > 0
    starts, ends = at[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offs), kind[starts] == 1


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray, h: np.ndarray, csr: np.ndarray) -> np.ndarray:
    """A small number for each token: lower, capitalised, upper or numeric word, or kind and length of signs; repeats are marked."""
    count = lambda m: np.concatenate([[0], np.cumsum(m)])
    inside = lambda c: c[ends] - c[starts]
    upper = inside(count((buf >= 0x41) & (buf <= 0x5A)))
    digit = inside(count((buf >= 0x30) & (buf <= 0x39)))
    size = ends - starts
    shape = np.where(upper == 0, 1, np.where((upper >= 2) & (2 * upper > size), 3, 2))
    shape = np.where(2 * digit > size, 4, shape)
    sign = 8 + 4 * buf[starts].astype(np.int64) + np.minimum(size, 3)
    shape = np.where(word, shape, sign).astype(np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[csr[:-1][csr[:-1] < len(h)]] = False
    return shape + 2048 * again


def features(buf: np.ndarray, offs: np.ndarray):
    """Hashed word unigrams and bigrams and shape n-grams up to three; a value is the root of the n-gram's share."""
    n_docs = len(offs) - 1
    starts, ends, csr, word = tokens(buf, offs)
    h = span_hash(prefix_hash(lower_table()[buf]), starts, ends)
    doc = owners(csr)
    s = mix(shapes(buf, starts, ends, word, h, csr).astype(np.uint64) + np.uint64(77))
    two = np.flatnonzero(doc[1:] == doc[:-1])
    three = two[:-1][np.diff(two) == 1] if len(two) > 1 else two[:0]
    three = three[doc[three] == doc[three + 2]]
    k = np.uint64(0xD6E8FEB86659FD93)
    grams = [(doc, h), (doc[two], mix(h[two] * k + h[two + 1])), (doc, s), (doc[two], mix(s[two] * k + s[two + 1])), (doc[three], mix((s[three] * k + s[three + 1]) * k + s[three + 2]))]
    at, index, count = count_features(np.concatenate([d for d, _ in grams]), np.concatenate([g >> np.uint64(64 - BITS) for _, g in grams]), n_docs, BITS)
    total = np.maximum(np.diff(csr), 1)
    return at, index, np.sqrt(count / total[owners(at)])


@dataclass
class Ftrl:
    """Follow-the-regularised-leader (proximal) logistic regression with per-coordinate rates; coordinate 2**BITS is the bias."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 0.3

    def __post_init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, index: np.ndarray, value: np.ndarray, y: int) -> None:
        w = self.weights(index)
        g = (sigmoid(np.array([w @ value]))[0] - y) * value
        square = g * g
        sigma = (np.sqrt(self.n[index] + square) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += square


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, epochs: int = 3, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias, learned from at most ``limit`` labelled documents of the training folds.

    The sample is the rows with the smallest seeded hash of doc_id; only their features reach the driver.
    """
    chosen = sample_ids(labelled(labels, "quality"), limit, seed)
    rows = collect_features(docs, chosen, features)
    model, rng = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            _, y, index, value = rows[k]
            model.update(np.append(index, 1 << BITS), np.append(value, 1.0), y)
    w = model.weights(slice(None))
    return w[:-1].astype(np.float32), float(w[-1])


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """Adds the probability that the text is of good quality, as ``score``, to every row.

    Null and empty texts have no features and get the bias's probability.  Without labels all scores are 0.5.
    Other columns of the tables are not looked at.  Repeated rows are scored each.  Empty table: no rows.
    """
    weights, bias = fit(docs, labels, limit)
    return score(docs, weights, bias, features)
