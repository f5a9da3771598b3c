"""Toxicity: non-negative positive-unlabelled learning of a hashed linear classifier in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import collect_features, count_features, held_out, labelled, sample_ids, score, sigmoid
from .textkit import alnum_table, lower_table, mix, owners, prefix_hash, runs, span_hash

#: Hashed feature space; confirmed toxic and unlabelled documents that a fit uses at most.
BITS = 18
POSITIVE_DOCS, UNLABELLED_DOCS = 3000, 6000
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)


def features(buf: np.ndarray, offs: np.ndarray):
    """Distinct hashed words and word beginnings of each text, each of value 1."""
    n_docs = len(offs) - 1
    starts, ends, csr = runs(alnum_table()[buf], offs)
    p = prefix_hash(lower_table()[buf])
    doc = owners(csr)
    docs, hashes = [doc], [span_hash(p, starts, ends)]
    for size in BEGINNINGS:
        long_enough = np.flatnonzero(ends - starts >= size)
        a = starts[long_enough]
        docs.append(doc[long_enough])
        hashes.append(mix(span_hash(p, a, a + size) + np.uint64(size)))
    at, index, _ = count_features(np.concatenate(docs), np.concatenate([h >> np.uint64(64 - BITS) for h in hashes]), n_docs, BITS)
    return at, index, np.ones(len(index))


def scaled_features(weights: np.ndarray):
    """The features with weight alone, scaled by the root of their number: one insult weighs alike in any length."""

    def scaled(buf: np.ndarray, offs: np.ndarray):
        at, index, _ = features(buf, offs)
        live = weights[index] != 0
        doc = owners(at)[live]
        size = np.bincount(doc, minlength=len(offs) - 1)
        return np.concatenate([[0], np.cumsum(size)]), index[live], 1 / np.sqrt(size[doc])

    return scaled


@dataclass
class NonNegativePu:
    """Linear model minimising prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the logistic loss.

    Where the second part falls under -``slack``, the step goes against it instead, as the estimator prescribes.
    Only features that stand out among the positives take part: ``stand_out`` standard errors above their share
    of unlabelled texts, and ``lift`` times that share.  Their weights stay at zero or above.
    """

    prior: float
    rate: float = 0.1
    stand_out: float = 4.5
    lift: float = 3.0
    decay: float = 1e-4
    slack: float = 0.02
    steps: int = 3000
    batch: int = 512
    seed: int = 5

    def fit(self, positive: list, unlabelled: list) -> tuple[np.ndarray, float]:
        size = 1 << BITS
        start = float(np.log(self.prior / (1 - self.prior)))
        if not positive or not unlabelled:
            return np.zeros(size, np.float32), start
        used = np.flatnonzero(self.standing_out(positive, unlabelled, size))
        place = np.full(size, -1)
        place[used] = np.arange(len(used))
        positive, unlabelled = ([place[r[2]][place[r[2]] >= 0] for r in rows] for rows in (positive, unlabelled))
        dims = len(used)
        w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
        w[-1] = start
        rng = np.random.default_rng(self.seed)
        for step in range(1, self.steps + 1):
            p = self.draw(positive, rng)
            u = self.draw(unlabelled, rng)
            fp, fu = self.value(w, p), self.value(w, u)
            minus = np.logaddexp(0, fu).mean() - self.prior * np.logaddexp(0, fp).mean()
            gp_minus, gu = self.prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
            if minus >= -self.slack:
                gp, gu = -self.prior * sigmoid(-fp) / len(fp) - gp_minus, gu
            else:
                gp, gu = gp_minus, -gu
            g = self.gradient(p, gp, dims) + self.gradient(u, gu, dims) + self.decay * w
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            rate = self.rate * (1 - step / (self.steps + 1))
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            np.maximum(w[:-1], 0, out=w[:-1])
        out = np.zeros(size, np.float32)
        out[used] = w[:-1]
        return out, float(w[-1])

    def standing_out(self, positive: list, unlabelled: list, dims: int) -> np.ndarray:
        n_p, n_u = len(positive), len(unlabelled)
        in_p = np.bincount(np.concatenate([r[2] for r in positive]), minlength=dims)
        in_u = np.bincount(np.concatenate([r[2] for r in unlabelled]), minlength=dims)
        pooled = (in_p + in_u) / (n_p + n_u)
        error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_p + 1 / n_u))
        lead = in_p / n_p - in_u / n_u
        return (in_p >= 3) & (lead > self.stand_out * error) & (in_p / n_p > self.lift * in_u / n_u)

    def draw(self, rows: list, rng):
        picked = [rows[k] for k in rng.choice(len(rows), min(self.batch, len(rows)), replace=False).tolist()]
        size = np.array([len(r) for r in picked])
        row = np.repeat(np.arange(len(picked)), size)
        return row, np.concatenate(picked), 1 / np.sqrt(size)[row], len(picked)

    @staticmethod
    def value(w, x):
        row, index, value, n = x
        return np.bincount(row, w[index] * value, n) + w[-1]

    @staticmethod
    def gradient(x, g, dims):
        row, index, value, _ = x
        return np.append(np.bincount(index, g[row] * value, dims), g.sum())


def without_copies(rows: list) -> list:
    """The first row of each group with the same two smallest permuted feature numbers."""
    first: dict = {}
    for r in rows:
        order = np.sort((r[2] * 0x9E3779B1 + 12345) % (1 << 32))[:2]
        first.setdefault(order.tobytes(), r)
    return list(first.values())


def class_prior(labels: DataFrame) -> float:
    """Share of toxic rows among the labelled rows of the training folds, kept within 0.1 and 90 per cent."""
    row = labelled(labels, "toxic").agg(F.avg("y").alias("p")).first()
    return float(min(0.9, max(0.001, row["p"] if row["p"] is not None else 0.001)))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE_DOCS, unlabelled: int = UNLABELLED_DOCS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias from confirmed toxic documents of the training folds and unlabelled text.

    Unlabelled text is drawn from all documents of the training folds without a look at labels.  Both samples
    are bounded by parameters and hold the rows with the smallest seeded hashes of doc_id; near copies
    among the toxic ones count once, or their ordinary words would stand out.
    """
    prior = class_prior(labels)
    p = collect_features(docs, sample_ids(labelled(labels, "toxic").filter("y = 1"), positives, seed), features)
    every = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    p = without_copies(p)
    u = collect_features(docs, sample_ids(every, unlabelled, seed + 1).withColumn("y", F.lit(0)), features)
    return NonNegativePu(prior).fit(p, u)


def score_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE_DOCS, unlabelled: int = UNLABELLED_DOCS) -> DataFrame:
    """Adds the probability that the text is toxic, as ``score``, to every row.

    Null and empty texts have no features and get the bias's probability, as do all texts where no toxic
    example is known.  Repeated rows are scored each.  Empty table: no rows.
    """
    weights, bias = fit(docs, labels, positives, unlabelled)
    return score(docs, weights, bias, scaled_features(weights))
