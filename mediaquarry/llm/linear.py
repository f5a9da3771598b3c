"""Sparse linear models over hashed features: the parts that the classifiers share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import crc_mod, map_rows, text_slices

#: Rows with this remainder of crc32(doc_id) modulo FOLDS are held out.
FOLDS, HELD_OUT = 4, 2

#: features(buf, offs) gives each document's first feature (CSR), feature numbers and values.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def held_out():
    return F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))


def count_features(doc: np.ndarray, index: np.ndarray, n_docs: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs with their counts, in CSR layout."""
    key, count = np.unique((doc.astype(np.int64) << bits) | index.astype(np.int64), return_counts=True)
    return np.searchsorted(key >> bits, np.arange(n_docs + 1)), key & ((1 << bits) - 1), count


def dots(weights: np.ndarray, csr: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sparse dot product of each document."""
    return np.bincount(np.repeat(np.arange(len(csr) - 1), np.diff(csr)), weights[index] * value, len(csr) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def sample_ids(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest seeded hash of doc_id."""
    return rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(limit)


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One row for each labelled document of the training folds: doc_id, y (the largest label where they differ)."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).filter(~held_out())
    return rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))


def collect_features(docs: DataFrame, chosen: DataFrame, features: Features) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Features of the chosen rows (doc_id, y), a bounded number, sorted by doc_id.

    Of the rows of one doc_id the text with the smallest hash counts, so a repeated id brings one row to the driver.
    """

    def run(batches):
        for batch in batches:
            for i, n, buf, offs in text_slices(batch):
                csr, index, value = features(buf, offs)
                a = [index[csr[k] : csr[k + 1]].astype(np.uint32).tobytes() for k in range(n)]
                b = [value[csr[k] : csr[k + 1]].astype(np.float32).tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc_id", "y", "i", "v"])

    picked = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id").select("doc_id", "y", "text")
    picked = picked.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "y", "text")
    rows = picked.mapInArrow(run, "doc_id long, y int, i binary, v binary").toLocalIterator(prefetchPartitions=True)
    out = [(r["doc_id"], r["y"], np.frombuffer(bytes(r["i"]), np.uint32).astype(np.int64), np.frombuffer(bytes(r["v"]), np.float32)) for r in rows]
    return sorted(out, key=lambda r: (r[0], r[1], r[2].tobytes()))


def score(docs: DataFrame, weights: np.ndarray, bias: float, features: Features) -> DataFrame:
    """Adds the model's probability of each whole text as ``score``; a text without features gets that of the bias."""

    def run(batch):
        out = np.zeros(batch.num_rows)
        for i, n, buf, offs in text_slices(batch):
            out[i : i + n] = sigmoid(dots(weights, *features(buf, offs)) + bias)
        return [pa.array(out)]

    return map_rows(docs, "score double", run)
