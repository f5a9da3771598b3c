"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import staged
from .tokens import token_lengths


def lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the number of ids of its whole text; a null text has none."""

    def run(batches):
        for batch in batches:
            n = token_lengths(batch, tokenizer_path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each encoded length: n_tokens, n_docs.

    Workers count the documents of a batch first, so only distinct lengths are shuffled.
    """

    def run(batches):
        for batch in batches:
            n, count = np.unique(token_lengths(batch, tokenizer_path), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(count)], names=["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame, block: int = 4096) -> DataFrame:
    """Adds to each length L what documents of L ids and more hold, and what a context of L ids keeps of all.

    docs_from, tokens_from: documents of at least L ids and their ids.  truncated_total: all ids when each
    document is cut at L.  docs_total: all documents.  Sums run in two levels, over blocks of lengths and
    within each block, so that no task sorts all lengths.
    """
    rows = counts.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    all_blocks = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(all_blocks), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(all_blocks), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(total).alias("docs_total"),
        F.sum("t").over(total).alias("tokens_total"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_above") + F.sum("n_docs").over(within)).alias("docs_from"),
        (F.col("tokens_above") + F.sum("tokens").over(within)).alias("tokens_from"),
        "docs_total",
        "tokens_total",
    )
    return out.withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The histogram with suffix sums.  Empty table: no rows.  A null or empty text has length 0; repeated rows each count.

    The histogram is written to the shared folder first, so texts are encoded once.
    """
    return suffix_sums(staged(histogram(docs, tokenizer_path), "token-histogram"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: docs_total, docs_longer, tokens_total, truncated_total."""
    longer = F.col("n_tokens") > limit
    return sums.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_total"),
        F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("tokens_total"),
        F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).alias("truncated_total"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share ``q`` of documents does not exceed."""
    up_to = F.col("docs_total") - F.col("docs_from") + F.col("n_docs")
    return sums.filter(up_to >= F.ceil(F.lit(q) * F.col("docs_total"))).agg(F.min("n_tokens").alias("n_tokens"))
