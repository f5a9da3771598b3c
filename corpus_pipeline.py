"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination and packing, one after another."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.llm import decontaminate, line_dedup, minhash, packing, toxicity
from mediaquarry.llm.textkit import documents, staged

#: A document goes when its probability of being toxic reaches this.
TOXIC = 0.3


def _plain(docs: DataFrame) -> DataFrame:
    """The documents with every column but doc_id and text under a name that no operator makes."""
    return docs.toDF(*[n if n in ("doc_id", "text") else f"column_{i}_of_documents" for i, n in enumerate(docs.columns)])


def _named(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*_plain(docs).columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    A null or empty text has the bias's score and stays; rows without doc_id and repeated rows are judged one by
    one by their text; a text scored TOXIC exactly goes.  Empty table: no rows.  Without labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _named(toxicity.score_toxicity(_plain(docs), labels).filter(F.col("score") < TOXIC), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines that an earlier one owns; n_chars, where there is one, follows the new text.

    A null text stays null; rows without doc_id keep their lines; rows of one doc_id, repeated rows among them,
    are one document, which owns a line if its id is the smallest.  Empty table: no rows.
    """
    out = line_dedup.dedup_lines(_plain(docs))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    out = _named(out.withColumn("text", text), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near-duplicates; documents without id stay.

    Texts without words (null, empty) are classes of their own and stay.  Repeated rows stay together: a row stays
    if its doc_id and text are the first of their class.  Different texts under one doc_id are judged apart.
    Empty table: no rows.
    """
    mine = _plain(docs).withColumn("tkey", minhash.text_key())
    first = minhash.near_duplicates(mine).filter("doc_id = class_id").select("doc_id", "tkey")
    return _named(mine.join(first, ["doc_id", "tkey"], "left_semi").union(mine.filter("doc_id is null").select("doc_id", "tkey", *_plain(docs).drop("doc_id").columns)), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    A null or empty text has no words and stays; rows without doc_id and repeated rows are judged one by one.
    Empty table: no rows.  Without items nothing goes.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _named(decontaminate.find_contamination(_plain(docs), benchmark).filter("n_hit = 0"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 ids.

    A null or empty text gives one piece of the end id alone; rows without doc_id and repeated rows are packed
    each.  Empty table: no rows.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Toxicity and near-dedup cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage keeps is written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
