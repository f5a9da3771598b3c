"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, decontaminate, line_dedup, minhash, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity
from .linear import held_out
from .textkit import documents

#: Fixed value: the vocabulary that the contracts name.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _classified(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _classified(quality_classifier.classify(documents(spark, sf_dir).select("doc_id", "text"), labels), 0.7)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = brown_lm.score_texts(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), TOKENIZER)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), owners AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, i, l, owner IS NOT NULL AND doc_id <> owner AS gone FROM lines LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT doc_id, count(*) AS n_text_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM win WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_text_lines, 0) AS n_text_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols / CAST(word_chars AS DOUBLE) ELSE 0 END AS sr, CASE WHEN n_text_lines > 0 THEN n_dup_lines / CAST(n_text_lines AS DOUBLE) ELSE 0 END AS dr,
         CASE WHEN n_words > 0 THEN n_repeat_words / CAST(n_words AS DOUBLE) ELSE 0 END AS rr, CASE WHEN n_words > 0 THEN word_chars / CAST(n_words AS DOUBLE) ELSE 0 END AS wl
  FROM m
), q AS (
  SELECT lang, source, count(*) AS n, quantile_disc(sr, [0.25, 0.75]) AS sr_q, quantile_disc(dr, [0.25, 0.75]) AS dr_q, quantile_disc(rr, [0.25, 0.75]) AS rr_q, quantile_disc(wl, [0.25, 0.75]) AS wl_q
  FROM r WHERE NOT base_failed GROUP BY lang, source
), every AS (
  SELECT quantile_disc(sr, [0.25, 0.75]) AS sr_a, quantile_disc(dr, [0.25, 0.75]) AS dr_a, quantile_disc(rr, [0.25, 0.75]) AS rr_a, quantile_disc(wl, [0.25, 0.75]) AS wl_a
  FROM r WHERE NOT base_failed
), fence AS (
  SELECT lang, source, CASE WHEN n < 30 THEN sr_a ELSE sr_q END AS s, CASE WHEN n < 30 THEN dr_a ELSE dr_q END AS d,
         CASE WHEN n < 30 THEN rr_a ELSE rr_q END AS p, CASE WHEN n < 30 THEN wl_a ELSE wl_q END AS w
  FROM q, every
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(sr > s[2] + 3 * (s[2] - s[1] + 0.01) OR dr > d[2] + 3 * (d[2] - d[1] + 0.05)
         OR rr > p[2] + 3 * (p[2] - p[1] + 0.03) OR wl > w[2] + 3 * (w[2] - w[1] + 0.5) OR wl < w[1] - 3 * (w[2] - w[1] + 0.5), false) AS kept
FROM r LEFT JOIN fence f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.find_contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _classified(toxicity.score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels), 0.3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_quality_rules": OP5_SQL, "op7_decontamination": OP7_SQL}
