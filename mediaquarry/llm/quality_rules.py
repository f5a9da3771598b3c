"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then a joined filter.

Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import staged

#: White space, and the signs that count as symbols.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

#: A rule rejects a document whose metric lies above its group's upper fence; low rules, one that lies below the lower.
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "word_length")
LOW_RULES = ("word_length",)
FENCES = (*[f"{m}_high" for m in RULES], *[f"{m}_low" for m in LOW_RULES])
#: Names of the columns made here; columns of the input with these names are replaced.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words", *RULES, "base_failed", *FENCES, "kept")
#: Fences stand this many interquartile ranges outside the quartiles.
REACH = 3.0
#: Added to a group's interquartile range, so that a group of equal values has some width.
SPREAD = {"symbol_ratio": 0.01, "dup_line_ratio": 0.05, "repeat_ratio": 0.03, "word_length": 0.5}
#: Groups with fewer documents that pass the base rules take the fences of all groups together.
LEAST_ROWS = 30
#: Accuracy parameter of the sketches (rank error about 1.7 / K).
SKETCH_K = 1024


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def measure(docs: DataFrame) -> DataFrame:
    """The base counts of each whole text, in place of the text; a null text has none.

    For repeated words, the 3-word windows are sorted by the hash of their words; equal neighbours mark the
    repeated windows, whose sorted positions then cover up to three words each.  Other columns bear the names
    c0, c1, ... until the end, so none of theirs can meet one made here.
    """
    names = docs.columns
    docs = docs.toDF(*["text" if n == "text" else f"c{i}" for i, n in enumerate(names)])
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    x = docs.withColumn("q_words", words_of(text))
    x = x.withColumn("q_n", F.size("q_words").cast("long"))
    x = x.withColumn("q_hash", F.transform("q_words", lambda w: F.xxhash64(w)))
    triple = lambda i: F.struct(
        F.xxhash64(F.get("q_hash", i), F.get("q_hash", i + 1), F.get("q_hash", i + 2)).alias("w"), i.alias("i")
    )
    x = x.withColumn("q_sorted", F.when(F.col("q_n") >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("q_words") - 3), triple))))
    twin = lambda s, k: (s["w"] == F.get("q_sorted", k + 1)["w"]) | (s["w"] == F.get("q_sorted", k - 1)["w"])
    x = x.withColumn("q_at", F.sort_array(F.transform(F.filter("q_sorted", twin), lambda s: s["i"])))
    cover = F.aggregate(
        F.transform("q_at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("q_at", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    return x.select(
        *[c for c in docs.columns if c != "text"],
        F.col("q_n").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_text_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def metrics(measured: DataFrame) -> DataFrame:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return measured.withColumns(
        {
            "symbol_ratio": over("n_symbols", "word_chars"),
            "dup_line_ratio": over("n_dup_lines", "n_text_lines"),
            "repeat_ratio": over("n_repeat_words", "n_words"),
            "word_length": over("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
        }
    )


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """One KLL sketch for each group and metric, over the documents that pass the base rules.

    Sketches are built on the map side and merged, so a group with a third of all rows moves a few kilobytes
    from each task; tables of several runs can be merged with ``merge_sketches``.
    """
    rows = measured.filter(~F.col("base_failed"))
    return rows.groupBy(*groups).agg(*[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in RULES])


def merge_sketches(parts: DataFrame, groups: list[str]) -> DataFrame:
    return parts.groupBy(*groups).agg(*[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in RULES])


def thresholds(sketched: DataFrame, groups: list[str]) -> DataFrame:
    """Upper and lower fences of each group and metric from its quantiles alone: no fixed cutoff has a part in them.

    A group of fewer than LEAST_ROWS documents takes the fences of all groups together, from the merged sketches.
    """
    at = lambda m, q: F.kll_sketch_get_quantile_double(m, F.lit(q))
    reach = lambda m: REACH * (at(m, 0.75) - at(m, 0.25) + SPREAD[m])
    high = {f"{m}_high": at(m, 0.75) + reach(m) for m in RULES}
    fences = high | {f"{m}_low": at(m, 0.25) - reach(m) for m in LOW_RULES}
    every = merge_sketches(sketched, []).select(*[f.alias(f"all_{c}") for c, f in fences.items()])
    few = F.kll_sketch_get_n_double(RULES[0]) < LEAST_ROWS
    return sketched.crossJoin(F.broadcast(every)).select(*groups, *[F.when(few, F.col(f"all_{c}")).otherwise(f).alias(c) for c, f in fences.items()])


def apply_rules(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Base counts, base_failed, the metrics with their group's fences, and kept, in place of the text.

    Counts are made once and written to the shared folder; thresholds and verdicts are read from there.

    A document is kept if it passes the base rules and no metric lies beyond its group's fences.  Null groups
    form a group of their own.  Documents that fail the base rules shape no threshold.  Null and empty texts
    fail for want of words.  Repeated rows each count and get a row each.  Empty table: no rows.
    """
    docs = docs.drop(*MADE)
    names = docs.columns
    keys = [f"c{names.index(g)}" for g in groups]
    measured = staged(metrics(measure(docs)), "quality-counts")
    limits = thresholds(sketches(measured, keys), keys)
    renamed = limits.select(*[F.col(g).alias(f"g_{g}") for g in keys], *FENCES)
    same = F.lit(True)
    for g in keys:
        same = same & F.col(g).eqNullSafe(F.col(f"g_{g}"))
    joined = measured.join(renamed, same, "left")
    beyond = F.lit(False)
    for m in RULES:
        beyond = beyond | (F.col(m) > F.col(f"{m}_high"))
    for m in LOW_RULES:
        beyond = beyond | (F.col(m) < F.col(f"{m}_low"))
    kept = ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))
    return joined.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n != "text"], *MADE[:-1], kept.alias("kept"))
