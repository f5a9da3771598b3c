"""Full-text search: postings, BM25 ranking and re-indexing as table operations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The usual BM25 constants, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Accented Latin letters and what they are folded to.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def assemble(*groups: Column) -> Column:
    """Field groups (arrays of strings) joined with single blanks; blank parts are dropped."""
    return F.array_join(F.filter(F.flatten(F.array(*groups)), lambda x: x.isNotNull() & (F.trim(x) != "")), " ")


def tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits; accents of Latin letters are taken off."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf and the document's length."""
    rows = docs.select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return rows.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def parse(text: str) -> tuple | None:
    """The tree of a search: words and "phrases" with * after a prefix and column: before; NOT binds before AND (or a blank), AND before OR."""
    pieces = re.findall(r'"[^"]*"|[()]|[^\s()":*]+|[:*]', text)
    at = 0

    def peek():
        return pieces[at] if at < len(pieces) else None

    def take():
        nonlocal at
        at += 1
        return pieces[at - 1]

    def either():
        node = both()
        while peek() == "OR":
            take()
            node = ("or", node, both())
        return node

    def both():
        node = without()
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                take()
            node = ("and", node, without())
        return node

    def without():
        node = atom()
        while peek() == "NOT":
            take()
            node = ("not", node, atom())
        return node

    def atom():
        piece = take() if at < len(pieces) else ""
        if piece == "(":
            node = either()
            if at >= len(pieces) or take() != ")":
                raise ValueError("a bracket is open")
            return node
        if piece in ("", ")", "AND", "OR", "NOT", ":", "*"):
            raise ValueError(f"a word is missing before {piece!r}")
        if peek() == ":":
            take()
            kind, words, prefix, _ = atom()
            if kind != "words":
                raise ValueError("a column stands before one word or phrase")
            return kind, words, prefix, piece.lower()
        prefix = peek() == "*"
        if prefix:
            take()
        return "words", piece.strip('"'), prefix, None

    if not pieces:
        return None
    tree = either()
    if at < len(pieces):
        raise ValueError(f"not understood from {pieces[at]!r} on")
    return tree


def occurrences(words: Column, phrase: Column, size: int, prefix: bool) -> Column:
    """How often the phrase, its last word perhaps a prefix, stands in the words."""
    last = F.get(phrase, size - 1)
    ends = lambda w: w.startswith(last) if prefix else w == last
    if size == 1:
        return F.size(F.filter(words, ends))
    head = lambda i: F.slice(words, i, size - 1) == F.slice(phrase, 1, size - 1)
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: head(i) & ends(F.get(words, i + (size - 2)))))


def match(docs: DataFrame, query: str, columns: list[str], limit: int, include_excluded: bool = False) -> DataFrame:
    """Documents that answer the search, best first by BM25 over its words and phrases, ties by id; a blank search has no answer.

    Documents that are hidden or excluded (columns of these names, where there are any) are left out unless asked
    for; they count as documents all the same.  Each document is tokenised once and the words sought are counted in
    its array of tokens, so nothing but one row for a hit leaves the scan.
    """
    tree = parse(query)
    if tree is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("score")).limit(0)
    hidden = F.lit(False)
    for c in ("hidden", "excluded"):
        if c in docs.columns:
            hidden = hidden | F.coalesce(F.col(c), F.lit(False))
    rows = docs.select("doc_id", hidden.alias("hidden"), *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"words_{c}") for c in columns])
    counts: dict[tuple, Column] = {}

    def told(node) -> Column:
        if node[0] != "words":
            a, b = told(node[1]), told(node[2])
            return {"and": a & b, "or": a | b, "not": a & ~b}[node[0]]
        if node not in counts:
            _, words, prefix, column = node
            phrase = re.findall(r"[^\W_]+", fold(words))
            if column is not None and column not in columns:
                raise ValueError(f"no column {column!r}")
            found = [occurrences(F.col(f"words_{c}"), F.array(*map(F.lit, phrase)), len(phrase), prefix) for c in columns if column in (None, c)]
            counts[node] = sum(found[1:], found[0]) if phrase else F.lit(0)
        return F.col(f"n{list(counts).index(node)}") > 0

    fits = told(tree)
    names = [f"n{i}" for i in range(len(counts))]
    length = sum((F.size(f"words_{c}") for c in columns[1:]), F.size(f"words_{columns[0]}"))
    counted = rows.select("doc_id", "hidden", length.alias("dl"), *[x.alias(n) for n, x in zip(names, counts.values(), strict=True)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(n) > 0).alias(f"df_{n}") for n in names])
    score = F.lit(0.0)
    for n in names:
        idf = F.greatest(F.log((F.col("n") - F.col(f"df_{n}") + 0.5) / (F.col(f"df_{n}") + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = counted.filter(fits if include_excluded else fits & ~F.col("hidden")).crossJoin(F.broadcast(stats))
    return hits.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def fold(text: str) -> str:
    """A search word as ``tokens`` folds words of documents."""
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def phrase_match(docs: DataFrame, phrase: list[str]) -> DataFrame:
    """Documents with the words one after another."""
    body = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    return docs.filter(body.contains(f" {' '.join(phrase)} ")).select("doc_id")


def prefix_match(index: DataFrame, prefix: str) -> DataFrame:
    return index.filter(F.col("term").startswith(prefix)).select("doc_id").distinct()


def reindex(index: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings of changed documents replace the old ones."""
    return index.join(changed.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(postings(changed))
