"""Near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .linear import count_features
from .textkit import alnum_table, dense_counts, doc_sums, lean, lean_groups, lower_table, mix, owners, prefix_hash, runs, span_hash, staged, text_slices, worker_cache

#: Bits of a shingle's number; cells of the document frequency sketch.
SHINGLE_BITS = 44
CELLS = 1 << 20
#: Bands and samples in a band: at similarity 0.8 a pair goes unseen with probability 0.0008.
BANDS, ROWS = 10, 3
#: Entries of the table that random variates are drawn from by hash.
VARIATES = 1 << 16
#: Candidates (24 bytes each) that may be sent to all executors.
SENT_IDS = 1_000_000
#: Members of one block when a bucket is compared pair by pair.
BLOCK = 256
#: Parts that a bucket is dealt to, each with a leader of its own, so that no task gets all of a hot bucket.
SALTS = 64
#: Of its BANDS * ROWS samples a pair of similarity 0.8 shares fewer than this with probability 1e-6.
LEAST_SAMPLES = 13
#: Numbers from here on stand for further texts of a doc_id that has several.
FURTHER = 1 << 62


def shingles(buf: np.ndarray, offs: np.ndarray, size: int = 5):
    """Distinct shingles of each text: first shingle (CSR), number, count; and two 64-bit keys of its word sequence.

    Words are runs of ASCII letters, digits and code points from 128, lower-cased.  A text of fewer than
    ``size`` words, but not none, is one shingle.
    """
    n_docs = len(offs) - 1
    starts, ends, csr = runs(alnum_table()[buf], offs)
    h = span_hash(prefix_hash(lower_table()[buf]), starts, ends)
    doc, n_words = owners(csr), np.diff(csr)
    k = np.uint64(0xD6E8FEB86659FD93)
    docs, hashes = [], []
    for length in range(1, size + 1):
        if length < size:
            at = csr[:-1][n_words == length]
        else:
            at = np.flatnonzero(doc[: max(0, len(doc) - size + 1)] == doc[size - 1 :])
        s = np.zeros(len(at), np.uint64)
        for j in range(length):
            s = s * k + h[at + j]
        docs.append(doc[at])
        hashes.append(mix(s + np.uint64(length)))
    at, number, count = count_features(np.concatenate(docs), np.concatenate(hashes) >> np.uint64(64 - SHINGLE_BITS), n_docs, SHINGLE_BITS)
    place = (np.arange(len(h)) - csr[:-1][doc]).astype(np.uint64)
    keys = [doc_sums(mix(h ^ mix(place + np.uint64(salt))), csr) for salt in (1 << 40, 3 << 40)]
    return at, number, count, n_words, keys


def cells(number: np.ndarray) -> np.ndarray:
    return (mix(number.astype(np.uint64) + np.uint64(99)) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequency_sketch(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Number of documents behind each cell of a fixed-size table, and of documents with shingles, over all documents.

    A task adds up its own table and sends its parts, so the shuffle and the driver's 8 MB do not grow with a
    document's length or a shingle's popularity.
    """

    def count(table, batch):
        for _, _, buf, offs in text_slices(batch):
            at, number, *_ = shingles(buf, offs, size)
            table[:CELLS] += np.bincount(cells(number), minlength=CELLS)
            table[CELLS] += int((np.diff(at) > 0).sum())

    out = dense_counts(docs.select("text"), CELLS + 1, count)
    return out[:CELLS], int(out[CELLS])


def inverse_frequency(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of each cell, 1 + ln((n + 1) / (df + 1)) / ln(n + 1), from 1 to 2.

    What other shingles add to a cell on average is taken off first (count-mean estimate).
    """
    df = counts - (counts.sum() - counts) / (CELLS - 1)
    df = np.clip(df, 1, max(1, n_docs))
    return (1 + np.log((n_docs + 1) / (df + 1)) / np.log(n_docs + 2)).astype(np.float32)


def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1), log of Gamma(2, 1) and uniform variates, the same in every worker."""
    cache = worker_cache()
    if "icws" not in cache:
        rng = np.random.default_rng(20240229)
        cache["icws"] = tuple(x.astype(np.float32) for x in (rng.gamma(2, 1, VARIATES), np.log(rng.gamma(2, 1, VARIATES)), rng.random(VARIATES)))
    return cache["icws"]


def signatures(at: np.ndarray, number: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents x BANDS) and 32-bit samples of texts that have shingles; ``at`` must have no empty document.

    Two weighted sets get the same sample with a probability that is their weighted Jaccard similarity.
    """
    gamma, log_gamma, beta = variates()
    log_w = np.log(weight).astype(np.float32)
    base = mix(number.astype(np.uint64) + np.uint64(7))
    rng = np.random.default_rng(1618)
    odd = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = np.diff(at)
    out = np.zeros((len(size), BANDS), np.uint64)
    samples = np.zeros((len(size), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        pick = (base * odd[k]) >> np.uint64(64 - VARIATES.bit_length() + 1)
        r, b = gamma[pick], beta[pick]
        t = np.floor(log_w / r + b)
        a = log_gamma[pick] - r * (t - b + 1)
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, at[:-1]), size))
        doc = np.searchsorted(at, least, "right") - 1
        first = least[np.flatnonzero(np.diff(doc, prepend=-1))]
        sample = mix(base[first] ^ (t[first].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        samples[:, k] = sample >> np.uint64(32)
        out[:, k // ROWS] = mix(out[:, k // ROWS] * np.uint64(31) + sample + np.uint64(k + 1))
    return out, samples


def signed(docs: DataFrame, idf: np.ndarray, size: int) -> DataFrame:
    """doc_id, tkey (hash of the text), two keys of the word sequence (null without words), band hashes and samples."""

    def run(batches):
        for batch in batches:
            for i, n, buf, offs in text_slices(batch):
                at, number, count, n_words, keys = shingles(buf, offs, size)
                live = np.flatnonzero(np.diff(at) > 0)
                bands, samples = np.zeros((n, BANDS), np.uint64), np.zeros((n, BANDS * ROWS), np.uint32)
                if len(live):
                    bands[live], samples[live] = signatures(np.append(at[live], at[-1]), number, count * idf[cells(number)])
                empty = n_words == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.astype(np.int64).ravel()))
                cols = [batch.column(0).slice(i, n), batch.column(1).slice(i, n), *[pa.array(x.view(np.int64), mask=empty) for x in keys], lists, pa.array([x.tobytes() for x in samples], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tkey", "k1", "k2", "bands", "samples"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), "text").filter("doc_id is not null")
    return rows.mapInArrow(lean(run), "doc_id long, tkey long, k1 long, k2 long, bands array<long>, samples binary")


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def weighted_sets(texts: pa.Array, idf: np.ndarray, size: int):
    """(row, shingle) keys in order, and their weights, of a few texts."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, _, buf, offs in text_slices(batch):
        at, number, count, *_ = shingles(buf, offs, size)
        keys.append(((owners(at) + i) << SHINGLE_BITS) | number)
        weights.append(count * idf[cells(number)].astype(np.float64))
    return np.concatenate(keys), np.concatenate(weights)


def pair_similarities(a: pa.Array, b: pa.Array, idf: np.ndarray, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of each row's two texts."""
    ka, wa = weighted_sets(a, idf, size)
    kb, wb = weighted_sets(b, idf, size)
    common, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    n = len(a)
    both = np.bincount(common >> SHINGLE_BITS, np.minimum(wa[i], wb[j]), n)
    all_ = np.bincount(ka >> SHINGLE_BITS, wa, n) + np.bincount(kb >> SHINGLE_BITS, wb, n) - both
    return np.divide(both, all_, out=np.zeros(n), where=all_ > 0)


def verified(edges: DataFrame, texts: DataFrame, idf: np.ndarray, size: int, least: float) -> DataFrame:
    """Of the (a, b) candidates those whose texts reach the similarity."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            size_of = np.cumsum(np.array([len(x) + len(y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]))
            i = 0
            while i < batch.num_rows:
                done = size_of[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(size_of, done + (2 << 20), "right")))
                sim = pair_similarities(a.slice(i, j - i), b.slice(i, j - i), idf, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sim)], names=["a", "b", "sim"])
                i = j

    rows = edges.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(lean(run), "a long, b long, sim double").filter(F.col("sim") >= least)


def near_members(blocks: DataFrame, least: int = LEAST_SAMPLES) -> DataFrame:
    """Of the rows (band, hash, i, j, rep, label, x, samples) those with a partner of another label that shares enough samples."""

    def run(table: pa.Table) -> pa.Table:
        samples = np.frombuffer(b"".join(table["samples"].to_pylist()), np.uint32).reshape(table.num_rows, -1)
        label, block = table["label"].to_numpy(), table["x"].to_numpy()
        apart = table["i"][0].as_py() != table["j"][0].as_py()
        keep = np.zeros(table.num_rows, bool)
        for a in range(table.num_rows):
            near = label != label[a]
            if apart:
                near &= block != block[a]
            near = np.flatnonzero(near)
            keep[a] = ((samples[near] == samples[a]).sum(1) >= least).any()
        return table.drop_columns(["samples"]).filter(pa.array(keep))

    return blocks.groupBy("band", "hash", "i", "j").applyInArrow(lean_groups(run), "band int, hash long, i int, j int, rep long, label long, x int")


def block_links(members: DataFrame, reps: DataFrame, texts: DataFrame, idf: np.ndarray, size: int, least: float) -> DataFrame:
    """Links inside buckets whose members are not yet one component.

    members: band, hash, rep, label, n (members of the bucket).  A bucket is cut into blocks of about BLOCK
    members, and each pair of blocks is a task's work.  Their samples (120 bytes a member) tell which members
    have a partner in another component at all; the texts of these alone are sent and compared, pair by pair.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rows = members.join(reps.select("rep", "samples"), "rep")
    rows = rows.withColumn("x", mine).withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("band", "hash", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "rep", "label", "x", "samples")
    rows = staged(near_members(rows), "near-members").join(texts.toDF("rep", "text"), "rep")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        keys, weights = weighted_sets(table["text"].combine_chunks(), idf, size)
        row = keys >> SHINGLE_BITS
        n = table.num_rows
        at = np.searchsorted(row, np.arange(n + 1))
        number = keys & ((1 << SHINGLE_BITS) - 1)
        total = np.bincount(row, weights, n)
        rep, group, block = table["rep"].to_numpy(), table["label"].to_numpy().copy(), table["x"].to_numpy()
        apart = table["i"][0].as_py() != table["j"][0].as_py()
        found = []
        for a in range(n - 1):
            near = np.arange(a + 1, n)
            near = near[(group[near] != group[a]) & (total[near] >= least * total[a]) & (total[near] * least <= total[a])]
            if apart:
                near = near[block[near] != block[a]]
            if not len(near):
                continue
            mine, w = number[at[a] : at[a + 1]], weights[at[a] : at[a + 1]]
            span = np.concatenate([np.arange(at[b], at[b + 1]) for b in near.tolist()])
            where = np.minimum(np.searchsorted(mine, number[span]), len(mine) - 1)
            same = mine[where] == number[span]
            both = np.bincount(row[span][same], np.minimum(weights[span][same], w[where[same]]), n)[near]
            for b in near[both >= least * (total[a] + total[near] - both)].tolist():
                if group[b] != group[a]:
                    found.append((rep[a], rep[b]))
                    group[group == group[b]] = group[a]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("band", "hash", "i", "j").applyInArrow(lean_groups(run), "a long, b long")


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """rep and text of the chosen (doc_id, tkey, rep).  Up to SENT_IDS rows go to the texts; more meet them in a shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
    few = chosen.count() <= SENT_IDS
    return rows.join(F.broadcast(chosen) if few else chosen.hint("shuffle_hash"), ["doc_id", "tkey"]).select("rep", "text")


def representatives(worded: DataFrame) -> DataFrame:
    """One row for each word sequence: k1, k2, doc_id (the smallest), tkey, rep, bands, samples.

    rep is the doc_id; where several different texts share it, the first by its keys has it and the others get
    numbers above all ids.
    """
    first = worded.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "tkey", "bands", "samples")).alias("r")).select("k1", "k2", "r.*")
    first = staged(first, "word-sequences")
    owner = first.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("own"), F.count("*").alias("texts")).filter("texts > 1").select("doc_id", "own")
    other = F.coalesce((F.col("own.k1") != F.col("k1")) | (F.col("own.k2") != F.col("k2")), F.lit(False))
    number = F.lit(FURTHER) + F.pmod(F.xxhash64("k1", "k2"), F.lit(FURTHER))
    return first.join(owner, "doc_id", "left").select("k1", "k2", "doc_id", "tkey", F.when(other, number).otherwise(F.col("doc_id")).alias("rep"), "bands", "samples")


def near_duplicates(docs: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """doc_id, tkey (xxhash64 of the text) and class_id, the smallest doc_id of its class of near-duplicates, for every document.

    Texts with the same words in the same order are one text from the start.  Texts that share a band are
    candidates: a bucket is dealt to SALTS parts, each member is compared with the smallest of its part and these
    with the bucket's smallest; in buckets that still hold several components, members are compared with those of
    other components.  Texts of weighted Jaccard similarity ``least`` and more are linked, and classes are the
    connected components.  Weights are counts times inverse document frequencies.

    A text without words (null, empty) is a class of its own; rows without doc_id are left out.  Repeated rows
    each get their class.  Different texts of one doc_id may be in different classes; all but one count as later
    than every id.  Empty table: no rows.
    """
    counts, n_docs = frequency_sketch(docs, size)
    idf = inverse_frequency(counts, n_docs)
    marks = staged(signed(docs, idf, size), "signatures")
    worded = marks.filter("k1 is not null")
    reps = staged(representatives(worded), "texts")
    part = Window.partitionBy("band", "hash", "s")
    banded = reps.select("rep", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int").alias("s"), F.posexplode("bands").alias("band", "hash"))
    banded = staged(banded.select("rep", "s", "band", "hash", F.min("rep").over(part).alias("sub")), "buckets")
    subs = banded.filter("rep = sub")
    tops = subs.groupBy("band", "hash").agg(F.min("sub").alias("lead"), F.count("*").alias("subs")).filter("subs > 1").select("band", "hash", "lead")
    edges = banded.filter("rep <> sub").select(F.col("sub").alias("a"), F.col("rep").alias("b"))
    edges = edges.union(subs.join(tops, ["band", "hash"]).filter("sub <> lead").select(F.col("lead").alias("a"), F.col("sub").alias("b")))
    edges = staged(edges.distinct(), "candidate-pairs")
    chosen = edges.select(F.col("a").alias("rep")).union(edges.select("b")).distinct()
    chosen = staged(reps.select("doc_id", "tkey", "rep").join(chosen, "rep"), "candidates")
    texts = staged(texts_of(docs, chosen), "candidate-texts")
    links = staged(verified(edges, texts, idf, size, least).select("a", "b"), "links")
    labels = components(links)
    labelled = chosen.select("rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    labelled = staged(banded.select("rep", "s", "band", "hash").join(labelled, "rep"), "labelled")
    mixed = labelled.groupBy("band", "hash").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    mixed = mixed.select("band", "hash", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    rest = labelled.join(mixed, ["band", "hash", "s"]).select("band", "hash", "rep", "label", "n")
    more = staged(block_links(rest, reps, texts, idf, size, least).distinct(), "links")
    labels = components(links.union(more))
    # a class of further texts alone takes the doc_id of its first
    real = labels.filter(F.col("label") >= FURTHER).select("label").distinct().join(reps.select(F.col("rep").alias("label"), "doc_id"), "label")
    classes = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", F.when(F.col("rep") < FURTHER, F.col("rep")).otherwise(F.col("doc_id"))).alias("label"))
    classes = classes.join(real.withColumnRenamed("doc_id", "first"), "label", "left").select("k1", "k2", F.coalesce("first", "label").alias("class_id"))
    out = worded.select("doc_id", "tkey", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "tkey", "class_id")
    return out.union(marks.filter("k1 is null").select("doc_id", "tkey", F.col("doc_id").alias("class_id")))
