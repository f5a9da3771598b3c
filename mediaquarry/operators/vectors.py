"""Vector operators: cosine search, similarity joins, centroids and galleries over array columns."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors in a part of a block whose pairs are a task's work (with those of another part), and rows of one matrix product.
SIDE, ROWS = 4096, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine with norms computed; a zero vector or unequal sizes are an error, not a number."""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal size")).cast("double"))
    n = norm(a) * norm(b)
    return checked.when(n == 0, F.raise_error(F.lit("zero vector")).cast("double")).otherwise(1 - dot(a, b) / n)


def nearest(vectors: DataFrame, query: list[float], k: int, restrict_to: DataFrame | None = None, max_distance: float | None = None) -> DataFrame:
    """The k nearest owners by (distance, id); ``restrict_to`` is a semi-join made before any distance."""
    rows = vectors if restrict_to is None else vectors.join(restrict_to, "vec_id", "left_semi")
    rows = rows.withColumn("distance", F.round(cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 6))
    if max_distance is not None:
        rows = rows.filter(F.col("distance") <= max_distance)
    return rows.orderBy("distance", "vec_id").limit(k)


def similar(vectors: DataFrame, vec_id: int, k: int, max_distance: float | None = None) -> DataFrame:
    """The k nearest to a stored vector, without itself; no rows if it is not stored."""
    one = vectors.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("probe")).limit(1)
    rows = vectors.filter(F.col("vec_id") != vec_id).join(F.broadcast(one))
    rows = rows.withColumn("distance", F.round(cosine_distance(F.col("embedding"), F.col("probe")), 6)).drop("probe")
    if max_distance is not None:
        rows = rows.filter(F.col("distance") <= max_distance)
    return rows.orderBy("distance", "vec_id").limit(k)


def flat_vectors(lists: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix; those with a null element are NaN, and unequal sizes are an error."""
    if len(np.unique(lists.value_lengths().to_numpy())) > 1:
        raise ValueError("vectors of unequal size")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def rounded_distances(near: np.ndarray, a: np.ndarray, b: np.ndarray, v: np.ndarray, length: np.ndarray, digits: int) -> np.ndarray:
    """Distances from a matrix product, of rows a and b of v, rounded half up.

    A product adds in another order than ``dot``; where that could matter, at the border of two decimals, the
    distance is taken once more in the order of the elements.
    """
    scaled = near * 10.0**digits
    out = np.rint(scaled) / 10.0**digits + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4).tolist():
        x = 1 - np.cumsum(v[a[i]] * v[b[i]])[-1] / (length[a[i]] * length[b[i]])
        out[i] = float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def close_pairs(vectors: DataFrame, max_distance: float, block: str, digits: int, side: int = SIDE) -> DataFrame:
    """block, a, b and distance (rounded) of all pairs a < b of one block within a rounded cosine distance.

    The vectors of a block are dealt to parts of about ``side``, and each pair of parts is a task's work, by matrix
    products; so a block of any size is spread over the cluster, and only pairs within the distance become rows.
    A null vector is in no pair; a zero vector or unequal sizes are an error where a pair has them.
    """
    rows = vectors.select(F.col(block).alias("block"), "vec_id", "embedding").filter("block IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL")
    parts = rows.groupBy("block").agg(F.ceil(F.count("*") / side).cast("int").alias("parts")).withColumnRenamed("block", "of_block")
    rows = rows.join(parts, F.col("block") == F.col("of_block")).withColumn("x", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("block", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "vec_id", "embedding")
    kinds = T.StructType([rows.schema["block"], *[T.StructField(x, rows.schema["vec_id"].dataType) for x in "ab"], T.StructField("distance", T.DoubleType())])

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        table = table.take(pa.compute.sort_indices(table["vec_id"]))
        ids = table["vec_id"].combine_chunks()
        if len(ids) < 2:
            return
        v = flat_vectors(table["embedding"].combine_chunks())
        length = np.sqrt(np.cumsum(v * v, axis=1)[:, -1]) if v.shape[1] else np.zeros(len(v))
        rank = pa.compute.rank(ids, tiebreaker="dense").to_numpy()
        x = table["x"].to_numpy()
        apart = table["i"][0].as_py() != table["j"][0].as_py()
        if (length == 0).any() and rank[-1] > rank[0] and (not apart or len(np.unique(x)) > 1):
            raise ValueError("zero vector")
        unit = v / length[:, None]
        left, right = (np.flatnonzero(x == x.min()), np.flatnonzero(x != x.min())) if apart else (np.arange(len(x)), np.arange(len(x)))
        if not len(right):
            return
        other, least = unit[right].T, 1 - max_distance - 10.0**-digits
        for at in range(0, len(left), ROWS):
            mine = left[at : at + ROWS]
            first = 0 if apart else at
            s = unit[mine] @ other[:, first:]
            p, q = np.divmod(np.flatnonzero(s >= least), s.shape[1])
            near = 1 - s[p, q]
            p, q = mine[p], right[first + q]
            fine = rank[p] != rank[q] if apart else rank[p] < rank[q]
            p, q, near = np.minimum(p, q)[fine], np.maximum(p, q)[fine], near[fine]
            near = rounded_distances(near, p, q, v, length, digits)
            fine = near <= max_distance
            if fine.any():
                yield pa.RecordBatch.from_arrays([pa.repeat(table["block"][0], int(fine.sum())), ids.take(pa.array(p[fine])), ids.take(pa.array(q[fine])), pa.array(near[fine])], names=["block", "a", "b", "distance"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            yield from run(batches)

    return rows.groupBy("block", "i", "j").applyInArrow(work, kinds)


def pairs_within(vectors: DataFrame, max_distance: float, block: str) -> DataFrame:
    """Pairs a < b of one block (a place, a label, a bucket) within a cosine distance, rounded to six decimals."""
    return close_pairs(vectors, max_distance, block, 6).select("a", "b", "distance")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean of each dimension, scaled to length one, as (group, pos, value); a zero mean is an error."""
    means = vectors.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group)))
    value = F.when(length == 0, F.raise_error(F.lit("zero centroid")).cast("double")).otherwise(F.col("m") / length)
    return means.select(group, "pos", F.round(value, 6).alias("value"))


def block_scores(probes: DataFrame, gallery: DataFrame, group: str, k: int, block: int = 4096) -> DataFrame:
    """(probe, group, vec_id, s): the k stored vectors of each group most alike to each probe, by cosine similarity.

    Probes are a stated query set; they go out in blocks of about ``block`` vectors, each met by the whole gallery
    as a matrix product.  A task keeps the k best of each probe and group before anything is shuffled.
    """
    n = probes.count()
    blocks = max(1, -(-n // block))
    numbers = probes.sparkSession.createDataFrame([], "probe long, grp long, vec_id long, s double")
    for at in range(blocks):
        part = probes.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == at).select("vec_id", "embedding").toArrow()
        if part.num_rows:
            numbers = numbers.union(_scored(part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy(zero_copy_only=False)).astype(float), gallery, group, k))
    w = Window.partitionBy("probe", "grp").orderBy(F.desc("s"), "vec_id")
    return numbers.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def _scored(ids: np.ndarray, asked: np.ndarray, gallery: DataFrame, group: str, k: int) -> DataFrame:
    length = np.linalg.norm(asked, axis=1)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, grp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            v = np.stack(batch.column(2).to_numpy(zero_copy_only=False)).astype(float)
            s = asked @ v.T / (length[:, None] * np.linalg.norm(v, axis=1))
            probe, at = np.nonzero(ids[:, None] != own[None])
            new = probe, grp[at], own[at], s[probe, at]
            probe, grp, own, s = new if held is None else tuple(map(np.concatenate, zip(held, new, strict=True)))
            order = np.lexsort((own, -s, grp, probe))
            probe, grp, own, s = probe[order], grp[order], own[order], s[order]
            first = np.flatnonzero((np.diff(probe, prepend=-1) != 0) | (np.diff(grp, prepend=grp[:1] - 1) != 0))
            rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
            held = tuple(x[rank < k] for x in (probe, grp, own, s))
        if held is not None:
            probe, grp, own, s = held
            yield pa.RecordBatch.from_arrays([pa.array(ids[probe]), pa.array(grp), pa.array(own), pa.array(s)], names=["probe", "grp", "vec_id", "s"])

    rows = gallery.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(group).cast("long").alias("grp"), "embedding")
    return rows.mapInArrow(run, "probe long, grp long, vec_id long, s double")


def gallery_similarity(probes: DataFrame, gallery: DataFrame, k: int, keep: int | None = None) -> DataFrame:
    """For each probe and person the mean of the k best similarities, and the best ``keep`` persons of each probe."""
    out = block_scores(probes, gallery, "label", k).groupBy("probe", F.col("grp").cast(gallery.schema["label"].dataType).alias("label")).agg(F.round(F.avg("s"), 6).alias("similarity"))
    if keep is None:
        return out
    top = Window.partitionBy("probe").orderBy(F.desc("similarity"), "label")
    return out.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= keep)


def sign_hash(embedding: Column) -> Column:
    """64 sign bits of a vector as 16 hex digits."""
    nibbles = F.transform(
        F.sequence(F.lit(0), F.lit(60), F.lit(4)),
        lambda i: F.aggregate(F.slice(embedding, i + 1, 4), F.lit(0), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0)),
    )
    return F.array_join(F.transform(nibbles, lambda n: F.lower(F.hex(n))), "")


def band_pairs(hashes: DataFrame, bands: int = 4, bucket_cap: int = 512) -> DataFrame:
    """Distinct pairs a < b that share a slice of their hash at the same place.

    Buckets of more than ``bucket_cap`` members are left out: that is the operator's definition.
    """
    width = 16 // bands
    sliced = hashes.select("vec_id", "hash", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).withColumn("slice", F.expr(f"substr(hash, band * {width} + 1, {width})"))
    sizes = sliced.groupBy("band", "slice").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= bucket_cap)).select("band", "slice")
    live = sliced.join(sizes, ["band", "slice"]).select("band", "slice", "vec_id", "hash")
    other = live.select("band", "slice", F.col("vec_id").alias("b"), F.col("hash").alias("hb"))
    return live.withColumnsRenamed({"vec_id": "a", "hash": "ha"}).join(other, ["band", "slice"]).filter("a < b").select("a", "b", "ha", "hb").distinct()


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits; other lengths are an error."""
    half = lambda x, i: F.conv(F.substring(x, i, 8), 16, 10).cast("long")
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    bad = (F.length(a) != 16) | (F.length(b) != 16)
    return F.when(bad, F.raise_error(F.lit("hash length")).cast("int")).otherwise(bits).cast("int")


def pairwise_scores(assigned: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Pairwise precision and recall of a clustering from group sizes alone, without any pair."""
    pairs = lambda cols: assigned.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("x"))
    both, p, t = pairs([predicted, truth]), pairs([predicted]), pairs([truth])
    rows = both.toDF("tp").crossJoin(p.toDF("pp")).crossJoin(t.toDF("tt"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0), 6)
    return rows.select(F.col("tp").alias("true_pairs"), ratio("tp", "pp").alias("precision"), ratio("tp", "tt").alias("recall"))
