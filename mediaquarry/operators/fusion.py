"""Score fusion and ranking: null means not measured, weights renormalise over what is present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered

#: The default weights.
WEIGHTS = {"sharpness": 0.22, "exposure": 0.18, "noise": 0.06, "contrast": 0.06, "technical_iqa": 0.14, "aesthetic": 0.08, "composition": 0.08, "face_quality": 0.18}


def fuse(signals: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """value, coverage and live signals of each row.

    value: weighted mean of the present signals.  coverage: their weight over the applicable weight; the face
    weight is inapplicable only where detection ran and found none.
    """
    total = lambda xs: sum(xs[1:], xs[0])
    live = total([F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(0.0) for n, w in weights.items()])
    mass = total([F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in weights.items()])
    applicable = F.when(F.col("face_state") == "none", F.lit(sum(w for n, w in weights.items() if n != "face_quality"))).otherwise(F.lit(sum(weights.values())))
    present = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in weights]))
    out = signals.withColumns({"live": live, "value": F.when(live > 0, F.bround(mass / live, 6)), "coverage": F.bround(F.least(live / applicable, F.lit(1.0)), 6), "signal_set": F.array_join(present, ",")})
    return out


def explain(signals: DataFrame, top: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The signals that contribute most, by value times share, ties by name."""
    live = sum((F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    parts = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct((-F.round(F.col(n) * w / live, 9)).alias("minus"), F.lit(n).alias("signal"))) for n, w in weights.items()]))
    return signals.select("media_id", F.transform(F.slice(F.array_sort(parts), 1, top), lambda p: p["signal"]).alias("signals"))


def aggregate_faces(faces: DataFrame) -> DataFrame:
    """0.45 least + 0.20 nearest-rank tenth + 0.20 mean + 0.15 share of open eyes; the last drops out where eyes are unknown."""
    open_ = F.avg(F.when(F.col("eyes_open").isNotNull(), (F.col("eyes_open") >= 0.5).cast("double")))
    rows = faces.filter("quality IS NOT NULL").groupBy("media_id").agg(
        F.min("quality").alias("lo"), F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY quality)").alias("p10"), F.avg("quality").alias("mean"), open_.alias("eyes"), F.count("*").alias("faces")
    )
    core = 0.45 * F.col("lo") + 0.20 * F.col("p10") + 0.20 * F.col("mean")
    return rows.select("media_id", "faces", F.round(F.when(F.col("eyes").isNull(), core / 0.85).otherwise(core + 0.15 * F.col("eyes")), 6).alias("face_quality"))


def face_statistics(faces: DataFrame) -> DataFrame:
    """Counts over two area floors, largest area, eyes and smiles with an interpolated tenth."""
    return faces.groupBy("media_id").agg(
        F.count_if(F.col("area") >= 0.1).alias("large"),
        F.count_if(F.col("area") >= 0.3).alias("very_large"),
        F.max("area").alias("max_area"),
        F.min("eyes_open").alias("min_eyes"),
        F.round(F.expr("percentile(eyes_open, 0.1)"), 6).alias("p10_eyes"),
        F.round(F.avg("eyes_open"), 6).alias("mean_eyes"),
        F.min("smile").alias("min_smile"),
        F.round(F.avg("smile"), 6).alias("mean_smile"),
    )


def people_summary(faces: DataFrame) -> DataFrame:
    confirmed = F.when(F.col("eligible"), F.col("person_id"))
    return faces.groupBy("media_id").agg(F.sort_array(F.collect_set(confirmed)).alias("people"), F.count_if(~F.col("eligible")).alias("pending"))


def counts_with_fallback(media: DataFrame, faces: DataFrame, fallback: str) -> DataFrame:
    n = faces.groupBy("media_id").agg(F.count("*").alias("n"))
    return media.join(n, "media_id", "left").select("media_id", F.coalesce("n", fallback).alias("face_count"))


def standing(rows: DataFrame, klass: str, value: str, prior: float = 4.0) -> DataFrame:
    """Cumulative share within a measurement class, shrunk towards the value by a few pseudo members."""
    w = Window.partitionBy(klass)
    raw = F.cume_dist().over(w.orderBy(value))
    n = F.count("*").over(w)
    return rows.withColumn("standing", F.bround((raw * n + F.col(value) * prior) / (n + prior), 6))


def mid_rank(rows: DataFrame, klass: str, value: str) -> DataFrame:
    """(below + equal / 2) / n among measured rows; 0.5 for the others."""
    measured = F.col(value).isNotNull()
    w = Window.partitionBy(klass, measured)
    below = F.rank().over(w.orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(klass, measured, value))
    return rows.withColumn("percentile", F.when(measured, F.bround((below + equal / 2) / F.count("*").over(w), 6)).otherwise(0.5))


def rank_best(rows: DataFrame, klass: str, value: str, rejected: Column) -> DataFrame:
    """Place of each row, rejected last, ties by id; more than one measurement class is an error."""
    kinds = rows.agg((F.min(klass) < F.max(klass)).alias("classes_differ"))
    # rejected rows lie behind all values, rows without a value behind the others of their sort
    key = F.when(rejected, F.lit(2.0)).otherwise(0.0) + F.when(F.col(value).isNull(), 1.0).otherwise(0.5 - F.atan(F.col(value)) / 4)
    out = numbered(rows, key, [rejected.asc(), F.desc(value), F.col("media_id").asc()], "place").crossJoin(F.broadcast(kinds))
    differ = F.coalesce("classes_differ", F.lit(False))
    return out.withColumn("place", F.when(differ, F.raise_error(F.lit("measurement classes differ")).cast("int")).otherwise(F.col("place").cast("int"))).drop("classes_differ")


def primary_of_group(rows: DataFrame) -> DataFrame:
    """The primary of each duplicate group: favourites, then quality, then id."""
    w = Window.partitionBy("group_id").orderBy(F.desc("favorite"), F.desc_nulls_last("quality"), "media_id")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
