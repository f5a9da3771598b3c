"""Ordered frame sequences: runs, windows, stabbing joins, snap points and cuts, one partition for each medium."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of frame elimination.
BLACK, SHAKY, STILL = 0.02, 0.55, 0.02


def by_frame() -> Window:
    return Window.partitionBy("media_id").orderBy("frame")


def runs(frames: DataFrame, mask: Column) -> DataFrame:
    """Maximal runs of frames where the mask holds, half-open: media_id, lo, hi."""
    rows = frames.select("media_id", "frame", F.coalesce(mask, F.lit(False)).alias("on")).filter("on")
    island = F.col("frame") - F.row_number().over(by_frame())
    return rows.withColumn("island", island).groupBy("media_id", "island").agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi")).drop("island")


def dead_time(frames: DataFrame, least: int, speech_share: float = 0.2) -> DataFrame:
    """Runs of stillness of at least ``least`` frames, unless people speak in more than a share of them."""
    still = runs(frames, F.col("motion") <= STILL).filter(F.col("hi") - F.col("lo") >= least)
    f = frames.select(F.col("media_id").alias("m"), "frame", "speech")
    inside = still.join(f, (F.col("media_id") == F.col("m")) & (F.col("frame") >= F.col("lo")) & (F.col("frame") < F.col("hi")))
    talk = inside.groupBy("media_id", "lo", "hi").agg(F.avg(F.col("speech").cast("double")).alias("talk"))
    return talk.filter(F.col("talk") <= speech_share).select("media_id", "lo", "hi")


def elimination(frames: DataFrame) -> DataFrame:
    """Reasons against each frame in fixed order; what is not measured never counts against it."""
    reasons = F.array_compact(F.array(F.when(F.col("luma") <= BLACK, "black"), F.when(F.col("shake") >= SHAKY, "shaky"), F.when(F.col("motion") <= STILL, "still")))
    return frames.select("media_id", "frame", reasons.alias("reasons"))


def covered_aggregate(frames: DataFrame, windows: DataFrame, column: str, coverage: float = 0.5) -> DataFrame:
    """Mean, most and least of a signal in half-open windows, null where fewer than a share of frames is measured."""
    f = frames.select(F.col("media_id").alias("m"), "frame", F.col(column).alias("x"))
    rows = windows.join(f, (F.col("media_id") == F.col("m")) & (F.col("frame") >= F.col("lo")) & (F.col("frame") < F.col("hi")), "left")
    out = rows.groupBy("media_id", "lo", "hi").agg(F.count("x").alias("n"), F.avg("x").alias("a"), F.max("x").alias("b"), F.min("x").alias("c"))
    enough = F.col("n") >= F.ceil(F.lit(coverage) * (F.col("hi") - F.col("lo")))
    return out.select("media_id", "lo", "hi", *[F.when(enough, F.round(v, 6)).alias(n) for v, n in (("a", "mean"), ("b", "most"), ("c", "least"))])


def hopping(segments: DataFrame, width: int, hop: int) -> DataFrame:
    """Windows of ``width`` every ``hop`` frames inside each segment, and one that ends with it."""
    starts = F.array_distinct(F.array_append(F.sequence(F.col("lo"), F.col("hi") - width, F.lit(hop).cast("long")), F.col("hi") - width))
    rows = segments.filter(F.col("hi") - F.col("lo") >= width).select("media_id", F.explode(starts).alias("start"))
    return rows.select("media_id", F.col("start").alias("lo"), (F.col("start") + width).alias("hi"))


def local_maxima(frames: DataFrame, column: str, radius: int) -> DataFrame:
    """Frames whose value no frame in the radius exceeds, the earliest of equals."""
    w = by_frame()
    before = F.max(column).over(w.rangeBetween(-radius, -1))
    after = F.max(column).over(w.rangeBetween(1, radius))
    x = F.col(column)
    rows = frames.withColumn("peak", x.isNotNull() & F.coalesce(x > before, F.lit(True)) & F.coalesce(x >= after, F.lit(True)))
    return rows.filter("peak").drop("peak")


def segments_in_shots(clean: DataFrame, shots: DataFrame) -> DataFrame:
    """Intersections of clean runs with shots that are not empty."""
    a = clean.select("media_id", F.col("lo").alias("a"), F.col("hi").alias("b"))
    b = shots.select(F.col("media_id").alias("m"), F.col("lo").alias("c"), F.col("hi").alias("d"))
    rows = a.join(b, F.col("media_id") == F.col("m")).select("media_id", F.greatest("a", "c").alias("lo"), F.least("b", "d").alias("hi"))
    return rows.filter("lo < hi")


def shots(frames: DataFrame) -> DataFrame:
    """Spans between boundaries, half-open."""
    no = F.sum(F.col("boundary").cast("int")).over(by_frame().rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("shot", no).groupBy("media_id", "shot").agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi")).drop("shot")


def inside_word(points: DataFrame, words: DataFrame) -> DataFrame:
    """Points strictly inside a span, with the first such span."""
    w = words.select(F.col("media_id").alias("m"), F.col("lo").alias("ws"), F.col("hi").alias("we"))
    rows = points.join(w, (F.col("media_id") == F.col("m")) & (F.col("ws") < F.col("frame")) & (F.col("frame") < F.col("we")))
    return rows.groupBy("media_id", "frame").agg(F.min(F.struct("ws", "we")).alias("s")).select("media_id", "frame", F.col("s.ws").alias("lo"), F.col("s.we").alias("hi"))


def nearest_beat(points: DataFrame, beats: DataFrame) -> DataFrame:
    """The nearest beat of each point, the earlier one on ties, by two running windows and no pairs."""
    rows = points.select("media_id", "frame", F.lit(None).cast("long").alias("beat")).unionByName(beats.select("media_id", "frame", F.col("frame").cast("long").alias("beat")))
    w = Window.partitionBy("media_id").orderBy("frame", F.col("beat").isNull())
    back = F.last("beat", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("beat", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = rows.withColumn("back", back).withColumn("ahead", ahead).filter("beat IS NULL")
    near = F.when(F.col("ahead").isNull() | (F.col("frame") - F.col("back") <= F.col("ahead") - F.col("frame")), F.col("back")).otherwise(F.col("ahead"))
    return x.select("media_id", "frame", F.coalesce(near, "ahead").alias("beat"))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Touching and overlapping half-open ranges as one."""
    w = Window.partitionBy("media_id").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = ranges.withColumn("reach", reach).withColumn("island", island)
    return rows.groupBy("media_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def loudness(frames: DataFrame, column: str, half: int) -> DataFrame:
    """Mean square in a window around each frame as decibels between -80 and 0."""
    w = by_frame().rowsBetween(-half, half - 1)
    square = F.avg(F.col(column) * F.col(column)).over(w)
    db = F.when(square > 0, 10 * F.log10(square)).otherwise(-80.0)
    return frames.select("media_id", "frame", F.round(F.greatest(F.least(db, F.lit(0.0)), F.lit(-80.0)), 6).alias("db"))


def silence_runs(levels: DataFrame, floor: float, least: int) -> DataFrame:
    """Runs [lo, hi) of frames whose level is measured and under the floor, of ``least`` frames and more.  levels: media_id, frame, db."""
    return runs(levels, F.col("db") < floor).filter(F.col("hi") - F.col("lo") >= least)


def rises(frames: DataFrame, column: str, least: float) -> DataFrame:
    step = F.col(column) - F.lag(column).over(by_frame())
    return frames.withColumn("step", step).groupBy("media_id").agg(F.count_if(F.col("step") >= least).alias("rises"))


def exposure_stability(frames: DataFrame, half: int) -> DataFrame:
    w = by_frame().rowsBetween(-half, half)
    return frames.select("media_id", "frame", F.round(F.greatest(1 - F.stddev_pop("luma").over(w) / 0.1, F.lit(0.0)), 6).alias("stability"))


def tempo_anomalies(beats: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Beats whose interval to the next differs from the median by the ratio, with the local rate a minute."""
    interval = F.lead("frame").over(by_frame()) - F.col("frame")
    rows = beats.select("media_id", "frame", interval.alias("i")).filter("i IS NOT NULL")
    rows = rows.withColumn("mid", F.median("i").over(Window.partitionBy("media_id")))
    return rows.filter((F.col("i") > F.col("mid") * ratio) | (F.col("i") * ratio < F.col("mid"))).select("media_id", "frame", F.col("i").alias("interval"), F.round(60 / F.col("i"), 6).alias("bpm"))


def representative(frames: DataFrame) -> DataFrame:
    """The frame with the best blend of sharpness, steadiness and light; the first of equals."""
    parts = [("sharpness", F.col("sharpness"), 0.5), ("shake", 1 - F.col("shake"), 0.3), ("luma", F.col("luma"), 0.2)]
    live = sum((F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(0.0) for n, _, w in parts), F.lit(0.0))
    mass = sum((F.coalesce(x * w, F.lit(0.0)) for _, x, w in parts), F.lit(0.0))
    rows = frames.withColumn("v", F.when(live > 0, F.round(mass / live, 9)))
    return rows.filter("v IS NOT NULL").groupBy("media_id").agg(F.max_by("frame", F.struct("v", -F.col("frame"))).alias("frame"))


def best_snap(targets: DataFrame, points: DataFrame, reach: int) -> DataFrame:
    """Of the snap points in reach the one with most strength less a quarter of its distance; ties by distance, then earlier."""
    p = points.select(F.col("media_id").alias("m"), F.col("frame").alias("snap"), "strength")
    near = targets.join(p, (F.col("media_id") == F.col("m")) & F.col("snap").between(F.col("frame") - reach, F.col("frame") + reach))
    away = F.abs(F.col("snap") - F.col("frame"))
    w = Window.partitionBy("media_id", "frame").orderBy(F.desc(F.round(F.col("strength") - 0.25 * away, 9)), away, "snap")
    return near.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("media_id", "frame", "snap")


def acts(moments: DataFrame, score: str) -> DataFrame:
    """Roles by successive argmax: the hook is the best, the peak the best of the rest, the button the latest of what is left."""
    w = Window.partitionBy("media_id")
    rows = moments.withColumn("rn", F.row_number().over(w.orderBy(F.desc(score), "frame")))
    rest = F.when(F.col("rn") > 2, F.col("frame"))
    last = F.max(rest).over(w)
    role = F.when(F.col("rn") == 1, "hook").when(F.col("rn") == 2, "peak").when(F.col("frame") == last, "button")
    return rows.select("media_id", "frame", role.alias("role")).filter("role IS NOT NULL")


def lookback_pairs(items: DataFrame, back: int, seconds: float) -> DataFrame:
    """Each item with its predecessors among the last ``back`` and within the time: a lag, not a join."""
    w = by_frame()
    found = F.array_compact(F.array(*[F.when(F.col("us") - F.lag("us", k).over(w) <= seconds * 1e6, F.lag("item", k).over(w)) for k in range(1, back + 1)]))
    return items.select("item", found.alias("found")).select("item", F.explode("found").alias("earlier"))


def suppress(windows: DataFrame, radius: float) -> DataFrame:
    """Temporal non-maximum suppression: the best first, any with its centre within the radius of a kept one goes."""
    import pandas as pd

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "lo"], ascending=[False, True])
        centre = ((pdf["lo"] + pdf["hi"]) / 2).tolist()
        kept: list[int] = []
        for i, c in enumerate(centre):
            if all(abs(c - centre[k]) > radius for k in kept):
                kept.append(i)
        return pdf.iloc[kept]

    return windows.groupBy("media_id").applyInPandas(keep, windows.schema)


def plan_moments(frames: DataFrame, width: int, hop: int, apart: float, pull: int, score: str = "sharpness") -> DataFrame:
    """Moments of each media from its frames, end to end, and what was eliminated: media_id, lo, hi, status, score, reasons.

    Frames that are black, shaky or still fall out; runs of the rest are cut into hopping windows, the best windows
    are kept far enough apart, and their ends are pulled to a shot boundary within ``pull`` frames.  Runs of frames
    that fell out are listed with all their reasons.
    """
    out = elimination(frames)
    marked = frames.join(out, ["media_id", "frame"])
    bad = F.size("reasons") > 0
    best = suppress(covered_aggregate(frames, hopping(runs(marked, ~bad), width, hop), score).filter("mean IS NOT NULL").selectExpr("media_id", "lo", "hi", "mean AS score"), apart)
    shots = frames.filter("boundary").select(F.col("media_id").alias("m"), F.col("frame").alias("cut"))
    near = best.join(shots, (F.col("media_id") == F.col("m")) & (F.abs(F.col("cut") - F.col("lo")) <= pull), "left")
    near = near.groupBy("media_id", "lo", "hi", "score").agg(F.min(F.struct(F.abs(F.col("cut") - F.col("lo")).alias("d"), "cut")).alias("near"))
    kept = near.select("media_id", F.coalesce(F.when(F.col("near.d").isNotNull(), F.col("near.cut")), F.col("lo")).alias("lo"), "hi", F.lit("kept").alias("status"), F.round("score", 6).alias("score"), F.array().cast("array<string>").alias("reasons"))
    gone = runs(marked, bad).alias("r").join(marked.alias("f"), (F.col("r.media_id") == F.col("f.media_id")) & (F.col("f.frame") >= F.col("r.lo")) & (F.col("f.frame") < F.col("r.hi")))
    gone = gone.groupBy(F.col("r.media_id").alias("media_id"), "lo", "hi").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    return kept.unionByName(gone.select("media_id", "lo", "hi", F.lit("eliminated").alias("status"), F.lit(None).cast("double").alias("score"), "reasons"))
