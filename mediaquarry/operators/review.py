"""Floors with waivers, decision logs, shot groups, box suppression, beat audits and decayed novelty."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def quality_floor(candidates: DataFrame, floor: float, scarce_below: int) -> DataFrame:
    """Verdict of each candidate against the floor: pass, rescued (the best of a person whom nothing above the floor shows), or below.

    Only persons shown in fewer than ``scarce_below`` candidates are rescued.  candidates: media_id, score, person.
    """
    above = candidates.filter(F.col("score") >= floor).select("person").filter("person IS NOT NULL").distinct()
    rare = candidates.filter("person IS NOT NULL").groupBy("person").agg(F.count("*").alias("n")).filter(F.col("n") < scarce_below).select("person")
    open_ = rare.join(above, "person", "left_anti")
    w = Window.partitionBy("person").orderBy(F.desc("score"), "media_id")
    best = candidates.filter("score IS NOT NULL").join(open_, "person", "left_semi").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("media_id", F.lit(True).alias("saved"))
    verdict = F.when(F.col("score") >= floor, "pass").when(F.coalesce("saved", F.lit(False)), "rescued").otherwise("below")
    return candidates.join(best, "media_id", "left").select("media_id", verdict.alias("verdict"))


def fold_decisions(log: DataFrame) -> DataFrame:
    """State of each face after its decisions in order, each counted once: confirm, reject, merge, revoke.

    A decision is identified by its content, so replaying a log changes nothing.  log: face, seq, kind, person.
    """
    once = log.groupBy("face", "kind", "person").agg(F.min("seq").alias("seq"))
    steps = once.groupBy("face").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "person"))).alias("steps"))
    start = F.struct(F.lit(None).cast("long").alias("person"), F.lit("open").alias("state"))
    step = lambda s, x: (
        F.when(x["kind"] == "confirm", F.struct(x["person"].alias("person"), F.lit("confirmed").alias("state")))
        .when((x["kind"] == "reject") & s["person"].eqNullSafe(x["person"]), F.struct(F.lit(None).cast("long").alias("person"), F.lit("rejected").alias("state")))
        .when((x["kind"] == "merge") & (s["state"] == "confirmed"), F.struct(x["person"].alias("person"), s["state"].alias("state")))
        .when(x["kind"] == "revoke", F.struct(F.lit(None).cast("long").alias("person"), F.lit("revoked").alias("state")))
        .otherwise(s)
    )
    return steps.select("face", F.aggregate("steps", start, step).alias("s")).select("face", "s.person", "s.state")


def shot_groups(pairs: DataFrame, items: DataFrame, ratio: float) -> DataFrame:
    """Components of look-back pairs, split by bands of subject size: band of log(largest / own) to the base ``ratio``.

    items: item, area.
    """
    rows = items.join(components(pairs.select(F.col("item").alias("a"), F.col("earlier").alias("b"))).withColumnRenamed("id", "item"), "item")
    largest = F.max("area").over(Window.partitionBy("label"))
    return rows.select("item", F.col("label").alias("shot"), F.floor(F.log2(largest / F.col("area")) / np.log2(ratio)).alias("band"))


def box_suppression(boxes: DataFrame, overlap: float) -> DataFrame:
    """Of each image's boxes the best first; any that overlaps a kept one beyond the share goes.  boxes: image, id, x, y, w, h, score."""

    def keep(b: pd.DataFrame) -> pd.DataFrame:
        x, y, w, h = (b[c].to_numpy() for c in "xywh")
        area, live, kept = w * h, np.ones(len(b), bool), np.zeros(len(b), bool)
        at = np.flatnonzero(np.diff(b["image"].to_numpy(), prepend=-1, append=-1))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            for i in range(lo, hi):
                if live[i]:
                    kept[i] = True
                    r = slice(i + 1, hi)
                    cut = np.clip(np.minimum(x[r] + w[r], x[i] + w[i]) - np.maximum(x[r], x[i]), 0, None) * np.clip(np.minimum(y[r] + h[r], y[i] + h[i]) - np.maximum(y[r], y[i]), 0, None)
                    live[r] &= cut <= overlap * (area[r] + area[i] - cut)
        return b.loc[kept, ["image", "id"]]

    def run(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b["image"] == b["image"].iloc[-1] if len(b) else None
            if last is not None:
                yield keep(b[~last].reset_index(drop=True))
                rest = b[last].reset_index(drop=True)
        if rest is not None:
            yield keep(rest)

    rows = boxes.select("image", "id", "x", "y", "w", "h", "score").repartition("image").sortWithinPartitions("image", F.desc("score"), "id")
    return rows.mapInPandas(run, "image long, id long")


def audit_cuts(plan: DataFrame, beats: DataFrame, gate: float) -> DataFrame:
    """Declared cuts held against the beats: wrong downbeat flag, wrong error, error beyond the gate.

    plan: cut, beat, at, error, downbeat; beats: beat, seconds, downbeat.
    """
    b = beats.select("beat", "seconds", F.col("downbeat").alias("is_down"))
    rows = plan.join(b, "beat", "left")
    true = F.abs(F.col("at") - F.col("seconds"))
    found = F.array_compact(F.array(F.when(F.col("seconds").isNull(), "no_such_beat"), F.when(F.col("downbeat") != F.col("is_down"), "downbeat_flag"), F.when(F.abs(true - F.col("error")) > 1e-6, "error_differs"), F.when(true > gate, "beyond_gate")))
    return rows.select("cut", found.alias("found")).select("cut", F.explode("found").alias("finding"))


def bleed_findings(placements: DataFrame, bleed: float) -> DataFrame:
    """Edges whose overhang is short of a declared bleed, or there undeclared.  placements: id, edges (map), declared (array)."""
    rows = placements.select("id", "declared", F.explode("overhang").alias("edge", "over"))
    said = F.array_contains("declared", F.col("edge"))
    finding = F.when(said & (F.col("over") < bleed), "short_bleed").when(~said & (F.col("over") > 0), "undeclared_spill")
    return rows.select("id", "edge", finding.alias("finding")).filter("finding IS NOT NULL")


def decayed_novelty(frames: DataFrame, column: str, decay: float) -> DataFrame:
    """Distance of each frame from the exponentially decayed mean of all frames before it in its media.

    Frames come sorted to a task, which carries the mean from row to row, so a media of any length needs no group in memory.
    """

    def run(batches):
        media, total, mass = None, 0.0, 0.0
        for batch in batches:
            out = []
            for m, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if m != media:
                    media, total, mass = m, 0.0, 0.0
                out.append(abs(x - total / mass) if mass > 0 and x is not None else None)
                total, mass = (total + (x or 0.0)) * decay, (mass + (x is not None)) * decay
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["media_id", "frame", "novelty"])

    rows = frames.select(F.col("media_id").cast("long").alias("media_id"), F.col("frame").cast("long").alias("frame"), F.col(column).cast("double").alias("x"))
    out = rows.repartition("media_id").sortWithinPartitions("media_id", "frame").mapInArrow(run, "media_id long, frame long, novelty double")
    return out.select("media_id", "frame", F.round("novelty", 6).alias("novelty"))


def merge_questions(reps: DataFrame, near: DataFrame, apart: DataFrame, threshold: float, window: float) -> DataFrame:
    """Pairs of clusters that nearly merged: every pair of their representatives lies within the window, the farthest beyond the threshold.

    reps: vec_id, cluster; near: a, b, distance, the pairs within threshold + window, from a similarity join, so no two
    clusters meet that are not near; apart: pairs said to be different people, whose clusters are not asked about again.
    """
    size = reps.groupBy("cluster").agg(F.count("*").alias("n"))
    of = lambda side: reps.select(F.col("vec_id").alias(side), F.col("cluster").alias(f"c{side}"))
    said = apart.select("a", "b", F.lit(True).alias("said"))
    rows = near.join(said, ["a", "b"], "left").join(of("a"), "a").join(of("b"), "b").filter("ca <> cb")
    rows = rows.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.max("distance").alias("linkage"), F.count("*").alias("pairs"), F.max("said").alias("said"))
    rows = rows.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
    asked = rows.filter((F.col("pairs") == F.col("na") * F.col("nb")) & F.col("said").isNull() & (F.col("linkage") > threshold) & (F.col("linkage") <= threshold + window))
    return asked.select("a", "b", "linkage", F.round(1 - (F.col("linkage") - threshold) / window, 6).alias("proximity"))
