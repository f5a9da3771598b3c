"""Sequential planners and record rules: duplicate groups, clustering within blocks, greedy choice, cuts, validators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .linkage import complete_clusters, thinned
from .ordered import with_previous
from .vectors import band_pairs, close_pairs, cosine_distance, hamming


def duplicate_links(items: DataFrame, candidate: int, decisive: int, max_cosine: float) -> DataFrame:
    """Links of near-duplicates among band pairs, with their similarity.

    Where both items have an embedding the cosine distance decides; else only a smaller hash distance does.
    items: vec_id, hash, embedding (may be null).
    """
    pairs = band_pairs(items.select("vec_id", "hash")).withColumn("bits", hamming(F.col("ha"), F.col("hb"))).filter(F.col("bits") <= candidate)
    rows = pairs.join(items.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea")), "a").join(items.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb")), "b")
    both = F.col("ea").isNotNull() & F.col("eb").isNotNull()
    rows = rows.withColumn("d", F.when(both, cosine_distance(F.col("ea"), F.col("eb"))))
    fine = F.when(both, F.col("d") <= max_cosine).otherwise(F.col("bits") <= decisive)
    return rows.filter(fine).select("a", "b", F.round(F.when(both, 1 - F.col("d")).otherwise(1 - F.col("bits") / 64), 6).alias("similarity"))


def duplicate_groups(items: DataFrame, links: DataFrame) -> DataFrame:
    """Members of each group of linked items with the group's primary and each member's direct similarity to it.

    items: vec_id, favorite, quality.  A member never linked to the primary directly has similarity 0.
    """
    rows = components(links.select("a", "b")).join(items.select(F.col("vec_id").alias("id"), "favorite", "quality"), "id")
    w = Window.partitionBy("label").orderBy(F.desc("favorite"), F.desc_nulls_last("quality"), "id")
    rows = rows.withColumn("primary_id", F.first("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    both = links.select("a", "b", "similarity").union(links.select("b", "a", "similarity")).toDF("id", "primary_id", "s")
    out = rows.join(both, ["id", "primary_id"], "left")
    return out.select("id", F.col("label").alias("group_id"), "primary_id", F.when(F.col("id") == F.col("primary_id"), 1.0).otherwise(F.coalesce("s", F.lit(0.0))).alias("similarity"))


def complete_linkage(items: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Complete-linkage clusters of vectors: id and cluster (its smallest id).

    Components at the threshold are a safe block: no cluster crosses one.  Each block is clustered exactly,
    the smallest linkage first, then the smallest ids.  ``links`` are the pairs within the threshold.
    """
    labels = components(thinned(links))
    blocks = labels.join(items.select(F.col("vec_id").cast("long").alias("id"), "embedding"), "id")
    return complete_clusters(blocks, component_links(blocks, threshold))


def component_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """label, a, b and distance of all pairs of one component (label, id, embedding) within the threshold, at nine decimals."""
    return close_pairs(blocks.withColumnRenamed("id", "vec_id"), threshold, "label", 9).withColumnRenamed("block", "label")


def greedy_selection(candidates: DataFrame, size: int, cap: int, decay: float = 0.5) -> DataFrame:
    """For each event the chosen items in order: best marginal gain first, under a cap for each person.

    Gain is the score plus a bonus for the item's place that halves with every item chosen there; ties by id.
    candidates: event, media_id, score, place, person.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("media_id").reset_index(drop=True)
        score = pdf["score"].to_numpy(float)
        _, place = np.unique(pdf["place"].to_numpy(), return_inverse=True)
        _, person = np.unique(pdf["person"].to_numpy(), return_inverse=True)
        places, people = np.zeros(place.max() + 1), np.zeros(person.max() + 1, int)
        free, chosen = np.ones(len(pdf), bool), []
        while len(chosen) < size:
            open_ = np.flatnonzero(free & (people[person] < cap))
            if not len(open_):
                break
            gain = np.round(score[open_] + decay ** places[place[open_]], 9)
            i = open_[np.argmax(gain)]
            free[i] = False
            places[place[i]] += 1
            people[person[i]] += 1
            chosen.append((pdf["event"].iat[i], pdf["media_id"].iat[i], len(chosen) + 1, gain.max()))
        return pd.DataFrame(chosen, columns=["event", "media_id", "rank", "gain"])

    return candidates.groupBy("event").applyInPandas(run, "event long, media_id long, rank int, gain double")


def lock_cut(cuts: DataFrame, beats: DataFrame, gate: int, drift: int, bonus: float) -> DataFrame:
    """The beat of each cut with the least cost: distance less a bonus for downbeats, within the gate and the drift."""
    b = beats.select(F.col("media_id").alias("m"), F.col("frame").alias("beat"), "downbeat")
    rows = cuts.join(b, (F.col("media_id") == F.col("m")) & F.col("beat").between(F.col("frame") - drift, F.col("frame") + drift))
    away = F.abs(F.col("beat") - F.col("frame"))
    rows = rows.filter(~F.col("downbeat") | (away <= gate))
    w = Window.partitionBy("media_id", "frame").orderBy(away - F.when(F.col("downbeat"), bonus).otherwise(0.0), ~F.col("downbeat"), away, "beat")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("media_id", "frame", "beat")


def hold_energy(motion: Column, emotion: Column) -> Column:
    """0.6 motion + 0.4 emotion over what is measured."""
    live = F.when(motion.isNotNull(), 0.6).otherwise(0.0) + F.when(emotion.isNotNull(), 0.4).otherwise(0.0)
    mass = F.coalesce(motion * 0.6, F.lit(0.0)) + F.coalesce(emotion * 0.4, F.lit(0.0))
    return F.when(live > 0, mass / live)


def hold_seconds(energy: Column, base: float, least: float = 1.5, most: float = 8.0) -> Column:
    """Quiet moments are held longer (up to 1.3), busy ones shorter (down to 0.7); unmeasured ones as they are."""
    scale = F.when(energy.isNull(), 1.0).otherwise(1.3 - 0.6 * energy)
    return F.least(F.greatest(base * scale, F.lit(least)), F.lit(most))


def act_bounds(moments: DataFrame, first: float = 0.25, last: float = 0.20) -> DataFrame:
    """Act of each moment by its place: fractions rounded half up, clamped so that the turn lies in the middle act."""
    w = Window.partitionBy("media_id")
    rows = moments.withColumn("i", F.row_number().over(w.orderBy("frame")) - 1).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("turn", F.min(F.struct(-F.col("score"), "i")).over(w)["i"])
    rows = rows.withColumn("a", F.least(F.floor(F.col("n") * first + 0.5), F.col("turn"))).withColumn("b", F.greatest(F.col("n") - F.floor(F.col("n") * last + 0.5), F.col("turn") + 1))
    return rows.select("media_id", "frame", F.when(F.col("i") < F.col("a"), 1).when(F.col("i") < F.col("b"), 2).otherwise(3).alias("act"))


def constraint_report(chosen: DataFrame, cap: int) -> DataFrame:
    """Measured constraints of a selection, one row each: duplicates, person cap, chronology, adjacent scenes."""
    seq = with_previous(chosen, "rank", ["captured", "scene"])
    one = lambda name, value: value.select(F.lit(name).alias("constraint"), F.col("x").cast("long").alias("measured"))
    dup = chosen.filter("group_id IS NOT NULL").groupBy("group_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("x"))
    person = chosen.filter("person IS NOT NULL").groupBy("person").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > cap).alias("x"))
    return one("duplicates", dup).union(one("person_cap", person)).union(one("out_of_order", seq.agg(F.count_if(F.col("captured") < F.col("before.captured")).alias("x")))).union(one("adjacent_scene", seq.agg(F.count_if(F.col("scene") == F.col("before.scene")).alias("x"))))


def greedy_labels(items: DataFrame, threshold: float, most: int = 8) -> DataFrame:
    """Labels in caller order: the nearest of at most ``most`` representatives under the threshold, else a new one.

    items: bucket, ord, x (a small vector).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # at most ``most`` rows become representatives; what lies between two of them is labelled at once
        pdf = pdf.sort_values("ord")
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        near, label, reps, i = np.full(len(x), np.inf), np.zeros(len(x), int), 0, 0
        while i < len(x):
            d = np.sqrt(np.mean((x[i:] - x[i]) ** 2, axis=1))
            closer = d < near[i:]
            near[i:][closer], label[i:][closer] = d[closer], reps
            reps += 1
            far = np.flatnonzero(near[i:] > threshold)
            if reps >= most or not len(far):
                break
            i += int(far[0])
        return pd.DataFrame({"bucket": pdf["bucket"], "ord": pdf["ord"], "label": label})

    return items.groupBy("bucket").applyInPandas(run, "bucket long, ord long, label int")


def platt_fit(scores: DataFrame, least: int, steps: int = 30) -> DataFrame:
    """Logistic calibration of each class by Newton steps; classes with too few examples are left out.

    Each step adds up gradient and curvature over all samples of every class; only these sums, five numbers for a
    class, reach the driver.  Slopes are held by a penalty of 0.001.
    """
    from .graph import stage

    rows = stage(scores.select("klass", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "scores")
    sizes = {r["klass"]: r["n"] for r in rows.groupBy("klass").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()}
    fitted = {k: np.array([1.0, 0.0]) for k in sizes}
    kinds = "klass string, examples long, a double, b double"
    table = lambda: rows.sparkSession.createDataFrame([(k, n, float(fitted[k][0]), float(fitted[k][1])) for k, n in sizes.items()], kinds)
    p = 1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))
    for _ in range(steps if sizes else 0):
        now = rows.join(F.broadcast(table()), "klass").withColumn("e", p - F.col("y")).withColumn("q", p * (1 - p))
        sums = now.groupBy("klass").agg(*[F.sum(x).alias(n) for n, x in {"ga": F.col("e") * F.col("x"), "gb": F.col("e"), "aa": F.col("q") * F.col("x") * F.col("x"), "ab": F.col("q") * F.col("x"), "bb": F.col("q")}.items()])
        moved = 0.0
        for r in sums.collect():
            h = np.array([[r["aa"] + 1e-3, r["ab"]], [r["ab"], r["bb"] + 1e-9]])
            step = np.linalg.solve(h, np.array([r["ga"] + 1e-3 * fitted[r["klass"]][0], r["gb"]]))
            fitted[r["klass"]] -= step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    return table().select("klass", "examples", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def word_safe(points: DataFrame, words: DataFrame, later: bool) -> DataFrame:
    """Each point moved out of any word it lies strictly inside: to the word's end, or to its start."""
    from .frames import inside_word, merge_ranges

    hit = inside_word(points, merge_ranges(words)).select(F.col("media_id").alias("m"), F.col("frame").alias("f"), F.col("hi" if later else "lo").alias("to"))
    rows = points.join(hit, (F.col("media_id") == F.col("m")) & (F.col("frame") == F.col("f")), "left")
    return rows.select("media_id", "frame", F.coalesce("to", "frame").alias("safe"))


def snap_points(frames: DataFrame) -> DataFrame:
    """Places for cuts: shot bounds, rises and falls of motion, changes of light; each kind once a frame."""
    w = Window.partitionBy("media_id").orderBy("frame")
    step = F.col("motion") - F.lag("motion").over(w)
    light = F.abs(F.col("luma") - F.lag("luma").over(w))
    kinds = F.array_compact(F.array(F.when(F.col("boundary"), "shot"), F.when(step >= 0.2, "motion_rise"), F.when(step <= -0.2, "motion_fall"), F.when(light >= 0.6, "light")))
    return frames.select("media_id", "frame", kinds.alias("kinds")).select("media_id", "frame", F.explode("kinds").alias("kind"))


def classical_cuts(frames: DataFrame, column: str, high: float, ratio: float, floor: float, radius: int) -> DataFrame:
    """Frames whose distance to the one before is high and stands out from the median around it."""
    w = Window.partitionBy("media_id").orderBy("frame")
    rows = frames.withColumn("d", F.abs(F.col(column) - F.lag(column).over(w)))
    rows = rows.withColumn("around", F.array_sort(F.array_compact(F.array(*[F.lag("d", k).over(w) for k in range(-radius, radius + 1) if k]))))
    n = F.size("around")
    mid = F.when(n > 0, (F.get("around", F.floor((n - 1) / 2).cast("int")) + F.get("around", F.floor(n / 2).cast("int"))) / 2).otherwise(0.0)
    return rows.filter((F.col("d") >= high) & (F.col("d") >= ratio * F.greatest(mid, F.lit(floor)))).select("media_id", "frame")


def box_findings(placements: DataFrame, trim: float, gutter: float) -> DataFrame:
    """Findings of print rules on faces: within the trim zone, across the gutter; one row for each."""
    in_trim = (F.col("x") < trim) | (F.col("y") < trim) | (F.col("x") + F.col("w") > 1 - trim) | (F.col("y") + F.col("h") > 1 - trim)
    in_gutter = (F.col("x") < 0.5 + gutter) & (F.col("x") + F.col("w") > 0.5 - gutter)
    found = F.array_compact(F.array(F.when(in_trim, "face_in_trim_zone"), F.when(in_gutter, "face_in_gutter")))
    return placements.select("id", F.explode(found).alias("finding"))


def rule_report(required: DataFrame, results: DataFrame) -> DataFrame:
    """Failures of each required rule; a rule that never ran is no pass."""
    got = results.groupBy("rule").agg(F.count_if(~F.col("passed")).alias("failures"), F.count("*").alias("ran"))
    return required.join(got, "rule", "left").select("rule", F.coalesce("ran", F.lit(0)).alias("ran"), F.coalesce("failures", F.lit(0)).alias("failures"), (F.coalesce("ran", F.lit(0)) > 0) & (F.coalesce("failures", F.lit(0)) == 0))


def timeline_findings(clips: DataFrame) -> DataFrame:
    """Clips that do not start where the one before ends, or reach beyond their source."""
    w = Window.partitionBy("plan").orderBy("place")
    rows = clips.withColumn("expected", F.coalesce(F.lag(F.col("start") + F.col("length")).over(w), F.lit(0)))
    found = F.array_compact(F.array(F.when(F.col("start") != F.col("expected"), "gap_or_overlap"), F.when(F.col("offset") + F.col("length") > F.col("available"), "beyond_source")))
    return rows.select("plan", "place", F.explode(found).alias("finding"))


def composed_report(placements: DataFrame, rules: dict[str, Column], required: list[str]) -> DataFrame:
    """One line for each required rule: how often it ran, failed, and whether it passed.  A rule that never ran does not pass.

    All rules are judged in one pass over the placements; a test that is null fails.
    """
    counts = placements.agg(F.count("*").alias("ran"), *[F.count_if(~F.coalesce(test, F.lit(False))).alias(f"failed {name}") for name, test in rules.items()])
    lines = [F.struct(F.lit(name).alias("rule"), (F.col("ran") if name in rules else F.lit(0).cast("long")).alias("ran"), (F.col(f"failed {name}") if name in rules else F.lit(0).cast("long")).alias("failures")) for name in required]
    return counts.select(F.explode(F.array(*lines)).alias("x")).select("x.*", ((F.col("x.ran") > 0) & (F.col("x.failures") == 0)).alias("passed"))


def constrained_clusters(faces: DataFrame, links: DataFrame, must: DataFrame, cannot: DataFrame, threshold: float) -> DataFrame:
    """face_id and cluster (its smallest voting face) of every face with a vote, under pairs that a person decided.

    faces: face_id, track (null: a still), declared, quality, embedding.  One face of a track votes for all of it: the
    declared one, else that of highest quality, unmeasured last, ties by id; only those with a vector can.  Pairs of
    ``must`` (a, b) start together, however far apart; pairs of ``cannot`` never meet, unless ``must`` joined them.
    Then the two clusters whose furthest faces are nearest join, ties by smallest id, up to the threshold.  ``links``
    are the pairs of faces within the threshold: no cluster crosses a component of links and decided pairs.
    """
    votes = Window.partitionBy("track").orderBy(F.desc(F.coalesce("declared", F.lit(False))), F.desc(F.coalesce("quality", F.lit(-1.0))), "face_id")
    able = faces.filter("embedding IS NOT NULL")
    first = able.filter("track IS NOT NULL").withColumn("rn", F.row_number().over(votes)).filter("rn = 1").drop("rn")
    voters = first.unionByName(able.filter("track IS NULL")).select(F.col("face_id").alias("id"), "track", "embedding")
    voting = lambda pairs: pairs.select("a", "b").join(voters.select(F.col("id").alias("a")), "a", "left_semi").join(voters.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    kept = voting(must)
    apart = voting(cannot).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    blocks = components(thinned(voting(links)).union(kept)).join(voters, "id")
    near = component_links(blocks, threshold).join(apart, ["a", "b"], "left_anti")
    joined = complete_clusters(blocks, near, seeds=components(kept))
    votes_of = voters.select("id", "track").join(joined, "id", "left").select("id", "track", F.coalesce("cluster", "id").alias("cluster"))
    still = votes_of.filter("track IS NULL").select(F.col("id").alias("face_id"), "cluster")
    return still.union(faces.filter("track IS NOT NULL").join(votes_of.filter("track IS NOT NULL").select("track", "cluster"), "track").select("face_id", "cluster"))


def detect_cuts(frames: DataFrame, high: float, low: float, ratio: float, floor: float, back: float, radius: int, near: int, merge: int, least: int, flash: int) -> DataFrame:
    """media_id, frame and kind (cut or flash) of the shot bounds of each clip.

    frames: media_id, frame, signature (triples of L*a*b* values, one for each block).  The distance of a frame is the
    mean over blocks of the Euclidean distance to the frame before.  A peak is at least ``high``, at least ``ratio``
    times the median within ``radius`` frames (``floor`` at least), above all within ``near`` frames before it and not
    below those after.  A peak whose picture comes back (within ``back``) in ``flash`` frames is a flash; one under
    ``least`` frames after the last cut is none; frames over ``low`` within ``merge`` frames of a cut belong to it.
    The frames of a clip go to one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        sig = np.stack(pdf["signature"].to_numpy()).astype(float).reshape(len(pdf), -1, 3)
        away = lambda i, js: np.sqrt(((sig[js] - sig[i]) ** 2).sum(2)).mean(1)
        n, out = len(pdf), []
        d = np.zeros(n)
        d[1:] = np.sqrt(((sig[1:] - sig[:-1]) ** 2).sum(2)).mean(1)

        def peak(i: int) -> bool:
            around = np.delete(d[max(1, i - radius) : i + radius + 1], min(i - 1, radius))
            mid = float(np.median(around)) if len(around) else 0.0
            return d[i] >= ratio * max(mid, floor) and bool((d[max(1, i - near) : i] < d[i]).all()) and bool((d[i + 1 : i + near + 1] <= d[i]).all())

        def returned(i: int) -> tuple[int, int] | None:
            """Where the picture before a transient is back, and where the transient began: at the peak, or before it."""
            starts = [(i, i + 1)] + [(s, i) for s in range(i - 1, max(0, i - flash - 1), -1)]
            for start, first in starts:
                later = np.arange(first, min(n, start + flash + 1))
                settled = later[away(start - 1, later) <= back] if len(later) else later
                if len(settled):
                    return int(settled[0]), start
            return None

        free, last = 0, None
        for i in (np.flatnonzero(d[1:] >= high) + 1).tolist():
            if i < free or not peak(i):
                continue
            settled = returned(i)
            if settled is not None:
                out.append((settled[1], "flash"))
                free = settled[0] + 1
            elif last is None or i - last >= least:
                out.append((i, "cut"))
                last = i
                tail = np.flatnonzero(d[i + 1 : i + merge + 1] >= low)
                free = i + 2 + int(tail[-1]) if len(tail) else i + 1
        at = pdf["frame"].to_numpy()
        return pd.DataFrame({"media_id": pdf["media_id"].iat[0], "frame": [int(at[i]) for i, _ in out], "kind": [k for _, k in out]})

    return frames.groupBy("media_id").applyInPandas(run, "media_id long, frame long, kind string")
