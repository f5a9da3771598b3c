"""Choosing the photos of an album: constrained greedy selection of each event, and the report of what might replace a choice."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Sizes, weights and limits of a selection."""

    size: int = 24
    quality: float = 1.0
    time: float = 0.6
    place: float = 0.4
    moment: float = 0.5
    pose: float = 0.5
    person: float = 0.5
    redundancy: float = 0.8
    decay: float = 0.5
    free_similarity: float = 0.6
    shot_similarity: float = 0.9
    distinct_similarity: float = 0.95
    least_per_person: int = 1
    person_cap: int = 6
    sleeping_share: float = 0.15
    no_people_share: float = 0.1
    family_cap: int = 2
    pose_cap: int = 1


class Pool:
    """The candidates of one event as arrays, and what has been chosen so far."""

    def __init__(self, rows: pd.DataFrame, policy: Policy):
        rows = rows.sort_values("media_id").reset_index(drop=True)
        self.policy, self.ids, self.n = policy, rows["media_id"].to_numpy(), len(rows)
        self.score = rows["score"].to_numpy(float)
        self.pinned, self.sleeping, self.worse = (rows[c].fillna(False).to_numpy(bool) for c in ("pinned", "sleeping", "dominated"))
        # a photo without a measured pose shares its pose with no other
        pose = [f"{p:.0f}" if pd.notna(p) else f"none {i}" for p, i in zip(rows["pose"], self.ids, strict=True)]
        keys = {c: rows[c].fillna(-1).to_numpy() for c in ("time", "place", "moment", "shot", "family")} | {"pose": np.array(pose)}
        self.bucket = {c: np.unique(x, return_inverse=True)[1] for c, x in keys.items()}
        self.count = {c: np.zeros(x.max() + 1, int) for c, x in self.bucket.items()}
        people = [sorted({int(p) for p in x}) if x is not None else [] for x in rows["people"]]
        size = np.array([len(x) for x in people])
        self.alone = size == 0
        flat = np.array([p for x in people for p in x], np.int64)
        names, flat = np.unique(flat, return_inverse=True)
        # those without people share one person that has no cap
        self.owner = np.concatenate([np.repeat(np.arange(self.n), size), np.flatnonzero(self.alone)])
        self.who = np.concatenate([flat, np.full(self.alone.sum(), len(names))])
        self.share = np.bincount(self.owner, minlength=self.n)
        self.shown = np.zeros(len(names) + 1, int)
        self.persons = len(names)
        self.vectors = np.zeros((self.n, max((len(v) for v in rows["embedding"] if v is not None), default=1)))
        for k, v in enumerate(rows["embedding"]):
            if v is not None:
                v = np.asarray(v, float)
                self.vectors[k] = v / max(np.sqrt(v @ v), 1e-12)
        self.closest = np.zeros(self.n)
        self.left, self.chosen = np.ones(self.n, bool), []

    def gains(self) -> np.ndarray:
        p = self.policy
        fresh = lambda c: p.decay ** self.count[c][self.bucket[c]]
        value = p.quality * self.score + p.time * fresh("time") + p.place * fresh("place") + p.moment * fresh("moment") + p.pose * fresh("pose")
        value = value + p.person * np.bincount(self.owner, p.decay ** self.shown[self.who], self.n) / self.share
        near = np.clip((self.closest - p.free_similarity) / (p.shot_similarity - p.free_similarity), 0, 1)
        return np.round(value - p.redundancy * near, 9)

    def take(self, k: int, why: str) -> None:
        self.left[k] = False
        self.chosen.append((k, why))
        for c, x in self.bucket.items():
            self.count[c][x[k]] += 1
        np.add.at(self.shown, self.who[self.owner == k], 1)
        self.closest = np.maximum(self.closest, np.round(self.vectors @ self.vectors[k], 9))

    def cover(self) -> None:
        """People first: the photo that shows most people not yet shown often enough, whatever the caps."""
        while len(self.chosen) < self.policy.size:
            open_ = self.shown[: self.persons] < self.policy.least_per_person
            new = np.bincount(self.owner, np.append(open_, False)[self.who], self.n) * self.left
            if not new.any():
                return
            best = np.flatnonzero(new == new.max())
            self.take(int(best[np.argmax(self.gains()[best])]), "person")

    def fill(self) -> None:
        """The best marginal gain among what the caps allow; where they allow nothing, the loosest is opened by one.

        Shots and pose families open before a pose repeats; persons, sleepers and worse versions never do.
        """
        p = self.policy
        reserve = min(int(p.size * p.no_people_share), int(self.alone.sum()), p.size)
        caps = {"shot": 1, "family": p.family_cap, "pose": p.pose_cap}
        sleepers = max(1, int(p.size * p.sleeping_share))
        while len(self.chosen) < p.size:
            taken = np.array([k for k, _ in self.chosen], int)
            full = np.append(self.shown[: self.persons] >= p.person_cap, False)
            fits = self.left & ~self.worse & (np.bincount(self.owner, full[self.who], self.n) == 0)
            if reserve - self.alone[taken].sum() >= p.size - len(self.chosen):
                fits &= self.alone
            if self.sleeping[taken].sum() >= sleepers:
                fits &= ~self.sleeping
            if not fits.any():
                return
            under = {c: self.count[c][self.bucket[c]] < cap for c, cap in caps.items()}
            fresh = np.flatnonzero(fits & under["shot"] & under["family"] & under["pose"])
            if not len(fresh):
                reachable = fits & under["pose"]
                caps["pose" if not reachable.any() else "family" if (reachable & under["shot"]).any() else "shot"] += 1
                continue
            gain = self.gains()[fresh]
            distinct = self.closest[fresh] < p.distinct_similarity
            if distinct.any():
                self.take(int(fresh[distinct][np.argmax(gain[distinct])]), "gain")
            else:
                near = np.round(self.closest[fresh], 2)
                least = near == near.min()
                self.take(int(fresh[least][np.argmax(gain[least])]), "repeat")


def constrained_selection(candidates: DataFrame, policy: Policy) -> DataFrame:
    """For each event the chosen photos in order and why: pinned, person, gain or repeat.  Ties go to the smaller id.

    candidates: event, media_id, score, time, place, moment, shot, family, pose (null: not measured), people (array),
    sleeping, pinned, dominated, embedding (null: none).  The choice depends on all made before, so an event is one
    group; its photos are arrays, and each choice costs a pass over them.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pool = Pool(rows, policy)
        for k in np.flatnonzero(pool.pinned).tolist():
            pool.take(k, "pinned")
        if policy.least_per_person:
            pool.cover()
        pool.fill()
        out = [(rows["event"].iat[0], pool.ids[k], rank, why) for rank, (k, why) in enumerate(pool.chosen, 1)]
        return pd.DataFrame(out, columns=["event", "media_id", "rank", "why"])

    return candidates.groupBy("event").applyInPandas(run, "event long, media_id long, rank int, why string")


def slot_fit(width: Column, height: Column, slot_width: Column, slot_height: Column, floor: float) -> Column:
    """Can a picture fill the slot at the floor resolution: fits, too_small, no_size or no_slot."""
    dpi = F.least(width / slot_width, height / slot_height)
    return F.when(slot_width.isNull() | slot_height.isNull(), "no_slot").when(width.isNull() | height.isNull(), "no_size").when(dpi >= floor, "fits").otherwise("too_small")


def selection_report(candidates: DataFrame, chosen: DataFrame, placements: DataFrame, floor: float) -> DataFrame:
    """The alternatives of each chosen photo, best first, and whether each would fit its slot.

    Of several chosen photos of a group the one of the highest standing carries the group's alternatives, so each
    candidate is named once.  candidates: media_id, group_id, standing, quality, width, height; chosen: media_id;
    placements: media_id, page, slot_width, slot_height, the first page of a photo counting.
    """
    picked = candidates.join(chosen.select("media_id").distinct(), "media_id", "left_semi")
    w = Window.partitionBy("group_id").orderBy(F.desc("standing"), "media_id")
    carriers = picked.filter("group_id IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(F.col("media_id").alias("carrier"), "group_id")
    slots = placements.groupBy("media_id").agg(F.min_by(F.struct("page", "slot_width", "slot_height"), "page").alias("slot"))
    rest = candidates.join(chosen.select("media_id").distinct(), "media_id", "left_anti").join(carriers, "group_id")
    rank = F.row_number().over(Window.partitionBy("carrier").orderBy(F.desc("quality"), "media_id"))
    rows = rest.withColumn("rank", rank).join(slots.withColumnRenamed("media_id", "carrier"), "carrier", "left")
    fit = slot_fit(F.col("width"), F.col("height"), F.col("slot.slot_width"), F.col("slot.slot_height"), floor)
    return rows.select("carrier", "media_id", "rank", F.col("slot.page").alias("page"), fit.alias("fit"))
