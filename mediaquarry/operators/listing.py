"""Listings and point reads: filters, gates, semi-joins, paging and top-k under total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Precisions fine enough for a timeline.
TIMELINE = ("second", "minute", "hour", "day")
SUMMARY = ("media_id", "kind", "captured", "time_precision", "aesthetic", "excluded", "hidden", "group_id", "is_primary")


def listing(media: DataFrame, kind: str | None = None, chronological: bool = False, primaries_only: bool = False, include_excluded: bool = False, min_aesthetic: float | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """ANDed optional predicates, total order by time then id (or id alone), offset and limit."""
    rows = media
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if not include_excluded:
        rows = rows.filter(~F.col("excluded") & ~F.col("hidden"))
    if primaries_only:
        rows = rows.filter(F.col("group_id").isNull() | F.col("is_primary"))
    if min_aesthetic is not None:
        rows = rows.filter(F.col("aesthetic") >= min_aesthetic)
    if chronological:
        rows = rows.filter(F.col("captured").isNotNull() & F.col("time_precision").isin(*TIMELINE))
        rows = rows.orderBy("captured", "media_id")
    else:
        rows = rows.orderBy("media_id")
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def with_person(media: DataFrame, faces: DataFrame, person_id: int, candidates: DataFrame | None = None) -> DataFrame:
    """Media with an eligible face of the person; with ``candidates``, also those where the person is a candidate."""
    rows = media.join(faces.filter(F.col("eligible") & (F.col("person_id") == person_id)), "media_id", "left_semi")
    if candidates is None:
        return rows
    maybe = faces.join(candidates.filter(F.col("person_id") == person_id).select("face_id"), "face_id", "left_semi")
    more = media.join(maybe, "media_id", "left_semi").join(rows.select("media_id"), "media_id", "left_anti")
    return rows.unionByName(more)


def with_any_face(media: DataFrame, faces: DataFrame) -> DataFrame:
    return media.join(faces.filter("eligible"), "media_id", "left_semi")


def people_in_media(faces: DataFrame, eligible_only: bool = True) -> DataFrame:
    rows = faces.filter("eligible") if eligible_only else faces
    return rows.filter(F.col("person_id").isNotNull()).select("media_id", "person_id").distinct()


def best_path(sources: DataFrame) -> DataFrame:
    """One path for each medium: present before absent, internal volumes (null) first, then by path."""
    key = F.struct(~F.col("present"), F.col("volume_id").isNotNull(), "path")
    return sources.groupBy("media_id").agg(F.min_by("path", key).alias("path"))


def proxy_owner(proxies: DataFrame) -> DataFrame:
    """The lowest media id that owns each proxy."""
    return proxies.groupBy("proxy_id").agg(F.min("media_id").alias("media_id"))


def review_queue(faces: DataFrame, limit: int = 100) -> DataFrame:
    """Faces not eligible whose assignment is open, nearest to their threshold first."""
    away = F.abs(F.coalesce("threshold", F.lit(0.92)) - F.coalesce("confidence", F.lit(0.0)))
    rows = faces.filter(~F.col("eligible") & F.col("assignment").isin("unassigned", "suggested", "ambiguous"))
    return rows.withColumn("distance", F.round(away, 6)).orderBy("distance", "face_id").limit(limit)


def claim_next(jobs: DataFrame, kinds: list[str]) -> DataFrame:
    rows = jobs.filter((F.col("status") == "pending") & F.col("job_type").isin(*kinds))
    return rows.orderBy(F.desc("priority"), "created", "job_id").limit(1)


def keyset_page(rows: DataFrame, key: str, unique: str, after: tuple | None, size: int) -> DataFrame:
    """The next page after a (key, id) cursor and whether more follow; never an offset."""
    if after is not None:
        rows = rows.filter((F.col(key) > F.lit(after[0])) | ((F.col(key) == F.lit(after[0])) & (F.col(unique) > F.lit(after[1]))))
    page = rows.orderBy(key, unique).limit(size + 1)
    more = page.groupBy().agg((F.count("*") > size).alias("has_more"))
    return page.orderBy(key, unique).limit(size).crossJoin(F.broadcast(more))


def time_filter(rows: DataFrame, column: str, start: Column, end: Column, include_undated: bool = False) -> DataFrame:
    """Half-open [start, end), undated rows only if asked for."""
    inside = (F.col(column) >= start) & (F.col(column) < end)
    return rows.filter(F.coalesce(inside, F.lit(include_undated)))


def by_quality(rows: DataFrame, value: str, unique: str, limit: int) -> DataFrame:
    """Measured before unmeasured, best first, id last."""
    return rows.orderBy(F.col(value).isNull(), F.desc(value), unique).limit(limit)


def undated_reason(least_confidence: float = 0.5) -> Column:
    """The first rule that bars a row from a timeline; null for dated rows.  The confidence test is strict."""
    return (
        F.when(F.col("captured").isNull(), "no_timestamp")
        .when(F.col("time_precision") == "unknown", "precision_unknown")
        .when(~F.col("time_precision").isin(*TIMELINE), "precision_too_coarse")
        .when(F.coalesce("time_confidence", F.lit(0.0)) < least_confidence, "low_time_confidence")
    )


def elimination_reason(floor: float | None) -> Column:
    """Black frame, then obstructed lens, then a calibrated sharpness floor where there is one."""
    out = F.when(F.col("is_black_frame"), "black_frame").when(F.col("is_lens_obstructed"), "lens_obstructed")
    return out if floor is None else out.when(F.col("sharpness") < floor, "below_sharpness_floor")


def usable_coordinate(lat: Column, lon: Column) -> Column:
    """Both present and not exactly the null island."""
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))


def hard_gate(pinned: Column, rules: list[tuple[str, Column]]) -> Column:
    """The first failing gate's reason; pinned rows pass all."""
    out = F.when(pinned, F.lit(None).cast("string"))
    for reason, test in rules:
        out = out.when(test, reason)
    return out


def all_steps_done(steps: Column, status: str = "done") -> Column:
    return F.forall(steps, lambda s: s == status)


def sensitivity(score: Column, threshold: float) -> Column:
    """Three states: an unmeasured score is unknown, never safe."""
    return F.when(score.isNull(), "unknown").when(score >= threshold, "sensitive").otherwise("clear")
