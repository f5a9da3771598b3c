"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def quantise(x: Column) -> Column:
    """Six decimals, half to even, no negative zero."""
    return F.bround(x + F.lit(0.0), 6) + F.lit(0.0)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def geo_cell(lat: Column, lon: Column, size: float = 0.05) -> Column:
    return F.concat_ws(":", F.floor(lat / size).cast("string"), F.floor(lon / size).cast("string"))


def bucket_gain(n: Column, decay: float = 0.5) -> Column:
    return F.pow(F.lit(decay), n)


def saturating(v: Column, k: float) -> Column:
    return v / (v + k)


def ramp(x: Column, low: float, high: float) -> Column:
    return clamp01((x - low) / (high - low))


def piecewise_calibrated(s: Column, point: float, target: float) -> Column:
    """Linear from (-1, 0) to (point, target) and on to (1, 1)."""
    return F.when(s <= point, target * (s + 1) / (point + 1)).otherwise(target + (1 - target) * (s - point) / (1 - point))


def uncalibrated(s: Column) -> Column:
    return (s + 1) / 2


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def platt(x: Column, a: float, b: float) -> Column:
    return sigmoid(a * x + b)


def firing(scores: list[tuple[str, Column]], thresholds: dict[str, float]) -> Column:
    """Names whose score reaches its threshold, in the given order."""
    return F.array_compact(F.array(*[F.when(s >= thresholds[n], F.lit(n)) for n, s in scores]))


def more_cautious(a: Column, b: Column, order: list[str]) -> Column:
    """The one that comes first in ``order``, the most cautious first."""
    names = F.array(*[F.lit(x) for x in order])
    return F.element_at(names, F.least(F.array_position(names, a), F.array_position(names, b)).cast("int"))


def consent_live(granted: Column, expires: Column, revoked: Column, scope: Column, wanted: str, at: Column) -> Column:
    """granted <= at < expires (open where null), never revoked, scope equal."""
    return F.coalesce((granted <= at) & (expires.isNull() | (at < expires)) & revoked.isNull() & (scope == wanted), F.lit(False))


def rational_compare(v1: Column, r1: Column, v2: Column, r2: Column) -> Column:
    """-1, 0 or 1 for v1/r1 against v2/r2 by integer cross-multiplication (rates above 0)."""
    return F.signum((v1 * r2 - v2 * r1).cast("double")).cast("int")


def rescale(v: Column, rate: Column, to: Column) -> tuple[Column, Column, Column]:
    """floor, ceiling and nearest (half up) frame at another rate, in integers."""
    n = v * to
    floor = F.floor(n.cast("decimal(38,0)") / rate.cast("decimal(38,0)")).cast("long")
    exact = n % rate == 0
    return floor, F.when(exact, floor).otherwise(floor + 1), F.floor((2 * n + rate).cast("decimal(38,0)") / (2 * rate).cast("decimal(38,0)")).cast("long")


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def effective_dpi(crop_w: Column, crop_h: Column, px_w: Column, px_h: Column, frame_w_mm: Column, frame_h_mm: Column) -> Column:
    """Dots per inch a placement prints with, rounded down to two decimals."""
    dpi = F.least(crop_w * px_w * 25.4 / frame_w_mm, crop_h * px_h * 25.4 / frame_h_mm)
    return F.floor(dpi * 100) / 100


def padded_pages(n: Column, least: int, most: int, step: int) -> Column:
    """Page count raised to the minimum and the next step; null beyond the maximum."""
    pages = least + F.ceil(F.greatest(n - least, F.lit(0)) / step) * step
    return F.when(pages <= most, pages).cast("long")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID, version 5, from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    part = lambda i, n: F.substring(h, i, n)
    variant = F.lower(F.hex((F.conv(part(17, 2), 16, 10).cast("long").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def people_category(n: Column) -> Column:
    return F.when(n == 0, "detail").when(n == 1, "portrait").when(n == 2, "couple").otherwise("group")


def unit_dot(a: Column, b: Column, space_a: Column, space_b: Column) -> Column:
    """Dot product of two unit vectors within -1 and 1; vectors of two spaces are an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(space_a.eqNullSafe(space_b), F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))).otherwise(F.raise_error(F.lit("two vector spaces")).cast("double"))


def joint_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Angle at b in degrees; null where an arm has no length."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    nu, nv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cos = F.greatest(F.least((ux * vx + uy * vy) / (nu * nv), F.lit(1.0)), F.lit(-1.0))
    return F.when((nu >= 1e-6) & (nv >= 1e-6), F.degrees(F.acos(cos)))


def pose_distance(a: Column, b: Column, mirrored_b: Column, least: int = 3, none: float = 999.0) -> Column:
    """Root mean square of joint angle differences, to the pose or its mirror image, whichever is less.

    Poses are arrays of angles, null where not seen; under ``least`` angles seen in both, nothing can be said (``none``).
    """

    def rms(x: Column, y: Column) -> Column:
        square = F.filter(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), lambda s: s.isNotNull())
        return F.when(F.size(square) >= least, F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v) / F.size(square)))

    return F.coalesce(F.least(rms(a, b), rms(a, mirrored_b)), F.lit(none))
