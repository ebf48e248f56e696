"""Verdicts and small formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masking(changed: Column, would: Column, noise: Column, least: float = 4.0, ratio: float = 0.3) -> Column:
    """flat, missed or masked: noise is taken off both changes, not below 0; a change that would be too small to see is flat."""
    zero = F.lit(0.0)
    c, w = F.greatest(changed - noise, zero), F.greatest(would - noise, zero)
    return F.when(w < least, F.lit("flat")).when(c < ratio * w, F.lit("missed")).otherwise(F.lit("masked"))


def crop(x: Column, y: Column, w: Column, h: Column, scale: float, width: int, height: int) -> Column:
    """A square around a box, scaled, moved inside the frame and no larger than it."""
    side = F.least(F.greatest(w, h) * scale, F.lit(float(min(width, height))))
    at = lambda p, s, end: F.greatest(F.lit(0.0), F.least(p + s / 2 - side / 2, end - side))
    return F.struct(at(x, w, width).alias("x"), at(y, h, height).alias("y"), side.alias("side"))


def unclipped(w: Column, h: Column, ratio: float) -> Column:
    """Sides of a rectangle offset outwards by area * ratio / perimeter."""
    d = w * h * ratio / (2 * (w + h))
    return F.struct((w + 2 * d).alias("w"), (h + 2 * d).alias("h"), d.alias("offset"))


def fisheye(x: Column, y: Column, z: Column, k: tuple[float, float, float, float], f: float, c: tuple[float, float]) -> Column:
    """Projection by an odd polynomial of the angle to the axis."""
    r = F.hypot(x, y)
    a = F.atan2(r, z)
    bent = a * (1 + k[0] * a**2 + k[1] * a**4 + k[2] * a**6 + k[3] * a**8)
    s = F.when(r > 0, bent / r).otherwise(F.lit(1.0))
    return F.struct((f * x * s + c[0]).alias("u"), (f * y * s + c[1]).alias("v"))


def gravity(x: Column, y: Column, z: Column) -> Column:
    """Median length of a vector."""
    return F.median(F.sqrt(x * x + y * y + z * z))


def human_size(n: Column) -> Column:
    """A size in steps of a thousand with one decimal, halves to even; null of null."""
    out = F.format_string("%.1f TB", F.rint(n / 1e11) / 10)
    for unit, size in (("GB", 1e9), ("MB", 1e6), ("kB", 1e3)):
        out = F.when(n < 1000 * size, F.format_string(f"%.1f {unit}", F.rint(n / (size / 10)) / 10)).otherwise(out)
    return F.when(n < 1000, F.format_string("%d B", n)).when(n.isNotNull(), out)


def listed_kinds(asked: Column, known: list[str]) -> Column:
    """Kinds asked for in a comma-separated text, once each in listing order; null if one is unknown."""
    kinds = F.array_distinct(F.filter(F.transform(F.split(asked, ","), lambda k: F.lower(F.trim(k))), lambda k: k != ""))
    order = F.array(*map(F.lit, known))
    return F.when(F.size(F.array_except(kinds, order)) == 0, F.concat_ws(",", F.array_intersect(order, kinds)))


def split_points(keys: Column, start: Column, end: Column, most: Column) -> Column:
    """Starts of the parts of [start, end), cut at sorted keys so that parts are at most most long: each cut is the farthest key within reach of the one before; where none is, the
    rest stays whole. A fold over the keys."""
    inside = F.filter(keys, lambda k: (k > start) & (k < end))
    begin = F.struct(F.array(start).alias("cuts"), F.lit(None).cast("long").alias("held"), F.lit(False).alias("stuck"))

    def step(s, k):
        far = k - F.element_at(s["cuts"], -1) > most
        take = far & s["held"].isNotNull() & ~s["stuck"]
        cuts = F.when(take, F.array_append(s["cuts"], s["held"])).otherwise(s["cuts"])
        stuck = s["stuck"] | (k - F.element_at(cuts, -1) > most)
        return F.struct(cuts.alias("cuts"), F.when(stuck, F.lit(None).cast("long")).otherwise(k).alias("held"), stuck.alias("stuck"))

    return F.aggregate(F.concat(inside, F.array(end)), begin, step)["cuts"]


def link(base: str, path: Column) -> Column:
    """A URL of a path: percent-encoded but for its slashes."""
    return F.concat(F.lit(base), F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))
