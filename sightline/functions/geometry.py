"""Column builders for boxes and points; a prefix names the side of a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-9  # keeps the union of two empty boxes from being zero


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def long_side(p: str = "") -> Column:
    return F.greatest(_c(p, "w"), _c(p, "h"))


def centre(p: str = "") -> tuple[Column, Column]:
    return _c(p, "x") + _c(p, "w") / 2, _c(p, "y") + _c(p, "h") / 2


def area(p: str = "") -> Column:
    return _c(p, "w") * _c(p, "h")


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(_c(a, "x") + _c(a, "w"), _c(b, "x") + _c(b, "w")) - F.greatest(_c(a, "x"), _c(b, "x")))
    high = F.greatest(zero, F.least(_c(a, "y") + _c(a, "h"), _c(b, "y") + _c(b, "h")) - F.greatest(_c(a, "y"), _c(b, "y")))
    return wide * high


def iou(a: str, b: str) -> Column:
    both = overlap(a, b)
    return both / (area(a) + area(b) - both + F.lit(GUARD))


def centre_in(a: str, b: str) -> Column:
    """The centre of a lies in b, edges included."""
    x, y = centre(a)
    return x.between(_c(b, "x"), _c(b, "x") + _c(b, "w")) & y.between(_c(b, "y"), _c(b, "y") + _c(b, "h"))


def plausible(width: float, height: float, most: float = 0.5, least: float = 2.0) -> Column:
    """Long side within a share of the frame, sides of some pixels, and no odd aspect."""
    return (long_side() <= most * max(width, height)) & (F.least("w", "h") >= least) & (F.col("w") / F.col("h")).between(0.4, 2.5)


def bucket(value: Column, edges: list[float], names: list[str]) -> Column:
    """Names of half-open buckets, lower edge included; one name more than edges."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(value < edge, F.lit(name)).otherwise(out)
    return out


def renamed(df, prefix: str, *keep: str):
    """df with a prefix before every column but keep."""
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns))


def dealt(df, *key: str):
    """df by key in as many parts as a shuffle has: few rows whose join makes many are the work of all tasks, however small their files are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
