"""Regions of persons, hands and zones, and reports on runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import centre_in, iou, long_side, renamed

FRAME = ["clip_id", "frame"]


def head_regions(people: DataFrame, width: float, height: float, top: float = 0.25, side: float = 0.6) -> DataFrame:
    """The head's share of a person's box: centred, the top part; a box that exactly one side of the frame cuts snaps to that edge; clipped."""
    w, h = F.col("w") * side, F.col("h") * top
    left_cut, right_cut = F.col("x") <= 0, F.col("x") + F.col("w") >= width
    x = F.when(left_cut & ~right_cut, F.lit(0.0)).when(right_cut & ~left_cut, F.lit(float(width)) - w).otherwise(F.col("x") + (F.col("w") - w) / 2)
    x0, y0 = F.greatest(x, F.lit(0.0)), F.greatest(F.col("y"), F.lit(0.0))
    return people.withColumns({"x": x0, "y": y0, "w": F.least(x + w, F.lit(float(width))) - x0, "h": F.least(F.col("y") + h, F.lit(float(height))) - y0})


def without_wearer(people: DataFrame, hands: DataFrame, least: float) -> DataFrame:
    """People that no hand of the frame overlaps by least and that hold no hand's centre."""
    a, b = renamed(people, "a_"), renamed(hands, "b_")
    test = (iou("a_", "b_") >= least) | centre_in("b_", "a_")
    out = a.join(b, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in FRAME] + [test], "left_anti")
    return out.select(*(F.col(c).alias(c[2:]) for c in out.columns))


def run_report(linked: DataFrame, key: list[str], run: str = "run") -> DataFrame:
    """first, last, hits, largest side and last box of each run."""
    last = F.max_by(F.struct("x", "y", "w", "h"), F.struct("frame", "event_id"))
    out = linked.groupBy(*key, run).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("hits"), F.max(long_side()).alias("max_px"), last.alias("box"))
    return out.select(*key, run, "first", "last", "hits", "max_px", "box.x", "box.y", "box.w", "box.h")


def run_features(hits: DataFrame, key: list[str], scores: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """Per run the largest of each score and whether any row has each flag."""
    return hits.groupBy(*key).agg(*(F.max(c).alias(n) for n, c in scores.items()), *(F.bool_or(c).alias(n) for n, c in flags.items()))


def finite_stats(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Median, p90, mean and share of finite values, over pooled rows."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*key).agg(F.median(v).alias("median"), F.percentile(v, F.lit(0.9)).alias("p90"), F.avg(v).alias("mean"), (F.count(v) / F.count("*")).alias("finite_share"))
