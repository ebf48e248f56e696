"""Runs, segments and intervals over integer positions: threshold, join over gaps, drop short, pad, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(key: list[str], *order: str):
    return Window.partitionBy(*key).orderBy(*order)


def numbered_islands(df: DataFrame, key: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """A running number that grows wherever breaks holds."""
    w = _over(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_breaks", breaks.cast("int")).withColumn(name, F.sum("_breaks").over(w)).drop("_breaks")


def gap_runs(df: DataFrame, key: list[str], at: str, gap: int, least: int = 1) -> DataFrame:
    """Runs of distinct positions whose steps don't exceed gap: key, first, last, hits; those of at least least hits."""
    points = df.select(*key, F.col(at).alias("at")).filter("at IS NOT NULL").distinct()
    step = F.col("at") - F.lag("at").over(_over(key, "at"))
    runs = numbered_islands(points.withColumn("_step", step), key, ["at"], F.coalesce(F.col("_step") > gap, F.lit(True)))
    return runs.groupBy(*key, "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("hits")).filter(F.col("hits") >= least).drop("run")


def flag_runs(df: DataFrame, key: list[str], at: str, flag: Column, least: int = 1) -> DataFrame:
    """Half-open runs [first, end) of successive positions with the flag, of at least least positions."""
    points = df.filter(flag).select(*key, F.col(at).alias("at")).distinct()
    island = F.col("at") - F.row_number().over(_over(key, "at"))
    runs = points.withColumn("_island", island).groupBy(*key, "_island").agg(F.min("at").alias("first"), (F.max("at") + 1).alias("end"), F.count("*").alias("hits"))
    return runs.filter(F.col("hits") >= least).drop("_island")


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str, touching: bool = True) -> DataFrame:
    """Half-open intervals merged where they overlap, and where they touch: key, start, end, parts."""
    before = _over(key, "start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(*key, F.col(start).alias("start"), F.col(end).alias("end")).filter("start < end").withColumn("_reach", F.max("end").over(before))
    apart = F.col("start") > F.col("_reach") if touching else F.col("start") >= F.col("_reach")
    rows = numbered_islands(rows, key, ["start", "end"], F.coalesce(apart, F.lit(True)))
    return rows.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("run")


def speech_segments(df: DataFrame, key: list[str], at: str, flag: Column, size: int, silence: int, speech: int, pad: int, length: Column | None = None) -> DataFrame:
    """Segments from windows of size units: runs of flagged windows, joined over silences shorter than silence, dropped if shorter
    than speech, padded and clipped, merged where padding made them meet."""
    runs = flag_runs(df, key, at, flag).select(*key, (F.col("first") * size).alias("lo"), (F.col("end") * size).alias("hi"))
    quiet = F.col("lo") - F.lag("hi").over(_over(key, "lo"))
    runs = numbered_islands(runs.withColumn("_quiet", quiet), key, ["lo"], F.coalesce(F.col("_quiet") >= silence, F.lit(True)))
    runs = runs.groupBy(*key, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("hi") - F.col("lo") >= speech)
    hi = F.col("hi") + pad
    padded = runs.select(*key, F.greatest(F.col("lo") - pad, F.lit(0)).alias("start"), (F.least(hi, length) if length is not None else hi).alias("end"))
    return merge_intervals(padded, key, "start", "end")


def segment_plan(blocks: DataFrame, key: list[str], order: str, start: str, end: str, masked: str, least: int) -> DataFrame:
    """Copy or encode: successive blocks with the same masked flag merge; where there is more than one such run, clean runs
    shorter than least are encoded too, and neighbours merge again. Returns start, end, copy."""

    def merged(df: DataFrame) -> DataFrame:
        changed = F.col("copy") != F.lag("copy").over(_over(key, "start"))
        df = numbered_islands(df.withColumn("_changed", changed), key, ["start"], F.coalesce("_changed", F.lit(True)))
        return df.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("copy").alias("copy")).drop("run")

    runs = merged(blocks.select(*key, F.col(start).alias("start"), F.col(end).alias("end"), (~F.col(masked)).alias("copy")))
    many = F.count("*").over(Window.partitionBy(*key)) > 1
    runs = runs.withColumn("copy", F.col("copy") & ~(many & (F.col("end") - F.col("start") < least)))
    return merged(runs)


def dilate(df: DataFrame, key: list[str], at: str, margin: int) -> DataFrame:
    """Positions within margin of a given one, each once."""
    return df.select(*key, F.explode(F.sequence(F.col(at) - margin, F.col(at) + margin)).alias(at)).distinct()


def interval_blocks(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each block of width positions that a half-open interval meets, so that range joins become equi-joins."""
    return df.withColumn("_block", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def replace_ranges(old: DataFrame, new: DataFrame, ranges: DataFrame, key: list[str], at: str, width: int = 64) -> DataFrame:
    """old without rows in any half-open range [start, end) of its key, and new."""
    blocks = interval_blocks(ranges.select(*key, "start", "end").filter("start < end"), "start", "end", width)
    hit = [F.col(f"o.{c}") == F.col(f"r.{c}") for c in [*key, "_block"]] + [F.col(f"o.{at}") >= F.col("r.start"), F.col(f"o.{at}") < F.col("r.end")]
    kept = old.withColumn("_block", F.floor(F.col(at) / width)).alias("o").join(blocks.alias("r"), hit, "left_anti").drop("_block")
    return kept.unionByName(new)


def gap_validity(df: DataFrame, key: list[str], at: str, valid: str, most: int) -> DataFrame:
    """Interior gaps of at most most positions become valid and interpolated."""
    rows = df.withColumn("_last", F.last(F.when(F.col(valid), F.col(at)), ignorenulls=True).over(_over(key, at).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_next", F.first(F.when(F.col(valid), F.col(at)), ignorenulls=True).over(_over(key, at).rowsBetween(0, Window.unboundedFollowing)))
    filled = ~F.col(valid) & F.coalesce(F.col("_next") - F.col("_last") - 1 <= most, F.lit(False))
    return rows.withColumn("interpolated", filled).withColumn(valid, F.col(valid) | filled).drop("_last", "_next")


def hold(hits: DataFrame, key: list[str], run: str, at: str, tail: int, least_hits: int, least_show: int, frames: int) -> DataFrame:
    """Boxes of a run shown at every position: those of short runs dropped, a gap takes the later box, the last box stays for tail
    positions and at least until the run has been shown for least_show; clipped to [0, frames)."""
    w = Window.partitionBy(*key, run)
    own = hits.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least_hits).withColumn("_first", F.min(at).over(w)).withColumn("_last", F.max(at).over(w))
    own = own.withColumn("_prev", F.lag(at).over(w.orderBy(at)))
    end = F.greatest(F.col("_last") + tail, F.col("_first") + least_show - 1)
    span = F.sequence(F.coalesce(F.col("_prev") + 1, F.col(at)), F.when(F.col(at) == F.col("_last"), end).otherwise(F.col(at)))
    shown = own.withColumn("_at", F.explode(span)).withColumn("held", F.col("_at") != F.col(at)).withColumn(at, F.col("_at"))
    return shown.filter((F.col(at) >= 0) & (F.col(at) < frames)).drop("_n", "_first", "_last", "_prev", "_at")
