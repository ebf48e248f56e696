"""Smaller reports on packets, runs, samples and settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_keys(first: DataFrame, second: DataFrame, key: list[str], values: list[str], places: int = 3) -> DataFrame:
    """Keys whose multisets of rounded values differ, order aside, with how many rows differ."""
    rounded = [F.round(F.col(v), places).alias(v) for v in values]
    both = first.select(*key, *rounded, F.lit(1).alias("n")).unionByName(second.select(*key, *rounded, F.lit(-1).alias("n")))
    differ = both.groupBy(*key, *values).agg(F.sum("n").alias("n")).filter("n <> 0")
    return differ.groupBy(*key).agg(F.sum(F.abs("n")).alias("different"))


def even_sample(df: DataFrame, key: list[str], order: str, count: int) -> DataFrame:
    """At most count rows of each key: those at places int(n * (k + 0.5) / count)."""
    w = Window.partitionBy(*key)
    rows = df.withColumn("_p", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(F.col("_n") * (2 * k + 1) / (2 * count)))
    return rows.filter(F.array_contains(places, F.col("_p").cast("long"))).drop("_p", "_n")


def seeded_sample(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """count rows in the order of a hash of key and seed: the same in every run, not that of another generator."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(count)


def reorder_delay(packets: DataFrame, key: list[str], order: str, pts: str, dts: str, duration: str, first: int = 60) -> DataFrame:
    """Over a key's first packets: the largest pts - dts in steps of the smallest positive duration (1 at least), 0 at least."""
    w = Window.partitionBy(*key).orderBy(order)
    few = packets.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= first)
    step = F.greatest(F.coalesce(F.min(F.when(F.col(duration) > 0, F.col(duration))), F.lit(1)), F.lit(1))
    return few.groupBy(*key).agg(F.greatest(F.rint(F.max(F.col(pts) - F.col(dts)) / step).cast("long"), F.lit(0)).alias("delay"))


def keyframe_interval(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """Mean of successive gaps, null for fewer than two."""
    return df.groupBy(*key).agg(F.when(F.count(at) > 1, (F.max(at) - F.min(at)) / (F.count(at) - 1)).alias("interval"))


def same_packets(first: DataFrame, second: DataFrame, key: list[str], pts: str) -> DataFrame:
    """Both sides' counts and how many of the sorted timestamps differ, paired by rank."""
    w = Window.partitionBy(*key).orderBy(pts)
    a, b = (df.select(*key, F.row_number().over(w).alias("_rank"), F.col(pts).alias(n)) for df, n in ((first, "a"), (second, "b")))
    both = a.join(b, [*key, "_rank"], "full_outer")
    return both.groupBy(*key).agg(F.count("a").alias("first"), F.count("b").alias("second"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatched"))


def shares_of_total(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Totals by key, their share of everything, and their rank."""
    sums = df.groupBy(*key).agg(F.sum(value).alias("total"))
    return sums.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy())).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), *key)))


def settings_grid(spark, parameters: dict[str, list], without: Column | None = None) -> DataFrame:
    """The cross product of short lists of parameters, less what without holds for. The lists are the caller's, so few."""
    one = spark.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in parameters.items()])
    grid = reduce(lambda df, k: df.withColumn(k, F.explode(k)), parameters, one)
    return grid.filter(~without) if without is not None else grid


def entry_delay(df: DataFrame, key: list[str], at: str, visible: Column, covered: Column, length: int) -> DataFrame:
    """Steps from an object's first visible to its first covered position; length if it never is."""
    first = lambda test: F.min(F.when(test, F.col(at)))
    seen = df.groupBy(*key).agg(first(visible).alias("seen"), first(visible & covered).alias("covered"))
    return seen.filter("seen IS NOT NULL").select(*key, F.coalesce(F.col("covered") - F.col("seen"), F.lit(length)).alias("delay"))


def travelled(df: DataFrame, key: list[str], at: str, x: str, y: str) -> DataFrame:
    """Path length and median step over successive positions."""
    w = Window.partitionBy(*key).orderBy(at)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.withColumn("_step", step).groupBy(*key).agg(F.sum("_step").alias("length"), F.median("_step").alias("median_step"), F.count("_step").alias("steps"))


def camera_path(df: DataFrame, key: list[str], at: str, dx: str, dy: str) -> DataFrame:
    """Running sums of shifts."""
    w = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"path_x": F.sum(dx).over(w), "path_y": F.sum(dy).over(w)})


def mirror_plan(files: DataFrame, path: str, suffixes: list[str], out_suffix: str) -> DataFrame:
    """video, copy or skip for each file of a listing: own outputs are skipped."""
    p = F.lower(F.col(path))
    video = reduce(lambda a, b: a | b, (p.endswith(s) for s in suffixes))
    own = F.regexp_extract(p, r"([^/]*?)(\.[^./]*)?$", 1).endswith(out_suffix)
    return files.withColumn("action", F.when(own, "skip").when(video, "video").otherwise("copy"))


def cyclic(df: DataFrame, key: list[str], order: str, lists: dict[str, list]) -> DataFrame:
    """Values of short lists dealt to the rows of each key in order, the first list fastest."""
    rows, turn = df.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1), 1
    for name, values in lists.items():
        place = F.floor(F.col("_i") / turn) % len(values) + 1
        rows, turn = rows.withColumn(name, F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), place.cast("int"))), turn * len(values)
    return rows.drop("_i")


def packet_timing(packets: DataFrame, key: list[str], pts: str, duration: str) -> DataFrame:
    """Packets of each key, how many lack a timestamp or repeat one, whether none does, and the last one's duration: its own, or where it has none the upper median
    step between successive timestamps, 1 at least."""
    w = Window.partitionBy(*key)
    steps = packets.filter(F.col(pts).isNotNull()).withColumn("_step", F.lead(pts).over(w.orderBy(pts)) - F.col(pts)).filter("_step IS NOT NULL")
    ranked = steps.select(*key, "_step", F.row_number().over(w.orderBy("_step")).alias("_i"), F.count("*").over(w).alias("_n")).filter(F.col("_i") == F.floor(F.col("_n") / 2) + 1)
    known = F.when(F.col(pts).isNotNull(), F.struct(pts, duration))
    out = packets.groupBy(*key).agg(F.count("*").alias("packets"), F.count_if(F.col(pts).isNull()).alias("missing"), (F.count(pts) - F.count_distinct(pts)).alias("repeated"), F.max(known)[duration].alias("_last"))
    out = out.join(ranked.select(*key, "_step"), key, "left")
    last = F.when((F.col("_last") > 0) | F.col("_step").isNull(), F.col("_last")).otherwise(F.col("_step"))
    return out.select(*key, "packets", "missing", "repeated", F.greatest(last, F.lit(1)).alias("last_duration"), ((F.col("missing") == 0) & (F.col("repeated") == 0)).alias("ok"))


def fast_spans(df: DataFrame, key: list[str], at: str, x: str, y: str, back: int, least: float) -> DataFrame:
    """Rows whose mean speed since back rows before is least or more."""
    w = Window.partitionBy(*key).orderBy(at)
    gone = lambda c: F.col(c) - F.lag(c, back).over(w)
    return df.withColumn("speed", F.hypot(gone(x), gone(y)) / gone(at)).filter(F.col("speed") >= least)


def retimed_verdict(first: DataFrame, second: DataFrame, key: list[str], pts: str, order: str, base: str, payload: str) -> DataFrame:
    """Why a retimed file isn't the first one's packets at the second's times, the first reason that holds, else empty: time base, frame count, timestamps (how many
    differ, paired by rank), packets changed (a payload differs, paired in order)."""
    counts = same_packets(first, second, key, pts)
    w = Window.partitionBy(*key).orderBy(order)
    a, b = (df.select(*key, F.row_number().over(w).alias("_rank"), F.col(payload).alias(n), F.col(base).alias(f"base_{n}")) for df, n in ((first, "a"), (second, "b")))
    packets = a.join(b, [*key, "_rank"], "full_outer").groupBy(*key).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.max("base_a").alias("base_a"), F.max("base_b").alias("base_b"))
    why = (
        F.when(~F.col("base_a").eqNullSafe(F.col("base_b")), F.lit("time base")).when(F.col("first") != F.col("second"), F.lit("frame count"))
        .when(F.col("mismatched") > 0, F.concat(F.col("mismatched").cast("string"), F.lit(" frames off"))).when(F.col("changed") > 0, F.lit("packets changed")).otherwise("")
    )
    return counts.join(packets, key).select(*key, why.alias("problem"))


def destinations(files: DataFrame, path: str, source: str, target: str, suffix: str) -> DataFrame:
    """Where each file below source goes below target, its name ending in suffix; own outputs stay out where source and target are one folder, and a target inside another
    folder's source is refused (destination null)."""
    own = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1).endswith(suffix)
    rest = F.substring(F.col(path), F.lit(len(source) + 2), F.length(path))
    inside = target != source and target.startswith(f"{source}/")
    named = F.concat(F.lit(f"{target}/"), F.regexp_replace(rest, r"(\.[^./]*)?$", ""), F.lit(suffix), F.regexp_extract(path, r"(\.[^./]*)$", 1))
    kept = files.filter(~own) if source == target else files
    return kept.select(path, F.lit(None).cast("string").alias("destination") if inside else named.alias("destination"))
