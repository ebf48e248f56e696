"""Grouped summaries, gates, choices and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_ranks(df: DataFrame, key: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Order statistics of each key at places int(share * n), the last one at most, not interpolated; a sort that can spill, no gathered list."""
    w = Window.partitionBy(*key)
    rows = df.filter(F.col(value).isNotNull()).select(*key, value, F.row_number().over(w.orderBy(value)).alias("_i"), F.count("*").over(w).alias("_n"))
    place = lambda share: F.least(F.col("_n"), F.floor(F.col("_n") * F.lit(share)) + 1)
    return rows.groupBy(*key).agg(*(F.max(F.when(F.col("_i") == place(share), F.col(value))).alias(name) for name, share in shares.items()))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the sum of weights; 0 if that is 0."""
    return F.coalesce(F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0))


def calibration_summary(points: DataFrame, key: list[str]) -> DataFrame:
    """n, mean, least and largest ratio, least and mean score, mean of the speeds that are known, and whether all are fine."""
    return points.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("ratio").alias("mean_ratio"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"),
        F.min("score").alias("min_score"), F.avg("score").alias("mean_score"), F.avg("speed").alias("mean_speed"), F.bool_and("ok").alias("all_ok"),
    )


def calibration_choice(summary: DataFrame, key: list[str], level: str, floor: float, target: float) -> DataFrame:
    """Per key the cheapest level that reaches floor; if none does, that with the best score, fine ones first."""
    fine = F.col("all_ok") & (F.col("min_score") >= floor)
    first = F.min_by(F.struct("*"), F.when(fine, F.struct("mean_ratio", level)))
    best = lambda ok: F.max_by(F.struct("*"), F.when(ok, F.struct(F.col("min_score"), -F.col(level))))
    pick = summary.groupBy(*key).agg(F.coalesce(first, best(F.col("all_ok")), best(F.lit(True))).alias("c"))
    return pick.select(*key, F.col(f"c.{level}").alias(level), F.col("c.mean_ratio").alias("mean_ratio"), F.col("c.min_score").alias("min_score"), (F.col("c.all_ok") & (F.col("c.min_score") >= floor)).alias("meets_floor"), (F.col("c.min_score") >= target).alias("meets_target"))


def check_suite(df: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """A row for each check and key, with the verdict over all of them: key, check, ok, passed."""
    rows = df.select(*key, F.explode(F.array(*(F.struct(F.lit(n).alias("check"), c.alias("ok")) for n, c in checks.items()))).alias("c")).select(*key, "c.check", "c.ok")
    return rows.withColumn("passed", F.bool_and("ok").over(Window.partitionBy(*key)))


def held_for(totals: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """The kinds that hold an output back, in the order given."""
    return totals.withColumn("held_for", F.concat_ws(",", *(F.when(test, F.lit(kind)) for kind, test in kinds.items())))


def share_stats(df: DataFrame, key: list[str], value: str, budget: float) -> DataFrame:
    """mean, p95, max of a share, and in how many rows it is over budget."""
    v = F.col(value)
    return df.groupBy(*key).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.95)).alias("p95"), F.max(v).alias("max"), F.count_if(v > budget).alias("over"))


def counted_in_all(df: DataFrame, keys: list[Column], hit: Column) -> DataFrame:
    """Each row counted under each of its keys: key, hit, total, share."""
    rows = df.select(F.explode(F.array(*keys)).alias("key"), hit.cast("int").alias("hit"))
    return rows.groupBy("key").agg(F.sum("hit").alias("hit"), F.count("*").alias("total"), F.avg("hit").alias("share"))


def with_zeros(df: DataFrame, names: list[str], column: str) -> DataFrame:
    """A row for every name, also where df has none."""
    return df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string").join(df, column, "left")


def threshold_sweep(df: DataFrame, floors: list[float], value: str, kind: str) -> DataFrame:
    """Rows kept at each floor by kind, from one pass: each row is counted at the floors it reaches."""
    reached = F.filter(F.array(*map(F.lit, floors)), lambda f: F.col(value) >= f)
    return df.select(kind, F.explode(reached).alias("floor")).groupBy("floor", kind).agg(F.count("*").alias("kept"))


def on_all(df: DataFrame, key: list[str], item: str) -> DataFrame:
    """Keys that have a row for every distinct item."""
    total = df.select(F.count_distinct(item).alias("_total"))
    return df.groupBy(*key).agg(F.count_distinct(item).alias("items")).join(total, F.col("items") == F.col("_total")).drop("_total")


def jitter(df: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Root mean square of second differences over successive triples."""
    w = Window.partitionBy(*key).orderBy(at)
    second = F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)
    return df.withColumn("_second", second).groupBy(*key).agg(F.sqrt(F.avg(F.col("_second") * F.col("_second"))).alias("jitter"), F.count("_second").alias("triples"))


def variation(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Population standard deviation over mean, null for fewer than two values."""
    return df.groupBy(*key).agg(F.when(F.count(value) >= 2, F.stddev_pop(value) / F.avg(value)).alias("cv"), F.count(value).alias("n"))
