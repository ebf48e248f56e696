"""Work distribution and reconciliation: differences, leftovers, last entries, balanced shares."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def record_diff(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each key and field: a, b, difference, relative change, and on which side the key is."""
    a, b = (df.select(key, *(F.col(c).cast("double").alias(f"{c}_{s}") for c in fields), F.lit(True).alias(f"in_{s}")) for df, s in ((first, "a"), (second, "b")))
    both = a.join(b, key, "full_outer")
    side = F.when(F.col("in_a").isNull(), F.lit("second")).when(F.col("in_b").isNull(), F.lit("first")).otherwise(F.lit("both"))
    rows = both.withColumn("side", side).select(key, "side", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b")) for c in fields))).alias("f"))
    d = F.col("f.b") - F.col("f.a")
    return rows.select(key, "side", "f.field", "f.a", "f.b", d.alias("difference"), (d / F.nullif(F.col("f.a"), F.lit(0.0))).alias("relative"))


def reconcile(sources: DataFrame, outputs: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Each source with the first place, in order, that holds its output, and the value there; missing if none does."""
    out = sources
    for name, df in outputs:
        out = out.join(df.select(key, F.struct(F.lit(name).alias("place"), F.col(value).alias("value")).alias(f"_{name}")), key, "left")
    found = F.coalesce(*(F.col(f"_{name}") for name, _ in outputs))
    return out.select(*sources.columns, F.coalesce(found.getField("place"), F.lit("missing")).alias("place"), found.getField("value").alias("found"))


def unfinished(inputs: DataFrame, done: list[DataFrame], leases: DataFrame, key: str, now: int, lease: int) -> DataFrame:
    """Inputs with no output under any name and no live lease."""
    for df in done:
        inputs = inputs.join(df.select(key), key, "left_anti")
    return inputs.join(leases.filter(now - F.col("time") < lease).select(key), key, "left_anti")


def last_done(ledger: DataFrame, key: str, line: str, status: str, done: list[str]) -> DataFrame:
    """The last entry of each key among those with a finished status: one aggregation, no sort."""
    rows = ledger.filter(F.col(status).isin(done))
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.col(line)).alias("e")).select("e.*")


def audit_chain(lines: DataFrame, key: list[str], seq: str, prev: str, payload: str, own: str) -> DataFrame:
    """Verifies a hash chain: each line's hash is that of prev and payload, and prev is the hash of the line before.

    ok, checked and the first problem of each key. Both tests look at a line and its predecessor only.
    """
    w = Window.partitionBy(*key).orderBy(seq)
    zero = F.lit("0" * 64)
    before = F.when(F.row_number().over(w) == 1, zero).otherwise(F.lag(own).over(w))
    differ = lambda a, b: ~a.eqNullSafe(b) | a.isNull()  # noqa: E731  what is missing is wrong
    problem = F.when(differ(F.col(own), F.sha2(F.concat(prev, payload), 256)), F.lit("hash")).when(differ(F.col(prev), before), F.lit("prev")).when(differ(F.col(seq), F.row_number().over(w) - 1), F.lit("seq"))
    rows = lines.withColumn("_problem", problem)
    return rows.groupBy(*key).agg(F.count("*").alias("checked"), F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col(seq))).alias("problem"), F.count("_problem").alias("_n")).select(*key, (F.col("_n") == 0).alias("ok"), "checked", "problem")


def longest_first(items: list[tuple[str, int]], shares: int) -> list[tuple[str, int, int]]:
    """(name, size, share): the largest item first, each to the least loaded share, the lowest number on ties."""
    heap = [(0, k) for k in range(shares)]
    out = []
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        out.append((name, size, k))
        heapq.heappush(heap, (load + size, k))
    return out


def balanced_shares(df: DataFrame, group: str, name: str, size: str, shares: int) -> DataFrame:
    """longest_first() within each group; a group is one task's work."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        done = longest_first(list(zip(rows[name], rows[size].astype(int), strict=True)), shares)
        return pd.DataFrame([(key[0], *x) for x in done], columns=[group, name, size, "share"])

    kinds = dict(df.dtypes)
    return df.select(group, name, size).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {name} string, {size} long, share int")


def claim_order(inputs: DataFrame, done: DataFrame, claims: DataFrame, key: str, size: str, now: int, lease: int) -> DataFrame:
    """What may be claimed, the largest first: inputs that aren't done and whose last claim (key, owner, time) is older than lease; place, and the last owner if there was one."""
    last = claims.groupBy(key).agg(F.max(F.struct("time", "owner")).alias("_c"))
    free = inputs.join(done.select(key).distinct(), key, "left_anti").join(last, key, "left").filter(F.col("_c").isNull() | (F.lit(now) - F.col("_c.time") >= lease))
    buckets = free.withColumn("_b", F.floor(F.log2(F.col(size) + 1)))
    # numbered within powers of two of the size, so that no task orders everything
    held = buckets.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = buckets.join(F.broadcast(held), "_b").withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(size), key)))  # at most 64 sums
    return rows.select(key, size, (F.col("_before") + F.col("_k")).alias("place"), F.col("_c.owner").alias("last_owner"))
