"""Sampled-splitter sharding: balanced shards in which equal texts stay side by side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import parts, small_batches, written

LEAST_ID = -(2**63)
MOST_RANGES = 20_000  # bounds what the driver holds, whatever the rows; ranges grow beyond that

Splitter = tuple[int, int, int]  # key, ident, row


def _below(splitters: np.ndarray, key: np.ndarray, ident: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The number of sorted splitters (n, 3) at or below each (key, ident, row)."""
    low, high = np.searchsorted(splitters[:, 0], key, "left"), np.searchsorted(splitters[:, 0], key, "right")
    tied = np.flatnonzero(low < high)
    for k in np.unique(key[tied]).tolist():  # keys that hold a splitter: there the id decides, then the row
        at = tied[key[tied] == k]
        own = splitters[low[at[0]] : high[at[0]]]
        first, last = np.searchsorted(own[:, 1], ident[at], "left"), np.searchsorted(own[:, 1], ident[at], "right")
        low[at] += first
        same = np.flatnonzero(first < last)
        for i in np.unique(ident[at[same]]).tolist():
            here = same[ident[at[same]] == i]
            low[at[here]] += np.searchsorted(own[first[here[0]] : last[here[0]], 2], row[at[here]], "right")
    return low


def _searcher(splitters: list[Splitter]):
    """A column function: _below() of columns key, ident and row."""
    held = np.array(splitters, dtype=np.int64).reshape(-1, 3)

    @F.arrow_udf("int")
    def find(key: pa.Array, ident: pa.Array, row: pa.Array) -> pa.Array:
        return pa.array(_below(held, *(np.asarray(c) for c in (key, ident, row))).astype(np.int32))

    return find


def _sample(rows: DataFrame, total: float, n: int, seed: int) -> list[tuple[int, int, int, int]]:
    """About n keys, each drawn in proportion to its weight; a hash stands in for chance, so reruns agree."""
    chance = F.pmod(F.xxhash64("key", "ident", "row", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    draws = F.floor(F.col("weight") * F.lit(n / total) + chance).cast("long")
    return sorted(tuple(r) for r in rows.select("key", "ident", "row", draws.alias("n")).filter("n > 0").collect())


def _quantiles(sample: list[tuple[int, int, int, int]], ranges: int) -> list[Splitter]:
    total, seen, out = sum(s[-1] for s in sample), 0, []
    for *at, n in sample:
        seen += n
        while len(out) < ranges - 1 and seen * ranges >= (len(out) + 1) * total:
            out.append(tuple(at))
    return sorted(set(out))


def shard_documents(docs: DataFrame, n_shards: int = 24, rows_per_range: int = 250_000, draws_per_range: int = 32, group_slack: float = 0.02) -> DataFrame:
    """Shard every row of docs (doc_id, text) so that the shards' bytes are near equal.

    A row weighs the UTF-8 bytes of its text plus 8 (null text: 8). Rows are ordered by (hash of text,
    doc_id, row number), so equal texts are neighbours. Splitters from a size-weighted sample cut that order into
    ranges of bounded work; a range that came out at over twice its share is sampled again by itself and
    divided, inside a group of copies or of repeated rows too, since doc_id and row number are part of the key. Exact sums over the ranges then
    place the shard boundaries; a boundary that falls inside a group smaller than group_slack of a
    shard moves to the group's nearer end, so only larger groups are ever divided.

    Returns doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null under this law).
    Null ids sort first; repeated rows get slots of their own; an empty table gives no rows; other columns
    are ignored; a very long text is a range by itself. Driver: a sample and sums that follow the number of ranges, at most about
    20,000 before overfull ones are divided, never rows or groups.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=10_000)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("ident"), F.xxhash64(text).alias("key"),
            F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        ),
        "shard-rows",
    )
    count, size = rows.agg(F.count("*"), F.sum("size")).first()
    if not count:
        empty = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
        return spark.createDataFrame([], empty)
    rows = rows.withColumn("weight", F.col("size") + F.lit(size / count))  # bounds the rows of a range as well as its bytes
    ranges, total = min(MOST_RANGES, parts(count, rows_per_range, 4 * n_shards)), 2.0 * size

    def placed_in(splitters):
        return rows.withColumn("range", _searcher(splitters)("key", "ident", "row"))

    splitters = _quantiles(_sample(rows, total, draws_per_range * ranges, 17), ranges)
    for again in range(8):
        ranged = placed_in(splitters)
        sums = {r["range"]: r for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("weight").alias("weight")).collect()}
        over = [k for k, r in sums.items() if r["weight"] > 2 * total / ranges and r["n"] > 1]
        if not over:
            break
        more = set(splitters)
        for k in over:
            cut = parts(sums[k]["weight"], total / ranges, 2)
            more |= set(_quantiles(_sample(ranged.filter(F.col("range") == k), sums[k]["weight"], draws_per_range * cut, 18 + again), cut))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)

    order = sorted(sums)
    before, bases = 0, []
    for k in order:
        bases.append((k, before))
        before += sums[k]["size"]
    base = F.broadcast(spark.createDataFrame(bases, "range int, base long"))  # a row for each range
    inside = Window.partitionBy("range").orderBy("key", "ident", "row")
    placed = written(
        ranged.withColumn("through", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("at", F.row_number().over(inside).cast("long"))
        .join(base, "range").withColumn("start", F.col("base") + F.col("through") - F.col("size"))
        .select("doc_id", "key", "size", "text_crc32", "range", "start", "at"),
        "shard-placed",
    )

    aims = [s * size // n_shards for s in range(1, n_shards)]
    hit = F.lit(False)
    for aim in aims:
        hit = hit | ((F.col("start") <= aim) & (F.col("start") + F.col("size") > aim))
    split = [r["key"] for r in placed.filter(hit).select("key").distinct().collect()]  # a group for each boundary at most
    groups = placed.filter(F.col("key").isin(split)).groupBy("key").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("b")).collect()
    at_aim = placed.filter(hit).select("start", (F.col("start") + F.col("size")).alias("end")).collect()
    cuts = []
    for aim in aims:
        a, b = next((r["a"], r["b"]) for r in groups if r["a"] <= aim < r["b"])
        if b - a > group_slack * size / n_shards:
            a, b = next((r["start"], r["end"]) for r in at_aim if r["start"] <= aim < r["end"])
        cuts.append(a if aim - a <= b - aim else b)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("start") >= cut).cast("int")
    placed = placed.withColumn("shard", shard)

    runs = sorted((r["range"], r["shard"], r["n"], r["first"]) for r in placed.groupBy("range", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect())
    filled, offsets = [0] * n_shards, []
    for k, s, n, first in runs:
        offsets.append((k, s, filled[s] - first))
        filled[s] += n
    offset = F.broadcast(spark.createDataFrame(offsets, "range int, shard int, shift long"))  # a row for each range and boundary
    return (
        placed.join(offset, ["range", "shard"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
    )
