"""Similarity of embeddings by identity: calibration pairs, best matches, leak verdicts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import centre, long_side, overlap, renamed

NUMBERS = 1 << 16  # of the vectors in one block
BINS = 1 << 15  # of scores, to a unit


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(F.col(x), F.col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def evenly(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """At most n rows of each key, evenly spaced in order: those at places int(k * size / n)."""
    w = Window.partitionBy(key)
    place, size = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    # place p is int(k * size / n) for some k exactly if a multiple of size / n falls in [p, p + 1)
    df = df.withColumn("_p", place).withColumn("_s", size)
    k = F.ceil(F.col("_p") * n / F.col("_s"))
    return df.filter((F.col("_s") <= n) | ((k < n) & (F.floor(k * F.col("_s") / n) == F.col("_p")))).drop("_p", "_s")


def pairs(df: DataFrame, row: str, identity: str, vector: str, frame: str, cap: int = 40, apart: float = 1.5) -> DataFrame:
    """a, b, kind, score and the smaller and larger long side of genuine pairs (one identity, different frames) of a capped sample of each identity, and of all impostor
    pairs (different identities of one frame, not overlapping, centres apart sides or more from each other). df: row, identity, vector, frame, x, y, w, h.

    Genuine pairs are an equi-join on the identity, where the cap bounds each side; impostor pairs one on the frame, which holds as many boxes as a picture.
    """
    keep = [row, identity, vector, frame, "x", "y", "w", "h"]
    both = lambda x: (renamed(x.select(*keep), "a_"), renamed(x.select(*keep), "b_"))
    col = lambda side, c: F.col(f"{side}_{c}")
    a, b = both(evenly(df, identity, row, cap))
    genuine = a.join(b, (col("a", identity) == col("b", identity)) & (col("a", row) < col("b", row)) & (col("a", frame) != col("b", frame)))
    a, b = both(df)
    (ax, ay), (bx, by) = centre("a_"), centre("b_")
    far = F.hypot(ax - bx, ay - by) >= apart * F.greatest(long_side("a_"), long_side("b_"))
    impostor = a.join(b, (col("a", frame) == col("b", frame)) & (col("a", row) < col("b", row)) & (col("a", identity) != col("b", identity)) & (overlap("a_", "b_") <= 0) & far)
    sides = long_side("a_"), long_side("b_")
    pick = lambda x, kind: x.select(col("a", row).alias("a"), col("b", row).alias("b"), F.lit(kind).alias("kind"), cosine(f"a_{vector}", f"b_{vector}").alias("score"), F.least(*sides).alias("smaller"), F.greatest(*sides).alias("larger"))
    return pick(genuine, "genuine").unionByName(pick(impostor, "impostor"))


def exact_quantiles(scores: DataFrame, counts: dict[int, int], probabilities: list[float]) -> list[float | None]:
    """Interpolated quantiles of column score, whose values are counted by floor(score * BINS): only the bins that hold the ranks are sorted."""
    bins = sorted(counts)
    ends, n = np.cumsum([counts[k] for k in bins]), sum(counts.values())
    if not n:
        return [None] * len(probabilities)
    places = [p * (n - 1) for p in probabilities]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    held = [int(np.searchsorted(ends, r, side="right")) for r in ranks]
    wanted = [(bins[h], int(r - ends[h] + counts[bins[h]])) for r, h in zip(ranks, held, strict=True)]
    inside = scores.withColumn("_bin", F.floor(F.col("score") * BINS)).filter(F.col("_bin").isin(sorted({k for k, _ in wanted}))).groupBy("_bin", "score").agg(F.count("*").alias("_n"))
    inside = inside.withColumn("_end", F.sum("_n").over(Window.partitionBy("_bin").orderBy("score")))
    hit = [(F.col("_bin") == k) & (F.col("_end") > r) & (F.col("_end") - F.col("_n") <= r) for k, r in wanted]
    found = inside.agg(*(F.max(F.when(h, F.col("score"))) for h in hit)).first()
    at = dict(zip(ranks, found, strict=True))
    return [at[lo] if lo == hi else (hi - x) * at[lo] + (x - lo) * at[hi] for x in places for lo, hi in [(math.floor(x), math.ceil(x))]]


def calibration(scored: DataFrame, published: float) -> DataFrame:
    """Impostor quantiles, the share of them at a published threshold or over, genuine quantiles, and how many genuine pairs pass p99.

    Impostors are counted in bins of fixed width first and then sorted only in the bins that matter, so no task holds all of them.
    """
    imp, gen = scored.filter("kind = 'impostor' AND score IS NOT NULL").select("score"), scored.filter("kind = 'genuine'")
    bins = imp.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.max("score").alias("top"), F.count_if(F.col("score") >= published).alias("over")).collect()
    n = sum(r["n"] for r in bins)
    median, p95, p99 = exact_quantiles(imp, {r["bin"]: r["n"] for r in bins}, [0.5, 0.95, 0.99])
    q = lambda p: F.percentile("score", F.lit(p))
    known = lambda x: F.lit(x).cast("double")
    return gen.agg(
        F.lit(n).cast("long").alias("impostors"), known(median).alias("impostor_median"), known(p95).alias("impostor_p95"), known(p99).alias("p99"), known(max((r["top"] for r in bins), default=None)).alias("impostor_max"),
        known(sum(r["over"] for r in bins) / n if n else None).alias("over_published"), F.count("score").alias("genuine"), q(0.5).alias("genuine_median"), q(0.05).alias("genuine_p05"), F.count_if(F.col("score") >= known(p99)).alias("genuine_passed"),
    )


def squares(df: DataFrame, key: list[str], row: str, vector: str, numbers: int = NUMBERS) -> DataFrame:
    """Rows once for each square (_low, _high) of their key's grid of blocks, so that every two rows of a key meet in exactly one square.

    A key's rows are dealt into blocks of about numbers values by a hash; _side is a row's block, _v its vector as double, _d its length.
    Rows with a null in key, row or vector have no partner and are left out, and only vectors of one length meet.
    """
    known = F.forall("_v", lambda x: x.isNotNull())
    for c in (*key, row):
        known = known & F.col(c).isNotNull()
    rows = df.withColumn("_v", F.col(vector).cast("array<double>")).filter(known).withColumn("_d", F.size("_v"))
    # there are at most as many large keys as there are full blocks
    large = rows.groupBy(*key, "_d").agg(F.ceil(F.count("*") * F.col("_d") / numbers).cast("int").alias("_split")).filter("_split > 1")
    rows = rows.join(F.broadcast(large), [*key, "_d"], "left").withColumn("_split", F.coalesce("_split", F.lit(1)))
    rows = rows.withColumn("_side", F.pmod(F.xxhash64(row), "_split").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_split") - 1)))
    return rows.withColumns({"_low": F.least("_side", "_other"), "_high": F.greatest("_side", "_other")})


def products(table: pa.Table, most: int = 1 << 20):
    """Places and cosines of the two sides of a square, some rows of the lower side at a time; NaN for a vector of length 0."""
    side = table.column("_side").to_numpy()
    values = table.column("_v").combine_chunks()
    v = values.flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    low, high = (np.flatnonzero(side == table.column(c)[0].as_py()) for c in ("_low", "_high"))
    step = max(1, most // max(1, len(high)))
    for k in range(0, len(low), step):
        yield low[k : k + step], high, v[low[k : k + step]] @ v[high].T


def best_elsewhere(df: DataFrame, row: str, identity: str, vector: str, numbers: int = NUMBERS) -> DataFrame:
    """Each row's best cosine with any other row of its identity; -1 if there is none.

    All pairs of an identity are compared, in squares of bounded size, each one matrix product; what is shuffled back is a partial maximum for each row and square.
    """

    def square(table: pa.Table) -> pa.Table:
        ids = table.column(row).to_numpy()
        best = np.full(len(ids), -np.inf)
        for a, b, score in products(table):
            if not len(b):
                continue
            score[(ids[a][:, None] == ids[b][None, :]) | np.isnan(score)] = -np.inf
            best[a] = np.maximum(best[a], score.max(axis=1))
            best[b] = np.maximum(best[b], score.max(axis=0))
        return table.select([row, identity]).append_column("_s", pa.array(best, pa.float64(), mask=np.isinf(best)))

    kinds = dict(df.dtypes)
    part = squares(df.select(row, identity, vector), [identity], row, vector, numbers).select(row, identity, "_v", "_d", "_side", "_low", "_high")
    part = part.groupBy(identity, "_d", "_low", "_high").applyInArrow(square, f"`{row}` {kinds[row]}, `{identity}` {kinds[identity]}, _s double")
    best = df.select(row, identity, F.lit(None).cast("double").alias("_s")).unionByName(part)
    return best.groupBy(row, identity).agg(F.coalesce(F.max("_s"), F.lit(-1.0)).alias("best"))


def verdict(best: Column, size: Column, blind: float, threshold: float, margin: float) -> Column:
    """blind, then unidentifiable, then leak, then covered; the first that holds."""
    return F.when(size < blind, F.lit("blind")).when(best < threshold - margin, F.lit("unidentifiable")).when(best >= threshold, F.lit("leak")).otherwise(F.lit("covered"))
