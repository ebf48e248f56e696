"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT, dropped, joined, mapped, written


class Sets:
    """Union-find over arbitrary keys; a set's name is its smallest key."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x], x = root, above
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, batch by batch, as a spanning star of each set in it."""
    for batch in batches:
        sets, seen = Sets(), set()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(a, b)
            seen.update((a, b))
        ties = [(x, r) for x in seen if (r := sets.find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in ties], pa.int64()) for k in (0, 1)], ["a", "b"])


def _minima(edges: DataFrame, at_most: int, sent: int) -> DataFrame:
    """The smallest m and the number n of edges of every a; a table unless at_most rows are sure to be few enough to send."""
    out = edges.groupBy("a").agg(F.min("m").alias("m"), F.count("*").alias("n"))
    return out if at_most * 56 <= sent else written(out, "lowest")


def _stars(edges: DataFrame) -> tuple[int, int]:
    """Number of edges (a, b), b < a, and how many nodes keep them from being stars around each component's smallest node: those with two
    smaller neighbours, or with a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60, sent: int = SENT) -> DataFrame:
    """node and component (its smallest reachable node) for every node with an edge to another one.

    Alternating large-star and small-star steps until only stars are left: each node's larger neighbours, then its smaller ones, are tied to the smallest
    it sees. Minima are combined before they are shuffled. Edges join the minima on the node: these are sent to every task while they
    take at most sent bytes; beyond that only those of hubs are, whose number their edges bound, and the rest is shuffled, so a
    node with millions of neighbours is the work of all tasks. Each step's edges are a table in the shared folder. Batches of edges are first thinned to spanning
    stars. Edges with a null end or equal ends say nothing; repeated ones count once; without edges there are no rows.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).filter("a <> b")
    now = written(mapped(pairs, _forest, "a long, b long").distinct(), "edges")
    for _ in range(rounds):
        n, loose = _stars(now)
        if not loose:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = _minima(both.withColumn("m", F.least("a", "b")), 2 * n, sent)
        large = joined(both.filter("b > a"), lowest, "a", rows="n", sent=sent, at_most=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "edges")
        least = _minima(large.withColumn("m", F.col("b")), n, sent)
        small = joined(large, least, "a", rows="n", sent=sent, at_most=n).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        dropped(large)
        dropped(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
