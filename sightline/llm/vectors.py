"""Near-duplicate vectors by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, mapped, written
from .components import connected_components

LEAST_ID = -(2**63)
CELL = 1.6  # width of a cell, in standard deviations of a random projection
COUNTED = 32  # projections whose windows are counted
STEPS = 25  # of a counted projection to a standard deviation; a projection is kept as one byte


class Plan:
    """Random unit directions for vectors of one length, and how many orders and collisions a recall needs.

    Calibrated on simulated pairs whose cosine is exactly the threshold, the hardest that must be found.
    """

    def __init__(self, dim: int, n: int, least: float, recall: float, seed: int = 5, block: int = 16):
        rng = np.random.default_rng(seed + dim)
        self.spread = 1 / math.sqrt(dim)
        self.width, self.window = CELL * self.spread, math.ceil(2.5 * STEPS * math.sqrt(2 - 2 * least)) + 1
        # chance that two unrelated vectors share a cell on one projection decides how many are sorted together
        z = rng.standard_normal(200_000) * math.sqrt(2)
        apart = float(np.clip(1 - np.abs(z) / CELL, 0, None).mean())
        self.depth = max(4, math.ceil(math.log(max(n, 2) / block) / math.log(1 / apart)))
        a = self._unit(rng.standard_normal((20_000, dim)))
        b = rng.standard_normal((20_000, dim))
        if dim > 1:
            b = self._unit(b - (a * b).sum(1, keepdims=True) * a)
            b = least * a + math.sqrt(1 - least * least) * b
        else:  # on a line, vectors have the same direction or the opposite one
            b = a
        self.count = self._unit(rng.standard_normal((COUNTED, dim)))
        met = (np.abs(self.places(a).astype(np.int16) - self.places(b)) <= self.window).sum(1)
        self.least_met = int(np.quantile(met, 0.002))
        orders, missed = [], np.ones(len(a), dtype=bool)
        while (missed.mean() > 1 - recall and len(orders) < 256) or not orders:
            direction, shift = self._unit(rng.standard_normal((self.depth, dim))), rng.uniform(0, self.width, self.depth)
            orders.append((direction, shift))
            missed &= (np.floor((a @ direction.T + shift) / self.width) != np.floor((b @ direction.T + shift) / self.width)).any(1)
        self.orders = orders

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Where each vector lies on each counted projection, in steps."""
        return np.clip(np.rint(unit @ self.count.T * (STEPS / self.spread)), -127, 127).astype(np.int8)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """A hash of each vector's cell in each order."""
        out = np.empty((len(unit), len(self.orders)), dtype=np.int64)
        for k, (direction, shift) in enumerate(self.orders):
            cell = np.floor((unit @ direction.T + shift) / self.width).astype(np.int64)
            h = np.full(len(unit), k + 1, dtype=np.uint64)
            for c in cell.T:
                h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, k] = h.view(np.int64)
        return out


def _units(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, size * (len(rows) + 1), size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _project(plan: Plan, dim: int):
    """Each vector's places on the counted projections and its cell in each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _units(_matrix(batch.column("embedding"), dim))
                cells = plan.cells(unit)
                lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("many"), batch.column("embedding"), _binary(plan.places(unit)), lists], ["id", "many", "embedding", "places", "cells"])

    return run


def _pairs_within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places i < j with the same group; equal groups stand together."""
    n = len(group)
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, n)
    after = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n) - 1
    i = np.repeat(np.arange(n), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(after.cumsum() - after, after)
    return i, j


def _met(plan: Plan, frame: dict, most_pairs: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block that lie in each other's window on enough of the counted projections, some blocks or rows at a time."""
    at, group, side, square = np.ascontiguousarray(frame["places"].T), frame["group"], frame["side"], frame["square"]
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    starts = np.append(0, ends[:-1])
    sizes = (ends - starts).astype(np.int64)
    work = (sizes * (sizes - 1) // 2).cumsum()

    def check(i, j):
        keep = (square[i] == 1) | (side[i] != side[j])
        i, j = i[keep], j[keep]
        missed = np.zeros(len(i), dtype=np.int16)
        for k, c in enumerate(at, 1):
            missed += np.abs(c[i].astype(np.int16) - c[j]) > plan.window
            if k % 8 == 0:  # what can't reach the count any more goes
                keep = missed <= len(at) - plan.least_met
                i, j, missed = i[keep], j[keep], missed[keep]
        return i, j

    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + most_pairs, "right")))
        lo, hi = starts[a], ends[b - 1]
        if b == a + 1 and sizes[a] > 900:
            step = max(1, most_pairs // sizes[a])
            for r in range(lo, hi, step):
                i = np.repeat(np.arange(r, min(r + step, hi)), hi - lo)
                j = np.tile(np.arange(lo, hi), len(i) // (hi - lo))
                yield check(i[i < j], j[i < j])
        else:
            i, j = _pairs_within(group[lo:hi])
            yield check(i + lo, j + lo)
        a = b


def _whole_groups(read, work):
    """work() on tables of whole groups, rows coming sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4000:
                continue
            table = pa.Table.from_batches(held)
            group = table["group"].to_numpy()
            last = int(np.flatnonzero(group == group[-1])[0])
            if last:
                yield work(read(table.slice(0, last).combine_chunks()))
                held = table.slice(last).to_batches()
        if held:
            yield work(read(pa.Table.from_batches(held).combine_chunks()))

    return run


def _read(table: pa.Table) -> dict:
    out = {c: table[c].to_numpy() for c in ("id", "group", "side", "square")}
    return out | {"places": np.frombuffer(b"".join(table["places"].to_pylist()), dtype=np.int8).reshape(-1, COUNTED)}


def _candidates(plan: Plan):
    """The rows of each block that collide often enough with another of its rows."""

    def work(frame: dict) -> pa.RecordBatch:
        hit = np.zeros(len(frame["id"]), dtype=bool)
        for i, j in _met(plan, frame):
            hit[i] = hit[j] = True
        at = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([pa.array(frame[c][at]) for c in ("id", "turn", "group", "side", "square")], ["id", "turn", "group", "side", "square"])

    return _whole_groups(lambda table: _read(table) | {"turn": table["turn"].to_numpy()}, work)


def _verify(plan: Plan, dim: int, least: float):
    """Verifies the pairs that collide often enough, and gives each vector's links and a star of its linked set."""

    def read(table: pa.Table) -> dict:
        one = lambda c, width: _matrix(table[c].combine_chunks(), width)
        return _read(table) | {"many": table["many"].to_numpy(), "turn": table["turn"].to_numpy(), "unit": _units(one("embedding", dim)), "cells": one("cells", len(plan.orders))}

    def work(frame: dict) -> pa.RecordBatch:
        unit, turn, own, ids, many = (frame[c] for c in ("unit", "turn", "cells", "id", "many"))
        label, total, found = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64), []
        for i, j in _met(plan, frame):
            # a pair belongs to the first order that brings it together
            new = ~((own[i] == own[j]) & (np.arange(own.shape[1]) < turn[i][:, None])).any(1)
            i, j = i[new], j[new]
            good = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
            found.append((i[good], j[good]))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.empty(0, dtype=np.int64) for k in (0, 1))
        np.add.at(total, i, many[j])
        np.add.at(total, j, many[i])
        while True:
            old = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            label = label[label]
            if (old == label).all():
                break
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some]), pa.array(ids[label[some]])], ["id", "links", "root"])

    return _whole_groups(read, work)


def near_vectors(vectors: DataFrame, least: float = 0.95, recall: float = 0.97, block: int = 1024) -> DataFrame:
    """Links between vectors (vec_id, embedding) of cosine least or more, in double precision, and their components.

    Equal vectors are one class. One-dimensional projections are sorted some at a time: vectors in the same cells of one
    such order form a block. A single projection's windows would hold a fifth of all pairs or more, so their collisions grow with the square of
    the rows; the number sorted together grows with the logarithm of the rows, so blocks stay small. Within a block, collisions in the windows of 32 further
    projections, centred on each vector, are counted; a projection takes one byte a vector, so what is shuffled for an order is an id, a
    cell and 32 bytes. Only vectors that collide often enough with another of the block are fetched; their pairs are verified exactly, and a pair met
    in several orders belongs to the first. The number of orders and the least count are calibrated on simulated pairs at the threshold. A block over its
    limit is divided into a grid of squares, each one task's work; no pair leaves a task, only link counts and spanning stars.

    Returns vec_id, n_links, component_id, kept. Vectors that are null, empty, zero or hold null or non-finite parts link
    with nothing; vectors of different lengths never link; repeated rows are copies that link with each other; an empty table gives no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("ident", F.coalesce("vec_id", F.lit(LEAST_ID))).withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("embedding")))
    rows = written(v.select("vec_id", "ident", "key"), "vector-rows")
    classes = v.filter("key IS NOT NULL").groupBy("key").agg(F.min("ident").alias("id"), F.count("*").alias("many"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("dim", F.size("embedding")), "vector-classes")
    found = []
    for dim, n in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        plan = Plan(dim, n, least, recall)
        own = classes.filter(F.col("dim") == dim).select("id", "many", "embedding")
        own = written(mapped(own, _project(plan, dim), f"id long, many long, embedding {kind}, places binary, cells array<long>"), "vector-projected")
        cells = own.select("id", "places", F.posexplode("cells").alias("turn", "cell"))
        large = cells.groupBy("turn", "cell").agg(F.count("*").alias("rows")).filter(F.col("rows") > block)
        large = large.select("turn", "cell", F.ceil(F.col("rows") / block).cast("int").alias("split"), "rows")
        cells = joined(cells, written(large, "vector-large"), ["turn", "cell"], "left", rows="rows")
        split = F.coalesce("split", F.lit(1))
        cells = cells.withColumn("side", F.pmod(F.xxhash64("id", F.lit(3)), split).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), split - 1)))
        square = F.struct("turn", "cell", F.least("side", "other"), F.greatest("side", "other"))
        cells = cells.select("id", "places", "turn", "side", F.xxhash64(square).alias("group"), (F.least("side", "other") == F.greatest("side", "other")).cast("int").alias("square"))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(plan.orders) // 500_000))
        dealt = lambda df, parts=parts: df.repartition(parts, "group").sortWithinPartitions("group")
        met = written(mapped(dealt(cells), _candidates(plan), "id long, turn int, group long, side int, square int"), "vector-met")
        both = met.join(own, "id")  # an id meets once in each order and square at most
        found.append(written(mapped(dealt(both), _verify(plan, dim, least), "id long, links long, root long"), "vector-links"))
    every = spark.createDataFrame([], "id long, links long, root long")
    for part in found:
        every = every.union(part)
    links = every.groupBy("id").agg(F.sum("links").alias("links"))
    sets = connected_components(every.filter("id <> root"), "id", "root").select(F.col("node").alias("id"), "component")
    known = classes.select("key", "id", "many").join(links, "id", "left").join(sets, "id", "left")
    known = known.select("key", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = joined(rows, written(known, "vector-known"), "key", "left", rows="many")
    component = F.coalesce("component", "ident")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(component != LEAST_ID, component).alias("component_id"), F.col("ident").eqNullSafe(component).alias("kept"))
