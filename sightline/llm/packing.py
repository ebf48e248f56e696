"""Best-fit-decreasing packing of token sequences."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, parts, written

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are the ids of its
    space-separated chunks in turn. Chunks recur: those met are kept in a table of bounded size. Of a new one, the
    marks that end it after a letter or digit are encoded apart, as the tokenizer does; a stem of Latin letters is one word
    to the tokenizer and goes straight to its merges; any other goes through the whole tokenizer.
    """

    MARKS = ".,;:!?"

    def __init__(self, path: str, keep: int = 300_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.all = Tokenizer.from_file(path)
        self.merge, self.keep, self.longest, self.known = self.all.model.tokenize, keep, longest, {"": b""}
        # the byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.bytes = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}

    def fresh(self, stem: str) -> bytes:
        if stem.isalpha() and max(stem) < "\u0180" and stem == stem.lower():
            word = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.bytes)
            ids = [t.id for t in self.merge(word)]
        else:
            ids = self.all.encode(stem, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, chunk: str) -> bytes:
        """The ids of a chunk that isn't in the table; long ones are not kept."""
        known, keep = self.known, len(chunk) <= self.longest
        low = chunk.lower() if "<|" not in chunk and (chunk.isascii() or max(chunk) < "\u0130") else chunk
        stem = low.rstrip(self.MARKS)
        if len(stem) == len(low) or not stem[-1:].lower()[-1:].isalnum():
            stem, tail = low, ""
        else:
            tail = low[len(stem) :]
        if (ids := known.get(stem)) is None:
            ids = self.fresh(stem)
            if keep:
                known[stem] = ids
        if tail:
            if (end := known.get(tail)) is None:
                end = known[tail] = self.fresh(tail)
            ids += end
        if keep:
            known[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if len(self.known) > self.keep:
            self.known = {"": b""}
        known, learn = self.known, self.learn
        chunks = text.replace("\n", " ").split(" ")
        out = list(map(known.get, chunks))
        if None in out:
            out = [learn(c) if ids is None else ids for c, ids in zip(chunks, out, strict=True)]
        return b"".join(out)


def tokenized(docs: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of at most capacity tokens; each document ends with end_id. with_ids adds the ids themselves."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, wide = ChunkEncoder(path), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, a in enumerate(range(0, len(ids), wide)):
                    part = ids[a : a + wide]
                    out.append((ident, k, a // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(arrays[:n], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECE + (", ids binary" if with_ids else ""))


class CapacityTree:
    """A segment tree over remaining capacities 0..n: which of them some open bin has."""

    def __init__(self, n: int):
        self.width = 1 << n.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, at: int, by: int) -> None:
        node = self.width + at
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of need or more."""
        node = self.width + need
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of lengths; gives what placing one by one would give.

    Open bins with the same history stand side by side in runs (first, number), filed by remaining capacity.
    For each length, longest first, the tree finds the tightest open capacity r; a bin found stays the
    tightest until it can't hold another, so it takes r // length pieces at once. Work and result depend
    on the number of lengths, at most capacity, not on the number of pieces.
    Returns placements (length, rank_from, first_bin, pieces_per_bin, offset) and the number of bins.
    """
    tree, runs, placed, bins = CapacityTree(capacity), {}, [], 0

    def put(r: int, first: int, number: int) -> None:
        if number and r:
            runs.setdefault(r, []).append((first, number))
            tree.add(r, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                r, first, number = capacity, bins, -(-left // (capacity // length))
                bins += number
            else:
                first, number = runs[r].pop()
                tree.add(r, -1)
            each = r // length
            use = min(number, -(-left // each))
            put(r, first + use, number - use)
            take = min(left, use * each)
            full, rest = divmod(take, each)
            placed.append((length, rank, first, each, capacity - r))
            put(r - each * length, first, full)
            put(r - rest * length, first + full, 1 if rest else 0)
            rank, left = rank + take, left - take
    return placed, bins


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, pieces_per_bucket: int = 500_000) -> DataFrame:
    """Pack every document (doc_id, text) into sequences of at most capacity tokens by best-fit decreasing.

    A document is the ids of its whole text (null: empty) and a closing id 0; longer ones are cut into pieces of
    capacity tokens. Pieces are numbered as they are written and ranked within their length by (bucket, number), buckets being a hash of the number,
    so a length, a document or a repeated row that a third of all pieces share is ranked by many tasks. The driver sees only the number of
    pieces of each length, packs that histogram, and rank decides each piece's place.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed each for itself; null
    ids are kept; an empty table gives no rows; other columns are ignored.
    """
    pieces = tokenized(docs, path or tokenizer_path(), capacity).withColumn("row", F.monotonically_increasing_id())
    pieces = written(pieces, "pack-pieces")  # row numbers are fixed from here on
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = parts(sum(counts.values()), pieces_per_bucket, 64)
    placed, _ = best_fit_decreasing(counts, capacity)
    placed.sort()
    shift = 1 << 40  # ranks stay below it
    keys = np.array([p[0] * shift + p[1] for p in placed], dtype=np.int64)
    first, each, offset = (np.array([p[i] for p in placed], dtype=np.int64) for i in (2, 3, 4))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, k = (np.asarray(c).astype(np.int64) for c in (length, rank))
        at = np.searchsorted(keys, n * shift + k, "right") - 1
        own = k - (keys[at] - n * shift)
        return pa.StructArray.from_arrays([pa.array(first[at] + own // each[at]), pa.array(offset[at] + own % each[at] * n)], ["sequence_id", "offset"])

    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    held = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = pieces.withColumn("own", F.row_number().over(within)).join(held, ["length", "bucket"])
    return ranked.withColumn("at", place("length", F.col("before") + F.col("own") - 1)).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
