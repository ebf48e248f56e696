"""Substring deduplication by winnowed seeds and extension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, WORD, dropped, joined, mapped, one_each, written
from .hashing import TextHasher, pieces, run_hashes, signed

WINDOW = 35  # words of a repeat
SEED = 20  # words of an anchor


STEP = 1 << 20  # windows that are looked at together


def anchors_of(hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every seed-word run, anchor of every window): in each window the smallest run hash, the first one on ties.

    Equal windows have their anchor in the same place, so a repeated window has a repeated anchor.
    """
    runs = run_hashes(hashes, seed)
    if len(hashes) < window:
        return runs, np.empty(0, dtype=np.int64)
    inside = sliding_window_view(runs, window - seed + 1)
    return runs, np.concatenate([inside[a : a + STEP].argmin(axis=1) + np.arange(a, min(a + STEP, len(inside))) for a in range(0, len(inside), STEP)])


def kept_digest(raw: bytes, gone: np.ndarray | None = None) -> str:
    """SHA-256 of a text's words (at the six white-space characters) that aren't gone, joined by one space; piece by piece."""
    out, at, begun = hashlib.sha256(), 0, False
    for piece in pieces(raw):
        words = piece.split()
        if gone is not None:
            at += len(words)
            words = [w for w, g in zip(words, gone[at - len(words) : at].tolist(), strict=True) if not g]
        if words:
            out.update(b" " * begun + b" ".join(words))
            begun = True
    return out.hexdigest()


def raw(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _scan(window: int, seed: int):
    """Per document a row with its word count and digest, and a row for each distinct anchor (again: it recurs in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TextHasher()
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, found, again, owner = [], [], [], []
            for first, hashes, n in hasher(batch.column(2)):
                ends = np.concatenate([[0], n.cumsum()]).tolist()
                for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False), first):
                    rows.append((b - a, kept_digest(raw(batch.column(2)[i]))))
                    runs, at = anchors_of(hashes[a:b], window, seed)
                    if len(at):
                        hit, many = np.unique(runs[np.unique(at)], return_counts=True)
                        found.append(signed(hit))
                        again.append(many > 1)
                        owner.append(np.full(len(hit), keys[i], dtype=np.int64))
            n, m = len(rows), sum(map(len, found))
            none = lambda k, t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(ids, pa.int64()), none(m, pa.int64())]),
                    pa.concat_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(owner) if m else [], pa.int64())]),
                    pa.concat_arrays([pa.array([r[0] for r in rows], pa.int64()), none(m, pa.int64())]),
                    pa.concat_arrays([pa.array([r[1] for r in rows], pa.string()), none(m, pa.string())]),
                    pa.concat_arrays([none(n, pa.int64()), pa.array(np.concatenate(found) if m else [], pa.int64())]),
                    pa.concat_arrays([none(n, pa.bool_()), pa.array(np.concatenate(again) if m else [], pa.bool_())]),
                ],
                ["doc_id", "key", "n_words", "digest", "anchor", "again"],
            )

    return run


def _extend(window: int, seed: int):
    """Extends each repeated anchor both ways: a row for every window that it is the anchor of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TextHasher()
        for batch in batches:
            for first, hashes, n in hasher(batch.column("text")):
                ends = np.concatenate([[0], n.cumsum()]).tolist()
                for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False), first):
                    runs, at = anchors_of(hashes[a:b], window, seed)
                    seeds = np.asarray(batch.column("anchors")[i].values, dtype=np.int64)
                    start = np.flatnonzero(np.isin(signed(runs)[at], seeds))
                    whole = signed(run_hashes(hashes[a:b], window))[start]
                    key = np.full(len(start), batch.column("key")[i].as_py(), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(start.astype(np.int32)), pa.array(signed(runs)[at][start]), pa.array(whole)], ["key", "start", "anchor", "whole"])

    return run


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of starts: overlapping windows grow together into maximal repeats."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return step.cumsum()[:n_words] > 0


def _cut(window: int):
    """Removed words, the digest of the others, and the spans [from, to) of removed words, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, n, starts in zip(*(batch.column(c) for c in ("key", "text", "n_words", "starts")), strict=True):
                gone = covered(np.asarray(starts.values, dtype=np.int64), n.as_py(), window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                out.append((key.as_py(), int(gone.sum()), kept_digest(raw(text), gone), edges.tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())), strict=True)], ["key", "gone", "left_digest", "spans"])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, starts) of docs (doc_id, text): what every row is by itself; one text for each key that has a
    candidate; and for each such key the starts of its windows that occur elsewhere too.

    A key stands for all rows with the same text (a 64-bit hash of it), which drop out as one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    scanned = written(mapped(keyed, _scan(window, seed), "doc_id long, key long, n_words long, digest string, anchor long, again boolean"), "repeat-scan")
    rows = written(scanned.filter("anchor IS NULL").select("doc_id", "key", "n_words", "digest"), "repeat-rows")
    anchors = scanned.filter("anchor IS NOT NULL").select("anchor", "key", "again")
    shared = anchors.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("again").alias("again"), F.count("*").alias("texts")).filter("a <> b OR again").select("anchor", "texts")
    shared = written(shared, "repeat-shared")
    seeds = written(joined(anchors.select("anchor", "key"), shared, "anchor", rows="texts", sent=FEW).groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "repeat-seeds")
    dropped(scanned)
    dropped(shared)
    # one row for each key: the smallest id; equal rows of one id give the same text again, which is dropped
    first = rows.groupBy("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("ident")).agg(F.count("*").alias("rows"), F.max("n_words").alias("n_words"))
    first = first.groupBy("key").agg(F.min("ident").alias("at"), F.min_by("rows", "ident").alias("twins"), F.sum("rows").alias("many"), F.max("n_words").alias("n_words"))
    marked = written(seeds.select("key").join(first, "key"), "repeat-marked")
    one = one_each(docs.select(F.xxhash64(text).alias("key"), ident.alias("ident"), text.alias("text")), marked, "inner").select("key", "text", "n_words")
    texts = written(one.join(seeds, "key"), "repeat-texts")  # only texts with a candidate are shuffled
    dropped(marked)
    dropped(seeds)
    spread = written(mapped(texts, _extend(window, seed), "key long, start int, anchor long, whole long"), "repeat-windows")
    twice = spread.groupBy("anchor", "whole").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("start").alias("c"), F.max("start").alias("d"), F.count("*").alias("places")).filter("a <> b OR c <> d")
    twice = written(twice.select("anchor", "whole", "places"), "repeat-twice")
    starts = written(joined(spread, twice, ["anchor", "whole"], rows="places", sent=FEW).groupBy("key").agg(F.collect_set("start").alias("starts")), "repeat-starts")
    dropped(spread)
    dropped(twice)
    return rows, texts.select("key", "text", "n_words"), starts


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_spans: bool = False) -> DataFrame:
    """Remove from every whole text of docs (doc_id, text) each word in a window of words that starts anywhere else too.

    Seeds are winnowed 20-word runs, about one in eight words. Seeds that two texts share, or that recur in one, are
    extended both ways to the 35-word windows they are the anchor of; windows with the same seed and the same
    hash recur, and their union is the maximal repeats. Groups are compared by the smallest and largest member of a class, never
    pair by pair. Rows with equal texts of 35 words or more lose everything, since each window starts in the other too.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with with_spans, key (a hash of the text) and
    spans (from, to, from, ... in words; null: nothing was removed). Null and empty texts have no words; repeated rows are copies of each other; an empty table
    gives no rows; other columns are ignored; long texts are hashed piece by piece, whole. Texts are read twice; only those with a shared seed are written in between.
    """
    rows, texts, starts = repeated_windows(docs, window, seed)
    cut = mapped(texts.join(starts, "key"), _cut(window), "key long, gone long, left_digest string, spans array<int>")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    parts = written(copies.join(cut, "key", "left").filter("copies > 1 OR gone IS NOT NULL"), "repeat-cut")
    every = (F.col("copies") > 1) & (F.col("n_words") >= window)
    out = joined(rows, parts if with_spans else parts.drop("spans"), "key", "left", rows="copies", sent=FEW)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_words", F.when(every, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(every, F.lit(none)).otherwise(F.coalesce("left_digest", "digest")).alias("kept_sha256"),
        *(["key", F.when(every, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.col("spans")).alias("spans")] if with_spans else []),
    )


def documents_without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs with repeats cut out of their texts: the kept words joined by one space, n_chars set anew where there is such a column.

    Texts without a repeat stay as they are, null and empty ones too. A document that loses all its words goes, as all copies of a text of
    35 words or more do. Repeated rows stay as often as they are there if their text keeps a word; an empty table stays empty; docs' own columns
    come out, whatever their names.
    """
    found = remove_repeats(docs, window, seed, with_spans=True).filter("n_removed > 0")
    spans = written(found.groupBy("key").agg(F.first("spans").alias("spans"), F.first(F.col("n_removed") == F.col("n_words")).alias("all_gone"), F.count("*").alias("copies")), "repeat-spans")

    columns = docs.columns
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    # first only whether a text changes, then the spans of those that do
    marks = written(spans.select("key", "all_gone", "copies"), "repeat-marks")
    own = joined(own, marks, "key", "left", rows="copies", sift=True).drop("copies").filter("all_gone IS NULL OR NOT all_gone")
    cut = joined(own.filter("NOT all_gone").drop("all_gone"), spans.filter("NOT all_gone").drop("all_gone"), "key", rows="copies", sift=True)
    # the words between spans, joined; a one-element array binds the words to a name that is used again
    gaps = "transform(sequence(0, size(spans) div 2), i -> slice(w, IF(i = 0, 0, spans[2 * i - 1]) + 1, IF(2 * i = size(spans), size(w), spans[2 * i]) - IF(i = 0, 0, spans[2 * i - 1])))"
    cut = cut.withColumn("words", F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)))
    cut = cut.withColumn("kept", F.expr(f"array_join(element_at(transform(array(words), w -> flatten({gaps})), 1), ' ')"))
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in columns else {})
    whole = own.filter("all_gone IS NULL").select(*(F.col("row").getField(c).alias(c) for c in columns))
    return whole.unionByName(cut.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns)))


def oracle(window: int = WINDOW) -> str:
    """The same rows in DuckDB, from every window, for distinct ids."""
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    g AS (SELECT doc_id, i, array_to_string(words[i:i + {window - 1}], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - {window - 2}, 1))) AS i)),
    twice AS (SELECT md5(g) AS g FROM g GROUP BY md5(g) HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM g SEMI JOIN twice ON md5(g.g) = twice.g, range({window}) r(k)),
    word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
