"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, joined, parts, running, written

MOST_EPOCHS = 3
SEED = "mix-1"


def n_words(text):
    """Number of runs of non-space characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS, rows_per_part: int = 1_000_000) -> DataFrame:
    """target for each row of (source, source_size): weights by code-point order of sources, null last.

    Sharing again whatever sources can't take ends where every source has min(most * size, weight * level) for
    one common level. Sources sorted by size per weight fill up in that order, so the level follows from prefix
    sums. Works on one row per source; ranges of either order are numbered and summed apart, so sources may be as many as hosts.
    """
    t = running(totals, [F.col("source").asc_nulls_last()], {}, rows_per_part)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * most)
    t = running(t.withColumnRenamed("place", "nth").withColumn("fill", F.col("source_size") / F.col("weight")), [F.col("fill"), F.col("weight"), F.col("nth")], {"full": F.col("cap"), "weighed": F.col("weight")}, rows_per_part)
    size, weight = t.agg(F.sum("source_size"), F.sum("weight")).first()
    t = t.withColumn("level", (F.lit(size) - F.col("full")) / (F.lit(weight) - F.col("weighed")))
    # full sources lead in this order; the first that isn't full fixes the level
    level = t.agg(F.min_by("level", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("place")))).first()[0]
    cap = F.col("cap").cast("double")
    return t.select("source", "source_size", F.least(cap, F.coalesce(F.col("weight") * F.lit(level), cap)).alias("target"))


def _key(seed: str):
    """The hash-random key of a document: 32 hex digits, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mixing_plan(docs: DataFrame, rows_per_bucket: int = 200_000, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): doc_id, source, size and key of every document, and for each source where the mix cuts it.

    A source takes its budget, the whole part of its target: whole epochs of all its documents, then the documents whose
    keys come before cut_key, then rest words of the cut_words that carry cut_key itself. Keys are range-partitioned
    into buckets within each source and summed; prefix sums over the buckets find the one that the budget ends in, and
    only that bucket's rows are sorted. So a source with a third of all rows is the work of many tasks.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _key(seed).alias("key")), "mix-rows")
    buckets = parts(rows.count(), rows_per_bucket, 64)
    # the first seven hex digits, a number below 2^28, choose the bucket, so buckets follow the order of the keys
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)).cast("int"))
    sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.count("*").alias("documents")), "mix-sums")
    totals = sums.groupBy("source").agg(F.sum("held").alias("source_size"), F.sum("documents").alias("documents"))
    plan = source_targets(totals.drop("documents")).alias("t").join(totals.drop("source_size").alias("n"), F.expr("t.source <=> n.source"))
    plan = plan.select(F.col("t.source").alias("of"), "documents", "source_size", "target", F.floor("target").cast("long").alias("budget"))
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1))).cast("long"))
    plan = written(plan.withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size")), "mix-plan")

    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    ends = sums.join(plan, sums["source"].eqNullSafe(plan["of"])).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("held")))
    ends = ends.select("of", F.col("bucket").alias("at"), "before", "left")
    inside = rows.join(ends, rows["source"].eqNullSafe(ends["of"]) & (rows["bucket"] == ends["at"]))
    inside = inside.groupBy("of", "key").agg(F.sum("size").alias("cut_words"), F.first("before").alias("before"), F.first("left").alias("left"))
    within = Window.partitionBy("of").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("cut_words").over(within), F.lit(0)))
    inside = inside.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("cut_words")))
    cuts = inside.select(F.col("of").alias("cut_of"), F.col("key").alias("cut_key"), "cut_words", (F.col("left") - F.col("before")).alias("rest"))
    plan = plan.join(cuts, plan["of"].eqNullSafe(cuts["cut_of"]), "left").drop("cut_of", "left")
    return rows.drop("bucket"), written(plan, "mix-cuts")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows and what the plan says of their source; null is a source too."""
    named = lambda df, c: df.withColumn("_of", F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("null")))
    return joined(named(rows, "source"), named(plan, "of").drop("of"), "_of", rows="documents").drop("_of", "documents")


def mix_sources(docs: DataFrame, rows_per_bucket: int = 200_000) -> DataFrame:
    """Words that the mix takes of every document (doc_id, source, text).

    Returns doc_id, size, source_size, target, taken. Every source takes the whole part of its target exactly. Null text has
    size 0 and nothing taken; null is a source of its own, the last; rows with the same doc_id carry the same key and, where
    the cut meets them, share what is left in proportion, rounded down; an empty table gives no rows; other columns are ignored.
    """
    mixed = _with_plan(*mixing_plan(docs, rows_per_bucket))
    part = F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), F.lit(0))
    part = part.when(F.col("key") < F.col("cut_key"), F.col("size")).otherwise(F.floor(F.col("rest") * F.col("size") / F.greatest(F.col("cut_words"), F.lit(1))))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus in the columns of docs: each document as many times as the mix takes it whole.

    A document that the cut takes in part counts once more if at least half of its words are taken. Documents without words (null, empty,
    white space) weigh nothing in a mix and stay once; null is a source of its own, the last; rows with the same doc_id come or go together;
    an empty table stays empty; docs' own columns come out, whatever their names. The texts themselves are not shuffled.
    """
    _, plan = mixing_plan(docs)
    plan = plan.select("of", "documents", "epochs", "cut_key", (2 * F.col("rest") >= F.col("cut_words")).alias("half"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.col("source").cast("string").alias("source"), _key(SEED).alias("key"), F.col("text").rlike(WORD).alias("wordy"), F.struct(*columns).alias("row"))
    once_more = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & F.col("half"))
    times = F.when(~F.coalesce("wordy", F.lit(False)), F.lit(1)).otherwise(F.col("epochs") + F.coalesce(once_more, F.lit(False)).cast("long"))
    copies = _with_plan(held, plan).withColumn("times", times.cast("int")).filter("times > 0")
    return copies.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def oracle() -> str:
    """mix_sources() in DuckDB, for distinct ids."""
    return rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('{SEED}:' || doc_id) AS key FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM d GROUP BY source),
    w AS (SELECT *, ((place - 1) % 3 + 1)::BIGINT AS weight, (3 * source_size)::BIGINT AS cap FROM s),
    f AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE) AS level, row_number() OVER (ORDER BY source_size::DOUBLE / weight, weight, place) AS turn FROM w
      WINDOW o AS (ORDER BY source_size::DOUBLE / weight, weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT arg_min(level, turn) FILTER (cap > level * weight) AS level FROM f),
    t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * l.level, cap::DOUBLE)) AS target FROM w, l),
    b AS (SELECT *, floor(target)::BIGINT AS budget, floor(target)::BIGINT // greatest(source_size, 1) AS epochs FROM t),
    p AS (SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p"""
