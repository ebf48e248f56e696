"""Reports of an evaluation: residuals, gates, sweeps, deliveries and ledgers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, key: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def flagged(shares: DataFrame, key: list[str], at: str, value: str, budget: float, most: int) -> DataFrame:
    """How many positions are over budget, and the first most of them, in order: the list is cut before it is gathered."""
    over = shares.filter(F.col(value) > budget)
    first = top_per(over, key, most, F.col(at)).groupBy(*key).agg(F.array_sort(F.collect_list(at)).alias("first"))
    counts = shares.groupBy(*key).agg(F.count_if(F.col(value) > budget).alias("over"))
    return counts.join(first, key, "left").withColumn("first", F.coalesce("first", F.array().cast("array<long>")))


def long_runs(runs: DataFrame, key: list[str], least: int, most: int) -> DataFrame:
    """Of half-open runs (first, end, hits) those of at least least positions, the first most per key; flagged counts the positions of all runs."""
    total = runs.groupBy(*key).agg(F.sum("hits").alias("flagged"))
    return top_per(runs.filter(F.col("hits") >= least), key, most, F.col("first")).join(total, key)


def with_total(df: DataFrame, by: str, aggregates: list[Column], name: str = "all") -> DataFrame:
    """Aggregates by a column, and over everything under name."""
    out = df.rollup(by).agg(F.grouping(by).alias("_all"), *aggregates)
    return out.withColumn(by, F.when(F.col("_all") == 1, F.lit(name)).otherwise(F.col(by))).drop("_all")


def ordered_checks(df: DataFrame, key: list[str], checks: dict[str, Column], last: str) -> DataFrame:
    """A row for each check; the one named last is skipped (ok is null) where another failed: key, check, ok, passed (all that ran are ok)."""
    fine = reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for n, c in checks.items() if n != last))
    rows = [F.struct(F.lit(n).alias("check"), (F.when(fine, c) if n == last else c).alias("ok")) for n, c in checks.items()]
    passed = fine & F.coalesce(checks[last], F.lit(False))
    return df.select(*key, F.explode(F.array(*rows)).alias("c"), passed.alias("passed")).select(*key, "c.check", "c.ok", "passed")


def by_size(pairs: DataFrame, edges: list[float], threshold: Column) -> DataFrame:
    """Per half-open bucket of the smaller side, all of them: genuine and impostor pairs (kind, score, smaller), the share of each that reaches threshold, the genuine median."""
    bounds = list(zip([0, *edges[:-1]], edges, strict=True))
    names = [f"{lo}-{hi}" if hi < 10**6 else f"{lo}+" for lo, hi in bounds]
    size = reduce(lambda a, x: a.when(F.col("smaller") < x[1], F.lit(x[0])), zip(names, edges, strict=True), F.when(F.lit(False), F.lit("")))
    rows = pairs.withColumn("size", size).withColumn("_hit", (F.col("score") >= threshold).cast("int"))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    found = rows.groupBy("size").agg(F.count(of("genuine", "score")).alias("genuine"), F.avg(of("genuine", "_hit")).alias("recognised"), F.median(of("genuine", "score")).alias("median_same"), F.count(of("impostor", "score")).alias("impostors"), F.avg(of("impostor", "_hit")).alias("false_match"))
    every = pairs.sparkSession.createDataFrame([(n,) for n in names], "size string")
    return every.join(F.broadcast(found), "size", "left").fillna(0, ["genuine", "impostors"])  # one row for each bucket


def leak_report(rows: DataFrame, by: str) -> DataFrame:
    """Verdicts (blind, unidentifiable, leak, covered) by a column and over all: counts, the rate of leaks over what can be decided, median and worst score and median
    floor of that."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    decided = lambda c: F.when(F.col("verdict").isin("leak", "covered"), F.col(c))
    names = ("blind", "unidentifiable", "leak", "covered")
    rate = n("leak") / F.nullif(n("leak") + n("covered"), F.lit(0))
    return with_total(rows, by, [F.count("*").alias("checked"), *(n(v).alias(v) for v in names), rate.alias("rate"), F.median(decided("score")).alias("median"), F.max(decided("score")).alias("worst"), F.median(decided("floor")).alias("median_floor")])


def combined(results: DataFrame, setting: str, file: str) -> DataFrame:
    """Settings measured on every file, over their files: whether all pass, sums of exposures, means of scores, the largest off-face share and hand damage
    (null as 0), best first in place."""
    files = results.select(F.count_distinct(file)).first()[0]
    rows = results.groupBy(setting).agg(
        F.count_distinct(file).alias("_files"), F.bool_and("passes").alias("passes_everywhere"), F.sum("exposed_40").alias("exposed_40"), F.sum("exposed_24").alias("exposed_24"),
        F.avg("score").alias("score"), F.max("off_face").alias("off_face"), F.coalesce(F.max("hand_damage"), F.lit(0.0)).alias("hand_worst"), F.avg("masked").alias("masked"),
    ).filter(F.col("_files") == files).drop("_files")
    order = [~F.col("passes_everywhere"), F.col("exposed_40"), F.col("exposed_24"), -F.round("score", 4), F.col("off_face"), F.col(setting)]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # one row for each setting


def chosen(results: DataFrame, gates: Column, order: list[Column], n: int = 1) -> DataFrame:
    """The first n results within the gates."""
    return results.filter(F.coalesce(gates, F.lit(True))).orderBy(*order).limit(n)


def complete_or_fail(results: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """results, if every wanted key has one; otherwise the query fails and names one that hasn't."""
    missing = wanted.join(results.select(on), on, "left_anti").agg(F.min(F.col(on).cast("string")).alias("_missing"))
    check = F.when(F.col("_missing").isNotNull(), F.raise_error(F.concat(F.lit(f"no result for {on} "), F.col("_missing"))).cast("boolean")).otherwise(F.lit(True))
    return results.join(F.broadcast(missing.filter(check)), F.lit(True), "inner").drop("_missing")  # one row


def random_access(seeks: DataFrame, ratio: float) -> DataFrame:
    """Per library how many seeks of either file are exact, their mean and median time, the converted file's mean over the source's, and
    whether all are exact and no library's ratio is above ratio."""
    of = lambda file, agg, c: agg(F.when(F.col("file") == file, F.col(c)))
    rows = seeks.withColumn("_exact", F.col("exact").cast("int")).groupBy("lib").agg(
        *(of(f, F.sum, "_exact").alias(f"{f}_exact") for f in ("converted", "source")), *(of(f, F.count, "_exact").alias(f"{f}_total") for f in ("converted", "source")),
        *(of(f, F.avg, "ms").alias(f"{f}_mean") for f in ("converted", "source")), *(of(f, F.median, "ms").alias(f"{f}_median") for f in ("converted", "source")),
    )
    rows = rows.withColumn("ratio", F.col("converted_mean") / F.nullif(F.col("source_mean"), F.lit(0)))
    fine = (F.col("converted_exact") == F.col("converted_total")) & (F.col("source_exact") == F.col("source_total")) & (F.col("ratio") <= ratio)
    return rows.withColumn("passed", F.bool_and(F.coalesce(fine, F.lit(False))).over(Window.partitionBy()))  # one row for each library


def seek_offsets(seeks: DataFrame, frames: DataFrame) -> DataFrame:
    """For seeks (file, wanted, sha) that gave another frame: how far that frame's first place (frames: file, frame, sha) is from the wanted one, null if it is none."""
    first = frames.groupBy("file", "sha").agg(F.min("frame").alias("first"))
    right = frames.select("file", F.col("frame").alias("wanted"), F.col("sha").alias("_right"))
    wrong = seeks.join(right, ["file", "wanted"]).filter(~F.col("sha").eqNullSafe(F.col("_right")))
    return wrong.join(first, ["file", "sha"], "left").select("file", "wanted", (F.col("first") - F.col("wanted")).alias("offset"))


def merged_checks(first: DataFrame, again: DataFrame, ranges: DataFrame, key: list[str], stride: int) -> DataFrame:
    """Totals of a check of a whole file and one of its changed ranges: positions in a range [start, end) count as the second check says, others as
    the first. Rows: key, frame, flat, hands, in_zone; returns sums and how many positions were checked."""
    from .intervals import interval_blocks

    blocks = interval_blocks(ranges.select(*key, "start", "end").filter("start < end"), "start", "end", 64)
    at = first.withColumn("_block", F.floor(F.col("frame") / 64)).alias("o")
    hit = [F.col(f"o.{c}") == F.col(f"r.{c}") for c in [*key, "_block"]] + [F.col("o.frame") >= F.col("r.start"), F.col("o.frame") < F.col("r.end")]
    kept = at.join(blocks.alias("r"), hit, "left_anti").drop("_block").filter(F.col("frame") % stride == 0)
    rows = kept.unionByName(again)
    return rows.groupBy(*key).agg(F.count_distinct("frame").alias("checked"), F.sum("flat").alias("flat"), F.count("hands").alias("hands"), F.count("in_zone").alias("in_zone"), F.count_if(F.col("hands").isNull() & F.col("in_zone").isNull()).alias("left"))


def second_chance(strong: DataFrame, seeds, retrack, check, changed, rounds: int) -> DataFrame:
    """The masks after up to rounds of second chances: seeds(found) of the check are added to the strong boxes, tracks drawn anew by retrack(strong), and only where
    changed(before, after) has rows are they checked again. Ends when there is no seed or nothing changes.

    Each round's masks and finds are checkpointed, so lineage doesn't grow with the rounds and a lost executor costs a task.
    """
    keep = lambda df: df.checkpoint()
    masks = keep(retrack(strong))
    found = keep(check(masks, None))
    for _ in range(rounds):
        more = keep(seeds(found))
        if more.isEmpty():
            break
        strong = keep(strong.unionByName(more))
        after = keep(retrack(strong))
        where = keep(changed(masks, after))
        masks = after
        if where.isEmpty():
            break
        found = keep(check(masks, where))
    return masks


def delivery_leaks(delivered: DataFrame, expected: DataFrame, uploaded: DataFrame, empty: int) -> DataFrame:
    """Delivered files (path, size) that aren't the copy they should be: of another size than expected, or of the size that was uploaded; stubs below empty aside."""
    rows = delivered.filter(F.col("size") >= empty).join(expected.select("path", F.col("size").alias("_want")), "path", "left").join(uploaded.select("path", F.col("size").alias("_raw")), "path", "left")
    raw = ~F.col("size").eqNullSafe(F.col("_want")) | F.coalesce(F.col("size") == F.col("_raw"), F.lit(False))
    return rows.filter(raw).select("path", "size", F.when(F.coalesce(F.col("size") == F.col("_raw"), F.lit(False)), "raw").when(F.col("_want").isNull(), "unknown").otherwise("size").alias("why"))


def ledger_pass(videos: DataFrame, done: DataFrame, empty: int) -> DataFrame:
    """What a pass does with each video (path, size), given finished ledger rows (path, delivered): stub, done (in the ledger at this size) or todo."""
    rows = videos.join(done.select("path", "delivered"), "path", "left")
    return rows.select("path", "size", F.when(F.col("size") < empty, "stub").when(F.col("size") == F.col("delivered"), "done").otherwise("todo").alias("action"))


def publish_plan(rows: DataFrame, delivered: DataFrame, staged: DataFrame) -> DataFrame:
    """What becomes of each finished row (path, status, delivered, bytes): mismatched if the delivered object isn't the copy it was made from, already, publish if
    the staged object is what was written, else mismatched."""
    j = rows.join(delivered.select("path", F.col("size").alias("_now")), "path", "left").join(staged.select("path", F.col("size").alias("_staged")), "path", "left")
    action = F.when(~F.col("_now").eqNullSafe(F.col("delivered")), "mismatched").when(F.col("status") == "already", "already").when(F.col("_staged").eqNullSafe(F.col("bytes")), "publish").otherwise("mismatched")
    return j.select("path", action.alias("action"))


def finished(videos: DataFrame, outputs: DataFrame, suffix: str) -> DataFrame:
    """videos (path) with done: delivered with its record, or held back in a quarantine folder with its record; the copy alone doesn't count."""
    folder, name = F.regexp_extract("path", "^(.*/)?([^/]*)$", 1), F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    ending = F.regexp_extract("path", r"(\.[^./]*)?$", 1)
    copies = [F.concat(folder, F.lit(q), name, F.lit(suffix), ending) for q in ("", "quarantine/")]
    rows = videos.withColumn("_c", F.explode(F.array(*copies)))
    have = outputs.select(F.col("path").alias("_p"))
    both = rows.join(have, rows["_c"] == have["_p"], "left_semi")
    both = both.join(have, F.concat(both["_c"], F.lit(".json")) == have["_p"], "left_semi").select("path").distinct().withColumn("done", F.lit(True))
    return videos.join(both, "path", "left").withColumn("done", F.coalesce("done", F.lit(False)))


def conversion_rows(files: DataFrame) -> DataFrame:
    """Manifest rows of conversions (path, sha, size, new_sha, new_size, passed, apply): applied, dry-run or failed; a failed one keeps its hash."""
    status = F.when(~F.col("passed"), "failed").when(F.col("apply"), "applied").otherwise("dry-run")
    return files.select("path", F.col("sha").alias("sha256_before"), F.when(F.col("passed"), F.col("new_sha")).otherwise(F.col("sha")).alias("sha256_after"), F.col("size").alias("size_before"), F.col("new_size").alias("size_after"), status.alias("status"))


def category(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first pattern that a text matches, else other."""
    return reduce(lambda a, r: a.when(text.rlike(r[0]), F.lit(r[1])), rules, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(other))


def covered_picture(boxes: DataFrame, key: list[str], width: float, height: float) -> DataFrame:
    """The share of a picture that the boxes of each key cover together; boxes with a missing number cover nothing."""
    from ..functions.areas import covered
    from ..functions.geometry import dealt

    rows = boxes.select(*key, *(F.col(c).cast("double").alias(c) for c in "xywh"))

    def kernel(frame: pa.Table) -> pa.Table:
        at = np.stack([frame.column(c).to_numpy().astype(float) for c in "xywh"], axis=1)
        share = covered(at[~np.isnan(at).any(1)], np.array([[0.0, 0.0, width, height]])) / (width * height)
        return frame.select(key).slice(0, 1).append_column("share", pa.array(share))

    return dealt(rows, *key).groupBy(*key).applyInArrow(kernel, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key) + ", share double")
