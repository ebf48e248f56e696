"""Joins of boxes within a frame: confirmation, consensus, coverage, matching, next sightings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, centre, centre_in, iou, long_side, overlap, renamed

FRAME = ["clip_id", "frame"]


def _theta(left: DataFrame, right: DataFrame, how: str, test: Column) -> DataFrame:
    """left joined with right of the same frame where test holds on columns a_* (left) and b_* (right)."""
    a, b = renamed(left, "a_"), renamed(right, "b_")
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in FRAME]
    return a.join(b, [*same, test], how)


def _left(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).alias(c[2:]) for c in df.columns if c.startswith("a_")))


def best_confirmation(boxes: DataFrame, confirmers: DataFrame, least: float, row: str = "event_id") -> DataFrame:
    """Each box with the best score of a confirmer that overlaps it by least or more; null if none does."""
    joined = _theta(boxes, confirmers.select(*FRAME, "x", "y", "w", "h", "score"), "left", iou("a_", "b_") >= least)
    return joined.groupBy(F.col(f"a_{row}").alias(row)).agg(F.max("b_score").alias("best"), F.count("b_score").alias("support"))


def consensus(first: DataFrame, second: DataFrame, third: DataFrame, least: float) -> DataFrame:
    """Boxes of the first source that the second or third overlaps, with 1 + the number of sources that do; and those of the second
    that no first box overlaps but a third one does, with 2."""
    test = iou("a_", "b_") >= least
    pick = lambda df: df.select(*FRAME, "event_id", "x", "y", "w", "h")
    by = [_left(_theta(pick(first), pick(other), "left_semi", test)).select("event_id", F.lit(1).alias("n")) for other in (second, third)]
    votes = by[0].unionByName(by[1]).groupBy("event_id").agg((F.sum("n") + 1).alias("support"))
    own = pick(first).join(votes, "event_id").select("event_id", "support")
    alone = _left(_theta(pick(second), pick(first), "left_anti", test))
    alone = _left(_theta(alone, pick(third), "left_semi", test))
    return own.unionByName(alone.select("event_id", F.lit(2).cast("long").alias("support")))


def uncovered(regions: DataFrame, cover: DataFrame, least: float) -> DataFrame:
    """Regions that no cover box of the frame overlaps by least and none has the centre of."""
    return _left(_theta(regions, cover, "left_anti", (iou("a_", "b_") >= least) | centre_in("b_", "a_")))


def flagged_frames(strong: DataFrame, masks: DataFrame, least: float) -> DataFrame:
    """Frames with a strong box that no mask overlaps, and how many such boxes they have."""
    return _left(_theta(strong, masks, "left_anti", iou("a_", "b_") >= least)).groupBy(*FRAME).agg(F.count("*").alias("open_boxes"))


def match_report(truth: DataFrame, found: DataFrame, floors: DataFrame, least: float) -> DataFrame:
    """Per score floor: truth boxes hit and missed, found boxes matched and unmatched, recall and precision.

    The best score that hits a truth box is joined once; every floor is then a comparison, not a join.
    """
    test = iou("a_", "b_") >= least
    hits = _theta(truth, found, "left", test).groupBy("a_event_id").agg(F.max("b_score").alias("best"))
    matched = _theta(found, truth, "left", test).groupBy("a_event_id").agg(F.max("a_score").alias("score"), F.count("b_event_id").alias("n"))
    few = F.broadcast(floors)
    recall = hits.crossJoin(few).groupBy("floor").agg(F.count_if(F.col("best") >= F.col("floor")).alias("hit"), F.count("*").alias("truth"))
    precise = matched.crossJoin(few).filter(F.col("score") >= F.col("floor")).groupBy("floor").agg(F.count_if(F.col("n") > 0).alias("matched"), F.count("*").alias("found"))
    out = floors.join(recall, "floor", "left").join(precise, "floor", "left").fillna(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("floor", "hit", (F.col("truth") - F.col("hit")).alias("missed"), "matched", (F.col("found") - F.col("matched")).alias("unmatched"), share("hit", "truth").alias("recall"), share("matched", "found").alias("precision"))


def next_sightings(boxes: DataFrame, within: int, reach: float, likeness: float) -> DataFrame:
    """For each box the next box of its track within so many frames, of like size and near: event_id, next_id, gap."""
    a, b = renamed(boxes, "a_"), renamed(boxes, "b_")
    block = lambda c: F.floor(F.col(c) / within)
    a = a.withColumn("block", F.explode(F.array(block("a_frame"), block("a_frame") + 1)))
    b = b.withColumn("b_block", block("b_frame"))
    (ax, ay), (bx, by) = centre("a_"), centre("b_")
    big = F.greatest(long_side("a_"), long_side("b_"))
    test = (F.col("a_track_id") == F.col("b_track_id")) & (F.col("block") == F.col("b_block")) & (F.col("b_frame") > F.col("a_frame")) & (F.col("b_frame") - F.col("a_frame") <= within)
    near = (F.hypot(ax - bx, ay - by) <= reach * big) & (F.least(long_side("a_"), long_side("b_")) >= likeness * big)
    pairs = a.join(b, test & near)
    nxt = pairs.groupBy(F.col("a_event_id").alias("event_id"), "a_frame").agg(F.min(F.struct(F.col("b_frame").alias("frame"), F.col("b_event_id").alias("id"))).alias("n"))
    return nxt.select("event_id", F.col("n.id").alias("next_id"), (F.col("n.frame") - F.col("a_frame")).alias("gap"))


def surface_of(boxes: DataFrame, surfaces: DataFrame, floor: float) -> DataFrame:
    """The label of the surface that covers most of each box, if its share reaches floor; else none."""
    share = overlap("a_", "b_") / area("a_")
    joined = _theta(boxes, surfaces, "left", share >= floor).withColumn("share", F.when(F.col("b_event_id").isNotNull(), share))
    best = joined.groupBy(F.col("a_event_id").alias("event_id")).agg(F.max(F.struct("share", F.col("b_label").alias("label"), F.col("b_event_id").alias("id"))).alias("m"))
    return best.select("event_id", F.coalesce("m.label", F.lit("none")).alias("label"), F.coalesce("m.share", F.lit(0.0)).alias("share"))


def tiles(frames: DataFrame, width: int, height: int, side: int, step: int, top: int = 0) -> DataFrame:
    """Square windows over frames of one size, the last of a row or column pulled back to the edge; rows above top skipped."""

    def starts(length: int) -> Column:
        last = max(0, length - side)
        return F.array(*map(F.lit, sorted({min(s, last) for s in range(0, last + step, step)})))

    out = frames.withColumn("y", F.explode(starts(height))).withColumn("x", F.explode(starts(width)))
    return out.filter(F.col("y") + side > top).withColumns({"w": F.lit(side), "h": F.lit(side)})


def confirmation(boxes: DataFrame, main: DataFrame, mirror: DataFrame, extra: list[DataFrame], third: DataFrame, least: float, unsure: tuple[float, float], mirror_agrees: float, sure: float, third_score: float, row: str = "event_id") -> DataFrame:
    """Each box with what other views say of it: confidence, the best overlapping score of the main view, 0 where that is unsure and the mirror view doesn't
    agree, or of an extra view that is sure; and whether a third source overlaps it. One join for all views, one aggregation."""
    pick = lambda df, name: df.select(*FRAME, "x", "y", "w", "h", "score", F.lit(name).alias("view"))
    views = pick(main, "main").unionByName(pick(mirror, "mirror")).unionByName(pick(third, "third"))
    for k, df in enumerate(extra):
        views = views.unionByName(pick(df, f"extra{k}"))
    joined = _theta(boxes.select(*FRAME, row, "x", "y", "w", "h"), views, "left", iou("a_", "b_") >= least)
    best = lambda name: F.coalesce(F.max(F.when(F.col("b_view") == name, F.col("b_score"))), F.lit(0.0))
    names = ["main", "mirror", "third", *(f"extra{k}" for k in range(len(extra)))]
    out = joined.groupBy(F.col(f"a_{row}").alias(row)).agg(*(best(n).alias(n) for n in names))
    doubtful = (F.col("main") >= unsure[0]) & (F.col("main") < unsure[1]) & (F.col("mirror") < mirror_agrees)
    clear = [F.when(F.col(f"extra{k}") >= sure, F.col(f"extra{k}")).otherwise(0.0) for k in range(len(extra))]
    confidence = F.greatest(F.when(doubtful, 0.0).otherwise(F.col("main")), F.lit(0.0), *clear)
    return out.select(row, confidence.alias("confidence"), (F.col("third") >= third_score).alias("third")).join(boxes, row)


def spread(boxes: DataFrame, window: int, grow: float) -> DataFrame:
    """Each box on the frames up to window before and after it too, larger about its centre by grow a step: step tells how far."""
    out = boxes.withColumn("step", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("_g", 1 + grow * F.abs("step"))
    return out.withColumns({"frame": F.col("frame") + F.col("step"), "x": F.col("x") - F.col("w") * (F.col("_g") - 1) / 2, "y": F.col("y") - F.col("h") * (F.col("_g") - 1) / 2, "w": F.col("w") * F.col("_g"), "h": F.col("h") * F.col("_g")}).drop("_g")


def dilated(boxes: DataFrame, by: float) -> DataFrame:
    """Boxes grown on each side by a share of their size."""
    return boxes.withColumns({"x": F.col("x") - by * F.col("w"), "y": F.col("y") - by * F.col("h"), "w": F.col("w") * (1 + 2 * by), "h": F.col("h") * (1 + 2 * by)})


def oracle_boxes(rows: DataFrame, labels: list[str], floor: float, least_area: float, most: float, key: list[str], row: str) -> DataFrame:
    """Boxes of another detector (label, score, box as x0, y0, x1, y1) of some labels, a score and an area, as x, y, w, h, suppressed."""
    from .suppression import suppress

    at = lambda k: F.col("box")[k]
    kept = rows.filter(F.col("label").isin(labels) & (F.col("score") >= floor)).withColumns({"x": at(0), "y": at(1), "w": F.greatest(F.lit(0.0), at(2) - at(0)), "h": F.greatest(F.lit(0.0), at(3) - at(1))})
    return suppress(kept.filter(F.col("w") * F.col("h") >= least_area), key, row, most, last_first=True)


def sightings(boxes: DataFrame, drawn: str, marks: str, least_px: float) -> DataFrame:
    """Boxes that a detector saw (not of the source drawn), with landmarks, of a size."""
    return boxes.filter((F.col("source") != drawn) & F.col(marks).isNotNull() & (long_side() >= least_px))


def with_zone(boxes: DataFrame, zones: DataFrame, least: float, row: str = "event_id") -> DataFrame:
    """boxes with zone: whether a zone of the frame covers a share of least or more of the box."""
    inside = _left(_theta(boxes.select(*FRAME, row, "x", "y", "w", "h"), zones, "left_semi", overlap("a_", "b_") / area("a_") >= least)).select(row, F.lit(True).alias("zone"))
    return boxes.join(inside, row, "left").withColumn("zone", F.coalesce("zone", F.lit(False)))


def zoned_match_report(truth: DataFrame, found: DataFrame, floors: list[float], least: float) -> DataFrame:
    """Per floor of the truth's score: truth boxes recalled, set aside (not recalled, in a zone) and missed; found boxes in a zone, else matched
    or unmatched; recall and precision of what no zone sets aside. Both sides carry zone. Joined once; floors are comparisons."""
    test = iou("a_", "b_") >= least
    hits = _theta(truth, found, "left", test).groupBy("a_event_id").agg(F.first("a_zone").alias("zone"), F.first("a_score").alias("score"), (F.count("b_event_id") > 0).alias("hit"))
    best = _theta(found, truth, "left", test).groupBy("a_event_id").agg(F.first("a_zone").alias("zone"), F.max("b_score").alias("best"))
    steps = F.array(*map(F.lit, floors))
    t = hits.withColumn("floor", F.explode(F.filter(steps, lambda f: F.col("score") >= f))).groupBy("floor").agg(F.count_if("hit").alias("recalled"), F.count_if(~F.col("hit") & F.col("zone")).alias("set_aside"), F.count_if(~F.col("hit") & ~F.col("zone")).alias("missed"))
    hit = F.coalesce(F.col("best") >= F.col("floor"), F.lit(False))
    f = best.withColumn("floor", F.explode(steps)).groupBy("floor").agg(F.count_if("zone").alias("in_zone"), F.count_if(~F.col("zone") & hit).alias("matched"), F.count_if(~F.col("zone") & ~hit).alias("unmatched"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return t.join(f, "floor").select("floor", "recalled", "set_aside", "missed", "in_zone", "matched", "unmatched", share("recalled", "missed").alias("recall"), share("matched", "unmatched").alias("precision"))


def covered_by_union(boxes: DataFrame, zones: DataFrame, key: list[str], row: str) -> DataFrame:
    """Each box with the share of it that the zones of its key cover together."""
    from ..functions.areas import covered
    from ..functions.geometry import dealt

    known = F.lit(True)
    for c in [*key, *"xywh"]:
        known = known & F.col(c).isNotNull()
    box = [F.col(c).cast("double").alias(c) for c in "xywh"]
    rows = boxes.select(*key, row, *box, F.lit(False).alias("_zone")).distinct()
    rows = rows.unionByName(zones.filter(known).select(*key, F.lit(None).cast(rows.schema[row].dataType).alias(row), *box, F.lit(True).alias("_zone")))

    def kernel(frame: pa.Table) -> pa.Table:
        zone = frame.column("_zone").to_numpy()
        at = np.stack([np.nan_to_num(frame.column(c).to_numpy().astype(float)) for c in "xywh"], axis=1)
        own = frame.select([row, "w", "h"]).filter(pa.array(~zone))
        return own.append_column("covered", pa.array(covered(at[zone], at[~zone])))

    of = next(f for f in rows.schema if f.name == row)
    found = dealt(rows, *key).groupBy(*key).applyInArrow(kernel, f"`{row}` {of.dataType.simpleString()}, w double, h double, covered double")
    return found.select(row, (F.col("covered") / area()).alias("share"))
