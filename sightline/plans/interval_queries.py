"""Runs and intervals over the driver's events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals
from .registry import detections, events, load, query, with_detections

DAY, HOUR = 86_400_000_000, 3_600_000_000


@query(f"""
WITH p AS (SELECT DISTINCT user_id, epoch_us(ts) AS pos FROM events),
s AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) > {DAY}, true)::INT AS b FROM p),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT user_id, min(pos) AS first, max(pos) AS last, count(*) AS hits FROM r GROUP BY user_id, run HAVING count(*) >= 2""")
def gap_runs(spark, sf_dir):
    return intervals.gap_runs(events(spark, sf_dir), ["user_id"], "us", DAY, 2)


@query(f"""
WITH h AS (SELECT DISTINCT user_id % 20 AS k, epoch_us(ts) // {HOUR} AS pos FROM events WHERE value >= 50),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS g FROM h)
SELECT k, min(pos) AS first, max(pos) + 1 AS "end", count(*) AS hits FROM i GROUP BY k, g HAVING count(*) >= 3""")
def flag_runs_min_len(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 20).alias("k"), F.floor(F.col("us") / HOUR).alias("at"), "value")
    return intervals.flag_runs(e, ["k"], "at", F.col("value") >= 50, 3)


@query(f"""
WITH h AS (SELECT DISTINCT user_id % 20 AS k, epoch_us(ts) // {HOUR} - 473352 AS pos FROM events WHERE value >= 50),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS g FROM h),
r AS (SELECT k, min(pos) * 60 AS lo, (max(pos) + 1) * 60 AS hi FROM i GROUP BY k, g),
j AS (SELECT *, coalesce(lo - lag(hi) OVER (PARTITION BY k ORDER BY lo) >= 180, true)::INT AS b FROM r),
jj AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run FROM j),
s AS (SELECT k, greatest(min(lo) - 30, 0) AS start, max(hi) + 30 AS "end" FROM jj GROUP BY k, run HAVING max(hi) - min(lo) >= 180),
m AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS b FROM s),
mm AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT k, min(start) AS start, max("end") AS "end", count(*) AS parts FROM mm GROUP BY k, run""")
def speech_like_segments(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 20).alias("k"), (F.floor(F.col("us") / HOUR) - 473352).alias("at"), "value")
    return intervals.speech_segments(e, ["k"], "at", F.col("value") >= 50, 60, 180, 180, 30)


@query(f"""
WITH g AS (SELECT user_id % 20 AS k, epoch_us(ts) // {DAY} AS d, bool_or(event_type = 'error') AS masked FROM events GROUP BY ALL),
c AS (SELECT k, d AS start, d + 1 AS "end", NOT masked AS copy FROM g),
b AS (SELECT *, coalesce(copy <> lag(copy) OVER (PARTITION BY k ORDER BY start), true)::INT AS b FROM c),
r AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM b),
m AS (SELECT k, min(start) AS start, max("end") AS "end", any_value(copy) AS copy FROM r GROUP BY k, run),
f AS (SELECT k, start, "end", copy AND NOT (count(*) OVER (PARTITION BY k) > 1 AND "end" - start < 2) AS copy FROM m),
b2 AS (SELECT *, coalesce(copy <> lag(copy) OVER (PARTITION BY k ORDER BY start), true)::INT AS b FROM f),
r2 AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM b2)
SELECT k, min(start) AS start, max("end") AS "end", any_value(copy) AS copy FROM r2 GROUP BY k, run""")
def segment_plan(spark, sf_dir):
    e = events(spark, sf_dir)
    days = e.groupBy((F.col("user_id") % 20).alias("k"), F.floor(F.col("us") / DAY).alias("d")).agg(F.bool_or(F.col("event_type") == "error").alias("masked"))
    return intervals.segment_plan(days.withColumn("e", F.col("d") + 1), ["k"], "d", "d", "e", "masked", 2)


@query("""
WITH s AS (SELECT o_custkey, epoch_us(o_orderdate) // 86400000000 AS start, epoch_us(o_orderdate) // 86400000000 + 30 + o_orderkey % 31 AS "end" FROM orders),
m AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY o_custkey ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS b FROM s),
mm AS (SELECT *, sum(b) OVER (PARTITION BY o_custkey ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT o_custkey, min(start) AS start, max("end") AS "end", count(*) AS parts FROM mm GROUP BY o_custkey, run""")
def merge_intervals(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    day = F.expr("datediff(CAST(o_orderdate AS DATE), DATE'1970-01-01')").cast("long")
    return intervals.merge_intervals(o.select("o_custkey", day.alias("s"), (day + 30 + F.col("o_orderkey") % 31).alias("e")), ["o_custkey"], "s", "e")


@query(f"""
WITH h AS (SELECT DISTINCT user_id % 20 AS k, epoch_us(ts) // {HOUR} AS pos FROM events WHERE event_type = 'error')
SELECT DISTINCT k, pos + d AS pos FROM h, range(-2, 3) r(d)""")
def dilate_flags(spark, sf_dir):
    e = events(spark, sf_dir).filter("event_type = 'error'").select((F.col("user_id") % 20).alias("k"), F.floor(F.col("us") / HOUR).alias("pos"))
    return intervals.dilate(e, ["k"], "pos", 2)


@query(with_detections("""
r AS (SELECT clip_id, frame - 3 AS start, frame + 4 AS "end" FROM det WHERE score >= 0.99),
n AS (SELECT clip_id, frame, event_id, x + 1000 AS x FROM det WHERE score >= 0.99)
SELECT clip_id, frame, event_id, x FROM det a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.clip_id = a.clip_id AND a.frame >= r.start AND a.frame < r."end")
UNION ALL SELECT * FROM n"""))
def range_replace(spark, sf_dir):
    d = detections(spark, sf_dir)
    sure = d.filter("score >= 0.99")
    ranges = sure.select("clip_id", (F.col("frame") - 3).alias("start"), (F.col("frame") + 4).alias("end"))
    new = sure.select("clip_id", "frame", "event_id", (F.col("x") + 1000).alias("x"))
    return intervals.replace_ranges(d.select("clip_id", "frame", "event_id", "x"), new, ranges, ["clip_id"], "frame")


@query(f"""
WITH h AS (SELECT DISTINCT user_id % 20 AS k, epoch_us(ts) // {HOUR} AS pos FROM events WHERE value >= 50),
b AS (SELECT k, min(pos) AS a, max(pos) AS z FROM h GROUP BY k),
s AS (SELECT b.k, pos FROM b, LATERAL (SELECT unnest(range(a, z + 1)) AS pos)),
v AS (SELECT s.k, s.pos, h.pos IS NOT NULL AS valid FROM s LEFT JOIN h ON h.k = s.k AND h.pos = s.pos),
g AS (SELECT *, max(CASE WHEN valid THEN pos END) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p, min(CASE WHEN valid THEN pos END) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM v)
SELECT k, pos, valid OR n - p - 1 <= 2 AS valid, NOT valid AND n - p - 1 <= 2 AS interpolated FROM g""")
def gap_interpolation(spark, sf_dir):
    h = events(spark, sf_dir).filter("value >= 50").select((F.col("user_id") % 20).alias("k"), F.floor(F.col("us") / HOUR).alias("pos")).distinct()
    every = h.groupBy("k").agg(F.min("pos").alias("a"), F.max("pos").alias("z")).select("k", F.explode(F.sequence("a", "z")).alias("pos"))
    series = every.join(h.withColumn("valid", F.lit(True)), ["k", "pos"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    return intervals.gap_validity(series, ["k"], "pos", "valid", 2)


@query(with_detections("""
one AS (SELECT clip_id, track_id, frame, min(x) AS x FROM det GROUP BY ALL),
s AS (SELECT *, coalesce(frame - lag(frame) OVER w > 200, true)::INT AS b FROM one WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
r AS (SELECT *, sum(b) OVER (PARTITION BY track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM s),
p AS (SELECT *, count(*) OVER g AS n, min(frame) OVER g AS f, max(frame) OVER g AS l, lag(frame) OVER (PARTITION BY track_id, run ORDER BY frame) AS prev FROM r WINDOW g AS (PARTITION BY track_id, run))
SELECT clip_id, track_id, run, x, t AS frame, t <> p.frame AS held FROM p, LATERAL (SELECT unnest(range(coalesce(prev + 1, p.frame), CASE WHEN p.frame = l THEN greatest(l + 3, f + 9) ELSE p.frame END + 1)) AS t)
WHERE n >= 2 AND t >= 0 AND t < 4200"""))
def held_boxes(spark, sf_dir):
    one = detections(spark, sf_dir).groupBy("clip_id", "track_id", "frame").agg(F.min("x").alias("x"))
    step = F.col("frame") - F.lag("frame").over(Window.partitionBy("track_id").orderBy("frame"))
    runs = intervals.numbered_islands(one.withColumn("step", step), ["track_id"], ["frame"], F.coalesce(F.col("step") > 200, F.lit(True))).drop("step")
    return intervals.hold(runs, ["clip_id", "track_id"], "run", "frame", 3, 2, 10, 4200)
