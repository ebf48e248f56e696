"""Reports on packets, samples and settings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from .registry import detections, events, load, query, with_detections


@query("""WITH a AS (SELECT l_orderkey AS k, round(l_discount, 3) AS v, round(l_tax, 3) AS t, 1 AS n FROM lineitem), b AS (SELECT l_orderkey AS k, round(l_discount + CASE WHEN l_orderkey % 9 = 0 THEN 0.01 ELSE 0 END, 3) AS v, round(l_tax, 3) AS t, -1 AS n FROM lineitem),
d AS (SELECT k, v, t, sum(n) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k, v, t HAVING sum(n) <> 0) SELECT k, sum(abs(n))::BIGINT AS different FROM d GROUP BY k""")
def changed_masks(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_discount").alias("v"), F.col("l_tax").alias("t"))  # noqa: E741
    other = l.withColumn("v", F.col("v") + F.when(F.col("k") % 9 == 0, 0.01).otherwise(0.0))
    return records.changed_keys(l, other, ["k"], ["v", "t"])


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE p IN (SELECT (n * (2 * k + 1)) // 10 FROM range(0, 5) q(k))""")
def even_sample(spark, sf_dir):
    return records.even_sample(load(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("SELECT event_id FROM events ORDER BY sha256('7:' || event_id), event_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return records.seeded_sample(load(spark, sf_dir, "events").select("event_id"), "event_id", 100, 7)


PACKETS = "p AS (SELECT user_id % 50 AS k, event_id AS i, epoch_us(ts) // 1000 + event_id % 7 * 40 AS pts, epoch_us(ts) // 1000 AS dts, event_id % 4 * 10 AS duration FROM events)"


def _packets(spark, sf_dir):
    ms = F.floor(F.col("us") / 1000)
    return events(spark, sf_dir).select((F.col("user_id") % 50).alias("k"), F.col("event_id").alias("i"), (ms + F.col("event_id") % 7 * 40).alias("pts"), ms.alias("dts"), (F.col("event_id") % 4 * 10).alias("duration"))


@query(f"""WITH {PACKETS}, f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) <= 60)
SELECT k, greatest(round_even(max(pts - dts) / greatest(coalesce(min(CASE WHEN duration > 0 THEN duration END), 1), 1), 0)::BIGINT, 0) AS delay FROM f GROUP BY k""")
def reorder_delay(spark, sf_dir):
    return records.reorder_delay(_packets(spark, sf_dir), ["k"], "i", "pts", "dts", "duration")


@query(f"WITH {PACKETS} SELECT k, CASE WHEN count(*) > 1 THEN (max(pts) - min(pts)) / (count(*) - 1) END AS interval FROM p GROUP BY k")
def keyframe_interval(spark, sf_dir):
    return records.keyframe_interval(_packets(spark, sf_dir), ["k"], "pts")


@query(f"""WITH {PACKETS}, a AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY pts) AS n, pts FROM p), b AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY pts) AS n, pts FROM p WHERE i % 400 <> 0)
SELECT coalesce(a.k, b.k) AS k, count(a.pts) AS first, count(b.pts) AS second, count(*) FILTER (a.pts IS DISTINCT FROM b.pts) AS mismatched FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n GROUP BY 1""")
def retimed_check(spark, sf_dir):
    p = _packets(spark, sf_dir)
    return records.same_packets(p, p.filter("i % 400 <> 0"), ["k"], "pts")


@query("WITH s AS (SELECT event_type, sum(event_id)::BIGINT AS total FROM events GROUP BY event_type) SELECT event_type, total, total / sum(total) OVER () AS share, row_number() OVER (ORDER BY total DESC, event_type) AS rank FROM s")
def stage_shares(spark, sf_dir):
    return records.shares_of_total(load(spark, sf_dir, "events"), ["event_type"], "event_id")


@query("SELECT a.a AS conf, b.b AS gap, c.c AS hold FROM (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS a) a, (SELECT unnest([0, 5, 10]) AS b) b, (SELECT unnest([1, 2]) AS c) c WHERE NOT (a.a < 0.5 AND b.b = 10)")
def settings_grid(spark, sf_dir):
    return records.settings_grid(spark, {"conf": [0.3, 0.5, 0.7], "gap": [0, 5, 10], "hold": [1, 2]}, (F.col("conf") < 0.5) & (F.col("gap") == 10))


@query(with_detections("s AS (SELECT track_id, min(CASE WHEN score >= 0.3 THEN frame END) AS seen, min(CASE WHEN score >= 0.6 THEN frame END) AS covered FROM det GROUP BY track_id) SELECT track_id, coalesce(covered - seen, 4200) AS delay FROM s WHERE seen IS NOT NULL"))
def entry_delay(spark, sf_dir):
    return records.entry_delay(detections(spark, sf_dir), ["track_id"], "frame", F.col("score") >= 0.3, F.col("score") >= 0.6, 4200)


@query(with_detections("""o AS (SELECT track_id, frame, min(x) AS x, min(y) AS y FROM det GROUP BY ALL), s AS (SELECT track_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM o WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, round(sum(d), 6) AS length, round(median(d), 6) AS median_step, count(d) AS steps FROM s GROUP BY track_id"""))
def path_length(spark, sf_dir):
    one = detections(spark, sf_dir).groupBy("track_id", "frame").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return records.travelled(one, ["track_id"], "frame", "x", "y").withColumns({"length": F.round("length", 6), "median_step": F.round("median_step", 6)})


@query(with_detections("s AS (SELECT clip_id, frame, min(event_id) % 7 - 3 AS dx, max(event_id) % 5 - 2 AS dy FROM det GROUP BY ALL) SELECT clip_id, frame, dx, dy, (sum(dx) OVER w)::BIGINT AS path_x, (sum(dy) OVER w)::BIGINT AS path_y FROM s WINDOW w AS (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING)"))
def camera_path(spark, sf_dir):
    s = detections(spark, sf_dir).groupBy("clip_id", "frame").agg((F.min("event_id") % 7 - 3).alias("dx"), (F.max("event_id") % 5 - 2).alias("dy"))
    return records.camera_path(s, ["clip_id"], "frame", "dx", "dy")


@query("""WITH f AS (SELECT source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '_out.MP4' WHEN 2 THEN '.csv' ELSE '.mov' END AS path FROM documents)
SELECT path, CASE WHEN regexp_extract(lower(path), '([^/]*?)(\\.[^./]*)?$', 1) LIKE '%\\_out' ESCAPE '\\' THEN 'skip' WHEN lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.mov' THEN 'video' ELSE 'copy' END AS action FROM f""")
def mirror_plan(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, [".mp4", "_out.MP4", ".csv", ".mov"])), (F.col("doc_id") % 4 + 1).cast("int"))
    f = load(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), kind).alias("path"))
    return records.mirror_plan(f, "path", [".mp4", ".mov"], "_out")


@query(f"""WITH {PACKETS}, a AS (SELECT k, i, pts, i * 31 % 101 AS payload, 1 AS base FROM p), b AS (SELECT k, i, pts + CASE WHEN k % 5 = 2 AND i % 50 = 0 THEN 1 ELSE 0 END AS pts, CASE WHEN k % 5 = 3 AND i % 60 = 0 THEN -1 ELSE payload END AS payload, CASE WHEN k % 5 = 4 THEN 2 ELSE 1 END AS base FROM a WHERE NOT (k % 5 = 1 AND i % 70 = 0)),
r AS (SELECT coalesce(x.k, y.k) AS k, count(*) FILTER (x.pts IS DISTINCT FROM y.pts) AS off, count(x.pts) AS nx, count(y.pts) AS ny FROM (SELECT k, pts, row_number() OVER (PARTITION BY k ORDER BY pts) AS n FROM a) x FULL JOIN (SELECT k, pts, row_number() OVER (PARTITION BY k ORDER BY pts) AS n FROM b) y ON x.k = y.k AND x.n = y.n GROUP BY 1),
c AS (SELECT coalesce(x.k, y.k) AS k, count(*) FILTER (x.payload IS DISTINCT FROM y.payload) AS changed, max(x.base) AS ba, max(y.base) AS bb FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM a) x FULL JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM b) y ON x.k = y.k AND x.n = y.n GROUP BY 1)
SELECT k, CASE WHEN ba IS DISTINCT FROM bb THEN 'time base' WHEN nx <> ny THEN 'frame count' WHEN off > 0 THEN off || ' frames off' WHEN changed > 0 THEN 'packets changed' ELSE '' END AS problem FROM r JOIN c USING (k)""")
def retimed_verdicts(spark, sf_dir):
    i, k = F.col("i"), F.col("k")
    a = _packets(spark, sf_dir).select("k", "i", "pts", (i * 31 % 101).alias("payload"), F.lit(1).alias("base"))
    b = a.filter(~((k % 5 == 1) & (i % 70 == 0))).withColumns({"pts": F.col("pts") + F.when((k % 5 == 2) & (i % 50 == 0), 1).otherwise(0), "payload": F.when((k % 5 == 3) & (i % 60 == 0), -1).otherwise(F.col("payload")), "base": F.when(k % 5 == 4, 2).otherwise(1)})
    return records.retimed_verdict(a, b, ["k"], "pts", "i", "base", "payload")


@query("""WITH f AS (SELECT 'in/' || source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '_out.mp4' ELSE '.mov' END AS path FROM documents)
SELECT path, 'out/' || regexp_replace(substring(path, 4), '\\.[^./]*$', '') || '_out' || regexp_extract(path, '(\\.[^./]*)$', 1) AS destination FROM f""")
def destinations(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, [".mp4", "_out.mp4", ".mov"])), (F.col("doc_id") % 3 + 1).cast("int"))
    f = load(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), kind).alias("path"))
    return records.destinations(f, "path", "in", "out", "_out")


@query("""WITH c AS (SELECT o_orderkey, arg_max(o_custkey % 9, (o_orderkey % 1000, o_custkey % 9)) AS owner, max(o_orderkey % 1000) AS time FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_orderkey)
SELECT o.o_orderkey, round_even(o_totalprice, 0)::BIGINT AS size, row_number() OVER (ORDER BY round_even(o_totalprice, 0)::BIGINT DESC, o.o_orderkey) AS place, owner AS last_owner FROM orders o LEFT JOIN c USING (o_orderkey) WHERE o_orderstatus <> 'F' AND (owner IS NULL OR 1000 - time >= 400)""")
def claim_order(spark, sf_dir):
    from ..operators import dispatch

    o = load(spark, sf_dir, "orders").withColumn("size", F.rint("o_totalprice").cast("long"))
    claims = o.filter("o_custkey % 3 = 0").select("o_orderkey", (F.col("o_custkey") % 9).alias("owner"), (F.col("o_orderkey") % 1000).alias("time"))
    return dispatch.claim_order(o.select("o_orderkey", "size"), o.filter("o_orderstatus = 'F'"), claims, "o_orderkey", "size", 1000, 400)
