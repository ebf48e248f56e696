"""Joins of boxes and of times over the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import bucket, centre, long_side, plausible
from ..operators import asof, spatial
from .registry import IOU_SQL, detections, events, query, with_detections

SAME = "a.clip_id = b.clip_id AND a.frame = b.frame"
WIDE = {"x": "x - 20", "y": "y - 20", "w": "w + 40", "h": "h + 40"}


def by_source(spark, sf_dir, *sources):
    d = detections(spark, sf_dir)
    return [d.filter(F.col("source") == s) for s in sources]


@query(with_detections("""v AS (SELECT *, greatest(w, h) AS long_side, x + w / 2 AS cx, y + h / 2 AS cy FROM det)
SELECT event_id, clip_id, frame, long_side, cx, cy, w * h AS area, greatest(w, h) <= 0.1 * 1600 AND least(w, h) >= 2 AND w / h BETWEEN 0.4 AND 2.5 AS plausible,
 w * h >= 0.005 * 1600 * 1300 AS page, CASE WHEN long_side < 64 THEN 'small' WHEN long_side < 96 THEN 'middle' ELSE 'large' END AS size FROM v"""))
def detections_derived(spark, sf_dir):
    d, (cx, cy) = detections(spark, sf_dir), centre()
    return d.select("event_id", "clip_id", "frame", long_side().alias("long_side"), cx.alias("cx"), cy.alias("cy"), (F.col("w") * F.col("h")).alias("area"), plausible(1600, 1300, 0.1).alias("plausible"), (F.col("w") * F.col("h") >= 0.005 * 1600 * 1300).alias("page"), bucket(long_side(), [64, 96], ["small", "middle", "large"]).alias("size"))


@query(with_detections(f"""a AS (SELECT * FROM det WHERE source = 'view'), b AS (SELECT * FROM det WHERE source = 'click')
SELECT a.event_id, max(b.score) AS best, count(b.score) AS support FROM a LEFT JOIN b ON {SAME} AND {IOU_SQL} >= 0.1 GROUP BY a.event_id"""))
def confirm_best_score(spark, sf_dir):
    a, b = by_source(spark, sf_dir, "view", "click")
    return spatial.best_confirmation(a, b, 0.1)


STRONG = with_detections(f"""v AS (SELECT * FROM det WHERE source = 'view'), b AS (SELECT * FROM det WHERE source = 'click'),
c AS (SELECT a.event_id, a.score, greatest(a.w, a.h) AS long_side, max(b.score) AS best FROM v a LEFT JOIN b ON {SAME} AND {IOU_SQL} >= 0.1 GROUP BY ALL)
SELECT event_id, score, best FROM c WHERE """)


def _candidates(spark, sf_dir):
    v, c = by_source(spark, sf_dir, "view", "click")
    return v.select("event_id", "score", long_side().alias("long_side")).join(spatial.best_confirmation(v, c, 0.1), "event_id")


@query(STRONG + "(score >= 0.6 AND best IS NOT NULL) OR (score < 0.6 AND score >= 0.3 AND best >= 0.5 AND long_side < 80) OR (long_side >= 140 AND best IS NOT NULL)")
def strong_candidates(spark, sf_dir):
    known = F.col("best").isNotNull()
    rules = ((F.col("score") >= 0.6) & known) | ((F.col("score") >= 0.3) & (F.col("score") < 0.6) & (F.col("best") >= 0.5) & (F.col("long_side") < 80)) | ((F.col("long_side") >= 140) & known)
    return _candidates(spark, sf_dir).filter(rules).select("event_id", "score", "best")


@query(STRONG + "(score >= 0.2 AND score < 0.6) OR (score >= 0.6 AND best IS NULL)")
def weak_candidates(spark, sf_dir):
    rules = ((F.col("score") >= 0.2) & (F.col("score") < 0.6)) | ((F.col("score") >= 0.6) & F.col("best").isNull())
    return _candidates(spark, sf_dir).filter(rules).select("event_id", "score", "best")


@query(with_detections(f"""p AS (SELECT * FROM det WHERE source = 'view'), q AS (SELECT * FROM det WHERE source = 'click'), t AS (SELECT * FROM det WHERE source = 'purchase'),
s AS (SELECT a.event_id, 1 + (EXISTS (SELECT 1 FROM q b WHERE {SAME} AND {IOU_SQL} >= 0.1))::BIGINT + (EXISTS (SELECT 1 FROM t b WHERE {SAME} AND {IOU_SQL} >= 0.1))::BIGINT AS support FROM p a)
SELECT event_id, support FROM s WHERE support > 1
UNION ALL SELECT a.event_id, 2 FROM q a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE {SAME} AND {IOU_SQL} >= 0.1) AND EXISTS (SELECT 1 FROM t b WHERE {SAME} AND {IOU_SQL} >= 0.1)"""))
def consensus_labels(spark, sf_dir):
    return spatial.consensus(*by_source(spark, sf_dir, "view", "click", "purchase"), 0.1)


@query(with_detections(f"""a AS (SELECT * FROM det WHERE source = 'view'), b AS (SELECT * FROM det WHERE source = 'click')
SELECT event_id, clip_id, frame FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {SAME} AND ({IOU_SQL} >= 0.3 OR (b.x + b.w / 2 BETWEEN a.x AND a.x + a.w AND b.y + b.h / 2 BETWEEN a.y AND a.y + a.h)))"""))
def uncovered_regions(spark, sf_dir):
    a, b = by_source(spark, sf_dir, "view", "click")
    return spatial.uncovered(a, b, 0.3).select("event_id", "clip_id", "frame")


@query(with_detections(f"""a AS (SELECT * FROM det WHERE score >= 0.5 AND source = 'view'), b AS (SELECT * FROM det WHERE source <> 'view')
SELECT clip_id, frame, count(*) AS open_boxes FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {SAME} AND {IOU_SQL} >= 0.3) GROUP BY clip_id, frame"""))
def unmasked_frames(spark, sf_dir):
    d = detections(spark, sf_dir)
    return spatial.flagged_frames(d.filter("score >= 0.5 AND source = 'view'"), d.filter("source <> 'view'"), 0.3)


@query(with_detections(f"""t AS (SELECT * FROM det WHERE source = 'view'), f AS (SELECT * FROM det WHERE source = 'click'), fl AS (SELECT i / 10.0::DOUBLE AS floor FROM range(0, 10) r(i)),
h AS (SELECT a.event_id, max(b.score) AS best FROM t a LEFT JOIN f b ON {SAME} AND {IOU_SQL} >= 0.1 GROUP BY a.event_id),
m AS (SELECT a.event_id, any_value(a.score) AS score, count(b.event_id) AS n FROM f a LEFT JOIN t b ON {SAME} AND {IOU_SQL} >= 0.1 GROUP BY a.event_id),
r AS (SELECT floor, count(*) FILTER (best >= floor) AS hit, count(*) AS truth FROM h, fl GROUP BY floor),
p AS (SELECT floor, count(*) FILTER (n > 0) AS matched, count(*) AS found FROM m, fl WHERE score >= floor GROUP BY floor)
SELECT floor, hit, truth - hit AS missed, matched, found - matched AS unmatched, hit / truth AS recall, matched / found AS precision FROM fl JOIN r USING (floor) JOIN p USING (floor)"""))
def recall_precision_by_floor(spark, sf_dir):
    truth, found = by_source(spark, sf_dir, "view", "click")
    floors = spark.range(10).select((F.col("id") / F.lit(10.0)).alias("floor"))
    return spatial.match_report(truth, found, floors, 0.1)


@query(with_detections("""p AS (SELECT a.event_id, a.frame AS f, b.frame AS nf, b.event_id AS nid FROM det a JOIN det b ON a.track_id = b.track_id AND b.frame > a.frame AND b.frame - a.frame <= 450
 AND sqrt((a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2) <= 1.5 * greatest(a.w, a.h, b.w, b.h) AND least(greatest(a.w, a.h), greatest(b.w, b.h)) >= 0.5 * greatest(a.w, a.h, b.w, b.h)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY nf, nid) AS k FROM p)
SELECT event_id, nid AS next_id, nf - f AS gap FROM r WHERE k = 1"""))
def exposure_next_sighting(spark, sf_dir):
    return spatial.next_sightings(detections(spark, sf_dir), 450, 1.5, 0.5)


@query(with_detections("""s AS (SELECT clip_id, frame, event_id, x - 20 AS x, y - 20 AS y, w + 40 AS w, h + 40 AS h, source AS label FROM det WHERE source IN ('click', 'purchase')),
p AS (SELECT a.event_id, (greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) / (a.w * a.h) AS share, b.label, b.event_id AS id
 FROM det a JOIN s b ON a.clip_id = b.clip_id AND a.frame = b.frame WHERE a.source = 'view'),
m AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY share DESC, label DESC, id DESC) AS k FROM p WHERE share >= 0.2)
SELECT d.event_id, coalesce(m.label, 'none') AS label, coalesce(m.share, 0) AS share FROM det d LEFT JOIN m ON m.event_id = d.event_id AND m.k = 1 WHERE d.source = 'view'"""))
def surface_lookup(spark, sf_dir):
    view, click, purchase = by_source(spark, sf_dir, "view", "click", "purchase")
    wide = click.unionByName(purchase).select("clip_id", "frame", "event_id", *(F.expr(e).alias(c) for c, e in WIDE.items()), F.col("source").alias("label"))
    return spatial.surface_of(view, wide, 0.2)


@query("""
WITH f AS (SELECT DISTINCT user_id % 5 AS clip_id FROM events), x AS (SELECT unnest([0, 300, 600, 900, 1200]) AS x), y AS (SELECT unnest([0, 300, 600, 900]) AS y)
SELECT clip_id, y::INT AS y, x::INT AS x, 400 AS w, 400 AS h FROM f, x, y WHERE y + 400 > 500""")
def sliding_tiles(spark, sf_dir):
    frames = events(spark, sf_dir).select((F.col("user_id") % 5).alias("clip_id")).distinct()
    return spatial.tiles(frames, 1600, 1300, 400, 300, 500)


KINDS = "l AS (SELECT user_id % 10 AS k, event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), r AS (SELECT user_id % 10 AS k, event_id AS id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'purchase')"
HALF_HOUR = 1_800_000_000


def _clicks(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 10).alias("k"), F.col("event_id").alias("id"), F.col("us").alias("t"), "value", "event_type")
    return e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'")


NEAREST = f"""WITH {KINDS},
p AS (SELECT l.k, l.t, l.id, r.t AS right_t, r.id AS right_id, abs(r.t - l.t) AS distance, row_number() OVER (PARTITION BY l.id ORDER BY abs(r.t - l.t), r.t, CASE WHEN r.t <= l.t THEN -r.id ELSE r.id END) AS n FROM l JOIN r ON l.k = r.k AND r.t BETWEEN l.t - {HALF_HOUR} AND l.t + {HALF_HOUR})
SELECT k, t, id, right_t, right_id, distance FROM p WHERE n = 1"""


@query(NEAREST)
def asof_nearest(spark, sf_dir):
    return asof.nearest(*_clicks(spark, sf_dir), ["k"], "t", "id", HALF_HOUR)


@query(f"WITH m AS ({NEAREST}) SELECT k, t, id, right_t, right_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY k, right_id ORDER BY t, id) AS u FROM m) WHERE u = 1")
def asof_nearest_once(spark, sf_dir):
    return asof.one_to_one(asof.nearest(*_clicks(spark, sf_dir), ["k"], "t", "id", HALF_HOUR), ["k"])


@query(f"WITH m AS ({NEAREST}) SELECT k, right_id, min(id) AS first_id FROM m GROUP BY k, right_id")
def first_frame_per_row(spark, sf_dir):
    return asof.first_per(asof.nearest(*_clicks(spark, sf_dir), ["k"], "t", "id", HALF_HOUR), ["k", "right_id"], "id", "first_id")


@query(f"""WITH {KINDS},
p AS (SELECT l.k, l.t, l.id, (SELECT max((r.t, r.id, r.value)) FROM r WHERE r.k = l.k AND r.t <= l.t) AS p, (SELECT min((r.t, r.id, r.value)) FROM r WHERE r.k = l.k AND r.t >= l.t) AS n FROM l),
q AS (SELECT k, t, id, p[1] AS pt, p[3] AS pv, n[1] AS nt, n[3] AS nv FROM p),
v AS (SELECT *, coalesce(pt IS NOT NULL AND nt IS NOT NULL AND least(t - pt, nt - t) <= {HALF_HOUR}, false) AS valid FROM q)
SELECT k, t, id, valid, CASE WHEN valid THEN pv + CASE WHEN nt > pt THEN (t - pt) / (nt - pt) ELSE 0 END * (nv - pv) END AS value FROM v""")
def asof_interpolate(spark, sf_dir):
    return asof.interpolate(*_clicks(spark, sf_dir), ["k"], "t", "id", "value", HALF_HOUR)


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, event_type, event_id, value FROM events),
f AS (SELECT * FROM e WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY event_id) = 1)
SELECT c.user_id, c.day, c.value AS click_value, v.value AS view_value FROM f c JOIN f v ON c.user_id = v.user_id AND c.day = v.day AND c.event_type = 'click' AND v.event_type = 'view'""")
def sensor_pivot_join(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("us") / 86_400_000_000).alias("day"), "event_type", "event_id", "value")
    return asof.both_kinds(e, ["user_id", "day"], "event_type", "event_id", "click", "view", ["value"])


@query("""
WITH n AS (SELECT user_id % 10 AS k, (row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id))::DOUBLE AS x, (epoch_us(ts) - 1704067200000000)::DOUBLE / 1000000 AS y FROM events)
SELECT k, round(regr_slope(y, x), 3) AS slope, round(regr_intercept(y, x), 3) AS intercept, count(*) AS n FROM n GROUP BY k""")
def clock_fit(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("k", F.col("user_id") % 10)
    e = e.withColumn("x", F.row_number().over(Window.partitionBy("k").orderBy("us", "event_id")).cast("double")).withColumn("y", (F.col("us") - 1704067200000000) / F.lit(1000000.0))
    return asof.clock_line(e, ["k"], "x", "y").select("k", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")
