"""Predicates, labels and geometry over the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geometry import centre, long_side, renamed
from ..functions.polygons import meet_column
from ..operators import hands, spatial, suppression
from .registry import CAMERA_SQL, IOU_SQL, camera, dealt, detections, fold_sql, query, rounded, with_detections


def ident():
    return F.col("event_id")



def det(spark, sf_dir):
    return detections(spark, sf_dir)


@query(with_detections("SELECT event_id FROM det WHERE w * h <= 0.005 * 1600 * 1300"))
def screen_cap(spark, sf_dir):
    return det(spark, sf_dir).filter(rules.under_cap(1600, 1300, 0.005)).select("event_id")


@query(with_detections("SELECT event_id, CASE WHEN least(w, h) > 60 AND greatest(w, h) < 1.6 * least(w, h) AND event_id % 4 < 2 THEN 'shape' WHEN event_id * 7 % 256 > 220 THEN 'bright' WHEN event_id * 3 % 100 / 100.0::DOUBLE < 0.1 THEN 'ink' END AS rule FROM det"))
def false_text_rules(spark, sf_dir):
    label = rules.false_text(F.least("w", "h"), F.greatest("w", "h"), ident() % 4, ident() * 7 % 256, ident() * 3 % 100 / 100.0, 60, 1.6, 2, 220, 0.1)
    return det(spark, sf_dir).select("event_id", label.alias("rule"))


CORNERS = "[{'x': x, 'y': y}, {'x': x + w, 'y': y + w / 8}, {'x': x + w, 'y': y + h + w / 8}, {'x': x, 'y': y + h}]"


def corners():
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = map(F.col, "xywh")
    return F.array(p(x, y), p(x + w, y + w / 8), p(x + w, y + h + w / 8), p(x, y + h))


@query(with_detections(f"SELECT event_id, greatest(w, h) >= 140 OR list_max(list_transform({CORNERS}, lambda p: p.y)) >= 1300 * 0.9 AS wearer FROM det"))
def hand_qualified(spark, sf_dir):
    return det(spark, sf_dir).select("event_id", rules.wearers_hand(F.col("w"), F.col("h"), corners(), 1300, 140, 0.1).alias("wearer"))


KINDS = "k AS (SELECT *, CASE source WHEN 'view' THEN NULL WHEN 'click' THEN 'face' WHEN 'purchase' THEN 'screen' WHEN 'signup' THEN 'text' ELSE 'plate' END AS kind, CASE WHEN event_id % 7 = 0 THEN score END AS hand, CASE WHEN event_id % 11 = 0 THEN score END AS zone FROM det)"


def kinds(spark, sf_dir):
    s = F.col("source")
    kind = F.when(s == "click", "face").when(s == "purchase", "screen").when(s == "signup", "text").when(s == "error", "plate")
    return det(spark, sf_dir).withColumns({"kind": kind, "hand": F.when(ident() % 7 == 0, F.col("score")), "zone": F.when(ident() % 11 == 0, F.col("score"))})


@query(with_detections(f"{KINDS} SELECT event_id, hand IS NULL AND zone IS NULL AS counts FROM k WHERE coalesce(kind, 'face') = 'face'"))
def faces_not_set_aside(spark, sf_dir):
    return kinds(spark, sf_dir).filter(rules.counts_as(F.col("kind"), "face")).select("event_id", rules.not_set_aside(F.col("hand"), F.col("zone")).alias("counts"))


@query(with_detections(f"{KINDS} SELECT event_id, kind FROM k WHERE frame % CASE kind WHEN 'screen' THEN 2 WHEN 'text' THEN 3 ELSE 1 END = 0"))
def stride_samples(spark, sf_dir):
    return kinds(spark, sf_dir).filter(rules.on_stride(F.col("frame"), F.col("kind"), {"screen": 2, "text": 3})).select("event_id", "kind")


LENGTHS = "n AS (SELECT track_id, max(frame) AS n FROM det GROUP BY track_id)"


def lengths(spark, sf_dir):
    return det(spark, sf_dir).groupBy("track_id").agg(F.max("frame").alias("n"))


@query(with_detections(f"{LENGTHS} SELECT track_id, a AS start, least(a + 450, n) AS \"end\" FROM n, LATERAL (SELECT unnest(range(0, n, 450)) AS a)"))
def fixed_chunks(spark, sf_dir):
    return lengths(spark, sf_dir).select("track_id", F.explode(rules.chunks(F.col("n"), 450)).alias("c")).select("track_id", "c.start", "c.end")


@query(with_detections(f"{LENGTHS} SELECT DISTINCT track_id, round_even(i * (n - 1) / 6, 0)::BIGINT AS place FROM n, range(0, 7) r(i) WHERE n > 7 UNION ALL SELECT track_id, p FROM n, LATERAL (SELECT unnest(range(0, n)) AS p) WHERE n <= 7"))
def spread_places(spark, sf_dir):
    return lengths(spark, sf_dir).select("track_id", F.explode(rules.spread_places(F.col("n"), 7)).alias("place"))


#: Five sources as five views of one picture, in frames of six hours so that boxes meet.
VIEWS = "d AS (SELECT * REPLACE (frame // 36 AS frame) FROM det)"
ON = "b.clip_id = a.clip_id AND b.frame = a.frame AND " + IOU_SQL + " >= 0.1"
BEST = lambda source: f"coalesce(max(CASE WHEN b.source = '{source}' THEN b.score END), 0)"
CONFIRM = f"""{VIEWS}, v AS (SELECT a.event_id, any_value(a.score) AS score, any_value(greatest(a.w, a.h)) AS side, {BEST('click')} AS main, {BEST('purchase')} AS mirror, {BEST('signup')} AS tight, {BEST('error')} >= 0.4 AS third FROM d a LEFT JOIN d b ON {ON} WHERE a.source = 'view' GROUP BY a.event_id),
c AS (SELECT event_id, score, side, greatest(CASE WHEN main >= 0.3 AND main < 0.7 AND mirror < 0.2 THEN 0 ELSE main END, CASE WHEN mirror >= 0.8 THEN mirror ELSE 0 END, CASE WHEN tight >= 0.8 THEN tight ELSE 0 END) AS confidence, third FROM v),
o AS (SELECT *, confidence >= 0.3 OR (confidence >= 0.15 AND third) AS confirmed FROM c)"""


def views(spark, sf_dir):
    return det(spark, sf_dir).withColumn("frame", F.floor(F.col("frame") / 36))


def _confirmed(spark, sf_dir):
    d = views(spark, sf_dir)
    of = lambda s: d.filter(F.col("source") == s)
    c = spatial.confirmation(of("view"), of("click"), mirror=of("purchase"), extra=[of("purchase"), of("signup")], third=of("error"), least=0.1, unsure=(0.3, 0.7), mirror_agrees=0.2, sure=0.8, third_score=0.4)
    return c.withColumn("confirmed", (F.col("confidence") >= 0.3) | ((F.col("confidence") >= 0.15) & F.col("third")))


@query(with_detections(f"{CONFIRM} SELECT event_id, confidence, third, confirmed FROM o"))
def confirmation_views(spark, sf_dir):
    return _confirmed(spark, sf_dir).select("event_id", "confidence", "third", "confirmed")


PLAIN = "{'x': x, 'y': y, 'w': w, 'h': h, 'event_id': event_id}"


def _kept(rule: str) -> str:
    sql = with_detections(f"{CONFIRM}, p AS (SELECT d.* FROM d JOIN o USING (event_id) WHERE {rule}), {fold_sql('p', 'clip_id, frame', 'score DESC, event_id', PLAIN, IOU_SQL + ' > 0.2')} SELECT clip_id, frame, b.event_id FROM u")
    return sql.replace("WITH det", "WITH RECURSIVE det")


STRONG = "(o.score >= 0.6 AND confirmed) OR (o.score >= 0.4 AND o.score < 0.6 AND side <= 120 AND confidence >= 0.5)"


def _boxes(spark, sf_dir, test):
    c = _confirmed(spark, sf_dir).select("event_id", "confidence", "confirmed")
    d = views(spark, sf_dir).join(c, "event_id").filter(test)
    return suppression.suppress(d, ["clip_id", "frame"], "event_id", 0.2).select("clip_id", "frame", "event_id")


@query(_kept(STRONG))
def strong_boxes_kept(spark, sf_dir):
    agree = (F.col("score") >= 0.4) & (F.col("score") < 0.6) & (long_side() <= 120) & (F.col("confidence") >= 0.5)
    return _boxes(spark, sf_dir, ((F.col("score") >= 0.6) & F.col("confirmed")) | agree)


@query(_kept("(o.score >= 0.2 AND o.score < 0.6) OR (o.score >= 0.6 AND NOT confirmed)"))
def weak_boxes_kept(spark, sf_dir):
    return _boxes(spark, sf_dir, ((F.col("score") >= 0.2) & (F.col("score") < 0.6)) | ((F.col("score") >= 0.6) & ~F.col("confirmed")))


SPREAD = "spread AS (SELECT clip_id, f.frame + s * d AS frame, event_id * 10 + d * 2 + (s + 1) // 2 AS event_id, x - w * 0.1 * d / 2 AS x, y - h * 0.1 * d / 2 AS y, w * (1 + 0.1 * d) AS w, h * (1 + 0.1 * d) AS h, score FROM det f, range(0, 3) r(d), (SELECT unnest([-1, 1]) AS s) q WHERE d > 0 OR s = 1)"


@query(with_detections(f"{SPREAD}, {fold_sql('spread', 'clip_id, frame', 'score DESC, event_id DESC', PLAIN, IOU_SQL + ' > 0.6')} SELECT clip_id, frame, b.event_id FROM u WHERE frame >= 0").replace("WITH det", "WITH RECURSIVE det"))
def window_spread(spark, sf_dir):
    d = spatial.spread(det(spark, sf_dir).select("clip_id", "frame", "event_id", "x", "y", "w", "h", "score"), 2, 0.1)
    d = d.withColumn("event_id", ident() * 10 + F.abs("step") * 2 + F.when(F.col("step") >= 0, 1).otherwise(0))
    return suppression.suppress(d, ["clip_id", "frame"], "event_id", 0.6, last_first=True).filter("frame >= 0").select("clip_id", "frame", "event_id")


@query(with_detections("SELECT event_id, x - 0.5 * w AS x, y - 0.5 * h AS y, w * 2 AS w, h * 2 AS h FROM det"))
def dilated_boxes(spark, sf_dir):
    return spatial.dilated(det(spark, sf_dir), 0.5).select("event_id", "x", "y", "w", "h")


LABELS = "o AS (SELECT clip_id, frame // 36 AS frame, event_id, source AS label, x, y, w, h, score FROM det WHERE source IN ('view', 'click') AND score >= 0.2 AND w * h >= 0.001 * 1600 * 1300)"


@query(with_detections(f"{LABELS}, {fold_sql('o', 'clip_id, frame', 'score DESC, event_id DESC', PLAIN, IOU_SQL + ' > 0.5')} SELECT clip_id, frame, b.event_id, b.x, b.y, b.w, b.h FROM u").replace("WITH det", "WITH RECURSIVE det"))
def oracle_boxes(spark, sf_dir):
    d = views(spark, sf_dir).select("clip_id", "frame", "event_id", F.col("source").alias("label"), "score", F.array(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("box"))
    return spatial.oracle_boxes(d, ["view", "click"], 0.2, 0.001 * 1600 * 1300, 0.5, ["clip_id", "frame"], "event_id").select("clip_id", "frame", "event_id", "x", "y", "w", "h")


@query(with_detections("SELECT track_id, frame, event_id FROM det WHERE source <> 'signup' AND event_id % 3 = 0 AND greatest(w, h) >= 64"))
def track_sightings(spark, sf_dir):
    d = det(spark, sf_dir).withColumn("marks", F.when(ident() % 3 == 0, F.lit(1)))
    return spatial.sightings(d, "signup", "marks", 64).select("track_id", "frame", "event_id")


ZONED = f"""{VIEWS}, t AS (SELECT d.*, EXISTS (SELECT 1 FROM d z WHERE z.source = 'error' AND z.clip_id = d.clip_id AND z.frame = d.frame AND (greatest(0, least(d.x + d.w, z.x + z.w) - greatest(d.x, z.x)) * greatest(0, least(d.y + d.h, z.y + z.h) - greatest(d.y, z.y))) / (d.w * d.h) >= 0.3) AS zone FROM d)"""


@query(with_detections(f"""{ZONED}, o AS (SELECT * FROM t WHERE source = 'view'), m AS (SELECT * FROM t WHERE source = 'click'), f AS (SELECT i / 5.0::DOUBLE AS floor FROM range(0, 5) r(i)),
h AS (SELECT a.event_id, any_value(a.zone) AS zone, any_value(a.score) AS score, count(b.event_id) > 0 AS hit FROM o a LEFT JOIN m b ON {ON} GROUP BY a.event_id),
g AS (SELECT a.event_id, any_value(a.zone) AS zone, max(b.score) AS best FROM m a LEFT JOIN o b ON {ON} GROUP BY a.event_id),
x AS (SELECT floor, count(*) FILTER (hit) AS recalled, count(*) FILTER (NOT hit AND zone) AS set_aside, count(*) FILTER (NOT hit AND NOT zone) AS missed FROM h, f WHERE score >= floor GROUP BY floor),
y AS (SELECT floor, count(*) FILTER (zone) AS in_zone, count(*) FILTER (NOT zone AND coalesce(best >= floor, false)) AS matched, count(*) FILTER (NOT zone AND NOT coalesce(best >= floor, false)) AS unmatched FROM g, f GROUP BY floor)
SELECT floor, recalled, set_aside, missed, in_zone, matched, unmatched, recalled / nullif(recalled + missed, 0) AS recall, matched / nullif(matched + unmatched, 0) AS precision FROM f JOIN x USING (floor) JOIN y USING (floor)"""))
def recall_with_zone(spark, sf_dir):
    d = views(spark, sf_dir)
    d = spatial.with_zone(d, d.filter("source = 'error'"), 0.3)
    return spatial.zoned_match_report(d.filter("source = 'view'"), d.filter("source = 'click'"), [k / 5.0 for k in range(5)], 0.1)


PROTECT = "p AS (SELECT *, [event_id, event_id + 1] AS live, [event_id + 2] AS remembered, [event_id + 3] AS hands FROM k)"


@query(with_detections(f"{KINDS}, {PROTECT} SELECT event_id, list_sum(CASE WHEN kind IN ('text', 'plate', 'screen') THEN list_concat(live, remembered) ELSE hands END)::BIGINT AS zones FROM p"))
def zones_by_kind(spark, sf_dir):
    zone = rules.protects(F.col("kind"), F.array(ident(), ident() + 1), F.array(ident() + 2), F.array(ident() + 3), ["text", "plate", "screen"], True)
    return kinds(spark, sf_dir).select("event_id", F.aggregate(F.coalesce(zone, F.array(ident() + 3)), F.lit(0).cast("long"), lambda s, v: s + v).alias("zones"))


RECT = """r AS (SELECT event_id, clip_id, frame // 36 AS frame, source, x + w / 2 AS cx, y + h / 2 AS cy, w, h, x + w / 4 AS wx, y + h AS wy, x + w / 2 + event_id % 7 * 9 - 27 AS kx, y + event_id % 5 * 7 AS ky FROM det),
t AS (SELECT *, pi() / 2 - atan2(-(ky - wy), kx - wx) AS t0 FROM r), u AS (SELECT *, t0 - 2 * pi() * floor((t0 + pi()) / (2 * pi())) AS t FROM t),
v AS (SELECT *, cx + 0.5 * h * sin(t) AS ox, cy - 0.5 * h * cos(t) AS oy, greatest(w, h) * 1.3 AS half FROM u),
q AS (SELECT event_id, clip_id, frame, source, list_transform([{'p': -1, 'q': -1}, {'p': 1, 'q': -1}, {'p': 1, 'q': 1}, {'p': -1, 'q': 1}], lambda c: {'x': ox + c.p * half * cos(t) - c.q * half * sin(t), 'y': oy + c.p * half * sin(t) + c.q * half * cos(t)}) AS quad FROM v)"""


def _rects(spark, sf_dir):
    (cx, cy), x, y, w, h = centre(), *map(F.col, "xywh")
    quad = rules.hand_rect(cx, cy, w, h, (x + w / 4, y + h), (cx + ident() % 7 * 9 - 27, y + ident() % 5 * 7))
    return views(spark, sf_dir).select("event_id", "clip_id", "frame", "source", quad.alias("quad"))


@query(with_detections(f"{RECT} SELECT event_id, c, round(quad[c].x, 6) AS x, round(quad[c].y, 6) AS y FROM q, range(1, 5) s(c)"))
def hand_rects(spark, sf_dir):
    q = _rects(spark, sf_dir).select("event_id", F.posexplode("quad").alias("c", "p"))
    return q.select("event_id", (F.col("c") + 1).cast("long").alias("c"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def _along(k: int, quad: str, point: str) -> str:
    return f"list_transform({point}, lambda p: p.x * ({quad}[{k % 4 + 1}].y - {quad}[{k}].y) - p.y * ({quad}[{k % 4 + 1}].x - {quad}[{k}].x))"


APART = " OR ".join(f"list_max({_along(k, e, 'a.quad')}) <= list_min({_along(k, e, 'b.quad')}) OR list_max({_along(k, e, 'b.quad')}) <= list_min({_along(k, e, 'a.quad')})" for e in ("a.quad", "b.quad") for k in range(1, 5))


@query(with_detections(f"{RECT} SELECT a.event_id AS a, b.event_id AS b, NOT ({APART}) AS meet FROM q a JOIN q b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.source = 'view' AND b.source = 'error'"))
def quads_meet(spark, sf_dir):
    q = _rects(spark, sf_dir).withColumn("quad", F.flatten(F.transform("quad", lambda p: F.array(p["x"], p["y"]))))
    a, b = renamed(q.filter("source = 'view'"), "a_", "clip_id", "frame"), renamed(q.filter("source = 'error'"), "b_", "clip_id", "frame")
    return dealt(a, "clip_id", "frame").join(b, ["clip_id", "frame"]).select(F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"), meet_column(F.col("a_quad"), F.col("b_quad")).alias("meet"))


MARKS = "CASE WHEN event_id % 3 > 0 THEN [{'x': x + w / 3 + event_id % 40 - 20, 'y': y + h / 3}, {'x': x + w * 2 / 3, 'y': y + h / 3 + event_id % 9}, {'x': x + w / 2, 'y': y + h / 2}, {'x': x + w / 3, 'y': y + h * 3 / 4}, {'x': x + w * 2 / 3, 'y': y + h * 3 / 4}] END"


@query(with_detections(f"""m AS (SELECT *, {MARKS} AS m FROM det), t AS (SELECT *, degrees(atan2(m[2].y - m[1].y, m[2].x - m[1].x)) AS t FROM m)
SELECT event_id, round(CASE WHEN m IS NULL THEN x + w / 2 ELSE (x + w / 2 + list_sum(list_transform(m, lambda p: p.x)) / 5) / 2 END, 8) AS cx, round(CASE WHEN m IS NULL THEN y + h / 2 ELSE (y + h / 2 + list_sum(list_transform(m, lambda p: p.y)) / 5) / 2 END, 8) AS cy,
 round(CASE WHEN m IS NULL THEN 1.2 ELSE 0.9 END * w / 2, 8)::DOUBLE AS a, round(CASE WHEN m IS NULL THEN 1.2 ELSE 1.1 END * h / 2, 8)::DOUBLE AS b, round(CASE WHEN m IS NULL THEN 0 WHEN t > 90 THEN t - 180 WHEN t < -90 THEN t + 180 ELSE t END, 8) AS angle FROM t"""))
def face_ellipses(spark, sf_dir):
    x, y, w, h = map(F.col, "xywh")
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    marks = F.when(ident() % 3 > 0, F.array(p(x + w / 3 + ident() % 40 - 20, y + h / 3), p(x + w * 2 / 3, y + h / 3 + ident() % 9), p(x + w / 2, y + h / 2), p(x + w / 3, y + h * 3 / 4), p(x + w * 2 / 3, y + h * 3 / 4)))
    e = det(spark, sf_dir).withColumn("marks", marks).select("event_id", rules.face_ellipse((x, y, w, h), F.col("marks"), 0.9, 1.1, 0.2).alias("e")).select("event_id", "e.*")
    return rounded(e, 8, "cx", "cy", "a", "b", "angle")


@query(with_detections("s AS (SELECT event_id, w, h, 8 + 4 * 1.6 AS a, 2 * (w + h) * 2.6 AS b FROM det), d AS (SELECT *, (b - sqrt(greatest(0, b * b - 4 * a * 1.6 * w * h))) / (2 * a) AS d FROM s) SELECT event_id, round(greatest(w - 2 * d, 1), 8)::DOUBLE AS w, round(greatest(h - 2 * d, 1), 8)::DOUBLE AS h FROM d"))
def shrink_rects(spark, sf_dir):
    return rounded(det(spark, sf_dir).select("event_id", rules.shrunk(F.col("w"), F.col("h"), 1.6).alias("s")).select("event_id", "s.*"), 8, "w", "h")


POLY = "(1 + t * t * (0.02 + t * t * (-0.003 + t * t * (0.001 + t * t * -0.0002))))"
SLOPE = "(1 + t * t * (3 * 0.02 + t * t * (5 * -0.003 + t * t * (7 * 0.001 + t * t * 9 * -0.0002))))"


@query(with_detections(f"""p AS (SELECT event_id, (x - 800) / 500 AS mx, (y - 650) / 500 AS my FROM det), r AS (SELECT *, sqrt(mx * mx + my * my) AS r FROM p),
n AS (SELECT *, list_reduce(list_concat([r], list_transform(range(50), lambda i: 0.0::DOUBLE)), lambda t, i: t - (t * {POLY} - r) / {SLOPE}) AS t FROM r)
SELECT event_id, round(CASE WHEN r > 1e-15 THEN sin(t) / r ELSE 0 END * mx, 8) AS x, round(CASE WHEN r > 1e-15 THEN sin(t) / r ELSE 0 END * my, 8) AS y, round(cos(t), 8) AS z FROM n"""))
def fisheye_rays(spark, sf_dir):
    ray = rules.unprojected(F.col("x"), F.col("y"), (0.02, -0.003, 0.001, -0.0002), 500.0, (800.0, 650.0))
    return rounded(det(spark, sf_dir).select("event_id", ray.alias("r")).select("event_id", "r.*"), 8, "x", "y", "z")


@query(with_detections("SELECT event_id, round(CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 0 ELSE score * exp(-(((event_id % 50) / 8.0::DOUBLE) ** 2)) END, 12) AS weight FROM det"))
def stereo_weights(spark, sf_dir):
    row, sure = F.when(ident() % 17 != 0, (ident() % 50).cast("double")), F.when(ident() % 13 == 0, F.lit(float("nan"))).otherwise(F.col("score"))
    return det(spark, sf_dir).select("event_id", F.round(rules.stereo_weight(row, sure), 12).alias("weight"))


UNION = """p AS (SELECT a.event_id, any_value(a.w * a.h) AS area, list({{'x': greatest(a.x, b.x), 'y': greatest(a.y, b.y), 'r': least(a.x + a.w, b.x + b.w), 'b': least(a.y + a.h, b.y + b.h)}}) FILTER (b.x IS NOT NULL AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)) AS parts
 FROM {a} a LEFT JOIN {b} b ON {on} GROUP BY a.event_id),
e AS (SELECT event_id, area, parts, list_sort(list_distinct(list_concat(list_transform(parts, lambda p: p.x), list_transform(parts, lambda p: p.r)))) AS e FROM p WHERE parts IS NOT NULL),
s AS (SELECT event_id, e[i] AS l, e[i + 1] AS r, parts FROM e, LATERAL (SELECT unnest(range(1, len(e))) AS i)),
y AS (SELECT event_id, l, r, unnest(list_transform(list_filter(parts, lambda p: p.x <= l AND p.r >= r), lambda p: {{'a': p.y, 'b': p.b}})) AS y FROM s),
c AS (SELECT event_id, l, r, y.a AS a, y.b AS b, max(y.b) OVER (PARTITION BY event_id, l ORDER BY y.a, y.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y),
cover AS (SELECT event_id, sum((r - l) * greatest(0, b - greatest(a, coalesce(reach, a)))) AS covered FROM c GROUP BY event_id)"""


@query(with_detections(f"{VIEWS}, v AS (SELECT * FROM d WHERE source = 'view'), z AS (SELECT * FROM d WHERE source <> 'view'), {UNION.format(a='v', b='z', on='a.clip_id = b.clip_id AND a.frame = b.frame')} SELECT p.event_id, round(coalesce(covered, 0) / area, 9) AS share, coalesce(covered, 0) / area >= 0.5 AS zone FROM p LEFT JOIN cover USING (event_id)"))
def zones_cover(spark, sf_dir):
    d = views(spark, sf_dir)
    c = spatial.covered_by_union(d.filter("source = 'view'"), d.filter("source <> 'view'"), ["clip_id", "frame"], "event_id")
    return c.select("event_id", F.round("share", 9).alias("share"), (F.col("share") >= 0.5).alias("zone"))


CORRIDOR = f"""{CAMERA_SQL}, hd AS (SELECT clip_id, frame, x, y, w, h FROM det WHERE source = 'signup'), b AS (SELECT * FROM det WHERE source = 'view'),
l AS (SELECT b.event_id, b.clip_id, b.frame, b.x + b.w / 2 AS cx, b.y + b.h / 2 AS cy, (SELECT max(frame) FROM hd WHERE hd.clip_id = b.clip_id AND hd.frame <= b.frame) AS seen FROM b),
q AS (SELECT l.event_id, l.cx, l.cy, hd.x + hd.w / 2 + n.px - o.px AS hx, hd.y + hd.h / 2 + w / 16 + n.py - o.py AS hy, 0::DOUBLE AS vx, 1::DOUBLE AS vy, hd.w, hd.h
 FROM l JOIN hd ON hd.clip_id = l.clip_id AND hd.frame = l.seen JOIN path o ON o.clip_id = l.clip_id AND o.frame = l.seen JOIN path n ON n.clip_id = l.clip_id AND n.frame = l.frame WHERE l.frame - l.seen <= 40)
SELECT event_id FROM b WHERE event_id NOT IN (SELECT event_id FROM q WHERE cy >= hy AND cy <= greatest(hy, 1300) AND abs(cx - hx) <= 3 * sqrt(w * w + (w / 8) ** 2) / 2)"""


@query(with_detections(CORRIDOR))
def off_the_arm(spark, sf_dir):
    d = det(spark, sf_dir).withColumn("quad", corners())
    return hands.off_arm(d.filter("source = 'view'"), d.filter("source = 'signup'"), camera(spark, sf_dir), 1600, 1300, 3.0, 40).select("event_id")


HEAD = "g AS (SELECT * REPLACE (frame // 36 AS frame) FROM det), a AS (SELECT * FROM g WHERE source = 'view'), s AS (SELECT * FROM g WHERE source = 'signup')"
HAND = "[{'x': b.x, 'y': b.y}, {'x': b.x + b.w, 'y': b.y + b.w / 8}, {'x': b.x + b.w, 'y': b.y + b.h + b.w / 8}, {'x': b.x, 'y': b.y + b.h}]"
INSIDE = " AND ".join(f"(c[{j}].x - c[{i}].x) * (py - c[{i}].y) - (c[{j}].y - c[{i}].y) * (px - c[{i}].x) >= 0" for i, j in ((1, 2), (2, 3), (3, 4), (4, 1)))


@query(with_detections(f"""{HEAD}, p AS (SELECT a.event_id, a.x + a.w / 2 AS px, a.y + a.h * 0.125 AS py, {HAND} AS c, {IOU_SQL.replace("b.h", "(b.h + b.w / 8)")} AS share FROM a JOIN s b ON a.clip_id = b.clip_id AND a.frame = b.frame)
SELECT event_id FROM a WHERE event_id NOT IN (SELECT event_id FROM p WHERE share >= 0.2 OR ({INSIDE}))"""))
def heads_off_hands(spark, sf_dir):
    g = views(spark, sf_dir)
    return hands.heads_off_hands(g.filter("source = 'view'"), g.filter("source = 'signup'").withColumn("quad", corners()), 0.2, 0.125).select("event_id")
