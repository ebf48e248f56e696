"""Ordered operators over the driver's events, most with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, stateful, suppression
from .registry import CAMERA_SQL, IOU_SQL, camera, detections, events, fold_sql, iou_sql, query, rounded, with_detections

RECURSIVE = ("WITH det", "WITH RECURSIVE det")
PLAIN = "{'x': x, 'y': y, 'w': w, 'h': h, 'event_id': event_id}"


def recursive(sql: str) -> str:
    return with_detections(sql).replace(*RECURSIVE)


@query(recursive(f"{fold_sql('det', 'clip_id, frame', 'score DESC, event_id', PLAIN, IOU_SQL + ' > 0.1')} SELECT u.clip_id, u.frame, event_id, det.x, det.y, det.w, det.h, score FROM u JOIN det ON event_id = u.b.event_id"))
def nms_kept(spark, sf_dir):
    return suppression.suppress(detections(spark, sf_dir), ["clip_id", "frame"], "event_id", 0.1)


#: Six hours of frames as one, so that boxes of a user meet.
COARSE = "coarse AS (SELECT * REPLACE (frame // 36 AS frame) FROM det)"


def coarse(spark, sf_dir, by: int = 36):
    return detections(spark, sf_dir).withColumn("frame", F.floor(F.col("frame") / by))


MARKS = "{'x': x, 'y': y, 'w': w, 'h': h, 'event_id': event_id, 'marks': CASE WHEN event_id % 3 = 0 THEN event_id END, 'sure': event_id % 4 = 0}"
ADOPT = "{'x': a.x, 'y': a.y, 'w': a.w, 'h': a.h, 'event_id': a.event_id, 'marks': coalesce(a.marks, b.marks), 'sure': a.sure OR b.sure}"


@query(recursive(f"{COARSE}, {fold_sql('coarse', 'clip_id, frame', 'score DESC, event_id', MARKS, IOU_SQL + ' > 0.3', adopt=ADOPT)} SELECT clip_id, frame, b.event_id, b.marks, b.sure FROM u"))
def nms_adopting(spark, sf_dir):
    d = coarse(spark, sf_dir).withColumns({"marks": F.when(F.col("event_id") % 3 == 0, F.col("event_id")), "sure": F.col("event_id") % 4 == 0})
    kept = suppression.suppress(d, ["clip_id", "frame"], "event_id", 0.3, columns=("x", "y", "w", "h", "marks", "sure"), adopt={"marks": "coalesce(a.marks, b.marks)", "sure": "a.sure OR b.sure"})
    return kept.select("clip_id", "frame", "event_id", "marks", "sure")


SCALES = "two AS (SELECT clip_id, frame, event_id * 2 AS event_id, x, y, w, h, score FROM coarse WHERE event_id % 2 = 0 UNION ALL SELECT clip_id, frame, event_id * 2 + 1, x + 3, y - 2, w * 1.1, h * 1.1, score FROM coarse WHERE event_id % 3 = 0)"


@query(recursive(f"{COARSE}, {SCALES}, {fold_sql('two', 'clip_id, frame', 'score DESC, event_id DESC', PLAIN, IOU_SQL + ' > 0.4')} SELECT clip_id, frame, b.event_id FROM u"))
def nms_of_scales(spark, sf_dir):
    d = coarse(spark, sf_dir).select("clip_id", "frame", "event_id", "x", "y", "w", "h", "score")
    larger = d.filter("event_id % 3 = 0").withColumns({"event_id": F.col("event_id") * 2 + 1, "x": F.col("x") + 3, "y": F.col("y") - 2, "w": F.col("w") * 1.1, "h": F.col("h") * 1.1})
    both = d.filter("event_id % 2 = 0").withColumn("event_id", F.col("event_id") * 2).unionByName(larger)
    return suppression.suppress(both, ["clip_id", "frame"], "event_id", 0.4, last_first=True).select("clip_id", "frame", "event_id")


JOINTS = "{'event_id': event_id, 'joints': list_transform(range(21), lambda k: {'x': x + 4 * k * (1 + event_id % 3 / 10), 'y': y + 3 * k})}"
NEAR = "len(list_filter(list_zip(a.joints, b.joints), lambda p: sqrt((p[1].x - p[2].x) ** 2 + (p[1].y - p[2].y) ** 2) <= 10)) >= 11"


@query(recursive(f"{COARSE}, {fold_sql('coarse', 'clip_id, frame', 'score DESC, event_id', JOINTS, NEAR)} SELECT u.clip_id, u.frame, b.event_id, score FROM u JOIN det ON event_id = u.b.event_id"))
def hands_once(spark, sf_dir):
    at = lambda k: F.struct((F.col("x") + 4 * k * (1 + F.col("event_id") % 3 / 10)).alias("x"), (F.col("y") + 3 * k).alias("y"))
    d = coarse(spark, sf_dir).withColumn("joints", F.transform(F.sequence(F.lit(0), F.lit(20)), at))
    return suppression.one_per_hand(d, ["clip_id", "frame"], "event_id")


HELD = "held AS (SELECT clip_id, k AS frame, source, event_id, x, y, w, h FROM coarse c, LATERAL (SELECT unnest(range(c.frame, c.frame + 3)) AS k))"
WITH_SOURCE = "{'x': x, 'y': y, 'w': w, 'h': h, 'event_id': event_id, 'source': source}"


@query(recursive(f"{COARSE}, {HELD}, {fold_sql('held', 'clip_id, frame', 'event_id', WITH_SOURCE, 'a.source = b.source AND ' + IOU_SQL + ' >= 0.2')} SELECT clip_id, frame, b.event_id, b.source FROM u"))
def one_box_per_place(spark, sf_dir):
    d = coarse(spark, sf_dir).withColumn("frame", F.explode(F.sequence(F.col("frame"), F.col("frame") + 2)))
    return suppression.one_per_place(d, ["clip_id", "frame"], [F.col("event_id")], ["event_id", "source", "x", "y", "w", "h"], 0.2).select("clip_id", "frame", "event_id", "source")


RUN = "{'f': s.frame, 'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h}"
SHARES = f"list_transform(r.ends, lambda a: CASE WHEN s.frame - a.f <= 61 AND {iou_sql('a', 's')} >= 0.1 THEN {iou_sql('a', 's')} ELSE 0 END)"
LINKED = f"""s AS (SELECT *, row_number() OVER (PARTITION BY clip_id, source ORDER BY frame, event_id) AS k FROM det),
r AS (SELECT clip_id, source, k, event_id, 0::BIGINT AS run, [{RUN}] AS ends FROM s WHERE k = 1 UNION ALL SELECT clip_id, source, k, event_id, hit - 1,
 CASE WHEN hit > len(ends) THEN list_append(ends, now) ELSE list_transform(ends, lambda a, i: CASE WHEN i = hit THEN now ELSE a END) END
 FROM (SELECT r.clip_id, r.source, s.k, s.event_id, r.ends, {RUN} AS now, CASE WHEN list_max({SHARES}) > 0 THEN list_position({SHARES}, list_max({SHARES})) ELSE len(r.ends) + 1 END AS hit FROM r JOIN s ON s.clip_id = r.clip_id AND s.source = r.source AND s.k = r.k + 1)),
linked AS (SELECT det.*, r.run FROM r JOIN det USING (event_id))"""


def _linked(spark, sf_dir):
    d = detections(spark, sf_dir).select("clip_id", "source", "frame", "event_id", "x", "y", "w", "h")
    return stateful.link_runs(d, ["clip_id", "source"], 60, 0.1)


@query(recursive(f"{LINKED} SELECT clip_id, source, frame, event_id, x, y, w, h, run FROM linked"))
def linked_runs(spark, sf_dir):
    return _linked(spark, sf_dir)


@query(recursive(f"""{LINKED} SELECT clip_id, source, run, min(frame) AS first, max(frame) AS last, count(*) AS hits, max(greatest(w, h)) AS max_px, arg_max(x + w / 2, (frame, event_id)) AS x, arg_max(y + h / 2, (frame, event_id)) AS y FROM linked GROUP BY clip_id, source, run"""))
def run_report_linked(spark, sf_dir):
    last = F.max_by(F.struct((F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y")), F.struct("frame", "event_id"))
    r = _linked(spark, sf_dir).groupBy("clip_id", "source", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("hits"), F.max(F.greatest("w", "h")).alias("max_px"), last.alias("c"))
    return r.select("clip_id", "source", "run", "first", "last", "hits", "max_px", "c.x", "c.y")


#: Hourly means of values by twenty keys; hours without an event are missing.
HOURS = """h AS (SELECT user_id % 20 AS k, epoch_us(ts) // 3600000000 - 473352 AS hour, avg(value) AS v FROM events GROUP BY ALL),
d AS (SELECT k, hour FROM (SELECT k, min(hour) AS a, max(hour) AS b FROM h GROUP BY k), LATERAL (SELECT unnest(range(a, b + 1)) AS hour)),
z AS (SELECT d.k, d.hour, v, 400 + 100 * (d.hour % 3)::DOUBLE AS r, row_number() OVER (PARTITION BY d.k ORDER BY d.hour) AS n FROM d LEFT JOIN h USING (k, hour))"""
FORWARD = """f AS (SELECT k, n, hour, v, v AS x, 0::DOUBLE AS s, r AS p, 0::DOUBLE AS c, 1::DOUBLE AS q, 0 AS bad, 0::DOUBLE AS gx, 0::DOUBLE AS gs, 0::DOUBLE AS gp, 0::DOUBLE AS gc, 0::DOUBLE AS gq FROM z WHERE n = 1
UNION ALL SELECT k, n, hour, v, CASE WHEN ok THEN gx + gp / w * o ELSE gx END, CASE WHEN ok THEN gs + gc / w * o ELSE gs END, CASE WHEN ok THEN gp * (1 - gp / w) ELSE gp END, CASE WHEN ok THEN gc * (1 - gp / w) ELSE gc END, CASE WHEN ok THEN gq - gc * gc / w ELSE gq END,
 CASE WHEN v IS NULL OR ok THEN 0 ELSE bad + 1 END, gx, gs, gp, gc, gq
 FROM (SELECT *, v IS NOT NULL AND (abs(v - gx) <= 4 * sqrt(gp + r) OR bad >= 2) AS ok, v - gx AS o, gp + r AS w FROM
  (SELECT f.k, z.n, z.hour, z.v, z.r, f.bad, f.x + f.s AS gx, f.s AS gs, f.p + 2 * f.c + f.q + 0.25 * 4 AS gp, f.c + f.q + 0.5 * 4 AS gc, f.q + 4 AS gq FROM f JOIN z ON z.k = f.k AND z.n = f.n + 1)))"""
BACKWARD = """b AS (SELECT k, n, hour, v, x AS bx, s AS bs FROM f WHERE (k, n) IN (SELECT k, max(n) FROM f GROUP BY k)
UNION ALL SELECT f.k, f.n, f.hour, f.v, f.x + (f.p + f.c) * ((g.gq * (b.bx - g.gx) - g.gc * (b.bs - g.gs)) / (g.gp * g.gq - g.gc * g.gc)) + f.c * ((g.gp * (b.bs - g.gs) - g.gc * (b.bx - g.gx)) / (g.gp * g.gq - g.gc * g.gc)),
 f.s + (f.c + f.q) * ((g.gq * (b.bx - g.gx) - g.gc * (b.bs - g.gs)) / (g.gp * g.gq - g.gc * g.gc)) + f.q * ((g.gp * (b.bs - g.gs) - g.gc * (b.bx - g.gx)) / (g.gp * g.gq - g.gc * g.gc))
 FROM b JOIN f ON f.k = b.k AND f.n = b.n - 1 JOIN f g ON g.k = b.k AND g.n = b.n)"""


@query(f"WITH RECURSIVE {HOURS}, {FORWARD}, {BACKWARD} SELECT k, hour, round(v, 6) AS v, round(bx, 6) AS smooth FROM b")
def kalman_smooth(spark, sf_dir):
    h = events(spark, sf_dir).groupBy((F.col("user_id") % 20).alias("k"), (F.floor(F.col("us") / 3_600_000_000) - 473352).alias("hour")).agg(F.avg("value").alias("v"))
    every = h.groupBy("k").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select("k", F.explode(F.sequence("a", "b")).alias("hour"))
    z = every.join(h, ["k", "hour"], "left").withColumn("r", (400 + 100 * (F.col("hour") % 3)).cast("double"))
    return rounded(stateful.smoothed(z, ["k"], "hour", "v", "r", 1.0, 4.0), 6, "v", "smooth")


ZONES = f"""{CAMERA_SQL}, live AS (SELECT clip_id, frame, list({{'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY event_id) AS live FROM (SELECT * REPLACE (frame // 6 AS frame) FROM det WHERE score >= 0.5) GROUP BY ALL),
t AS (SELECT c.clip_id, c.frame, c.dx, c.dy, coalesce(live, []) AS live FROM cam c LEFT JOIN live USING (clip_id, frame) WHERE c.frame <= (SELECT max(frame) FROM live l WHERE l.clip_id = c.clip_id))"""
MEET = "(least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y))"
SEEN = f"list_filter(m, lambda a: len(list_filter(live, lambda b: {MEET})) = 0)"
#: What is remembered after a frame: each seen zone takes the place of the first remembered one that it meets.
TAKE = f"""list_reduce(list_prepend({{'kept': m, 'b': NULL::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)}}, list_transform(live, lambda b: {{'kept': []::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, e BIGINT)[], 'b': b}})),
 lambda p, q: {{'kept': CASE WHEN list_position(list_transform(p.kept, lambda a: {MEET.replace('b.', 'q.b.')}), true) IS NULL THEN list_append(p.kept, {{'x': q.b.x, 'y': q.b.y, 'w': q.b.w, 'h': q.b.h, 'e': frame + 12}})
  ELSE list_transform(p.kept, lambda a, i: CASE WHEN i = list_position(list_transform(p.kept, lambda a: {MEET.replace('b.', 'q.b.')}), true) THEN {{'x': q.b.x, 'y': q.b.y, 'w': q.b.w, 'h': q.b.h, 'e': frame + 12}} ELSE a END) END, 'b': q.b}}).kept"""
REMEMBERED = f"""r AS (SELECT clip_id, frame, live, m FROM (SELECT clip_id, frame, live, {TAKE} AS m FROM (SELECT t.*, []::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, e BIGINT)[] AS m FROM t WHERE frame = 0))
UNION ALL SELECT clip_id, frame, live, {TAKE} FROM (SELECT t.clip_id, t.frame, t.live, list_filter(list_transform(r.m, lambda a: {{'x': a.x + t.dx, 'y': a.y + t.dy, 'w': a.w, 'h': a.h, 'e': a.e}}), lambda a: a.e > t.frame AND a.x + a.w > 0 AND a.y + a.h > 0 AND a.x < 1600 AND a.y < 1300) AS m
 FROM r JOIN t ON t.clip_id = r.clip_id AND t.frame = r.frame + 1)), o AS (SELECT clip_id, frame, live, {SEEN} AS m FROM r)"""


@query(recursive(f"{ZONES}, {REMEMBERED} SELECT clip_id, frame, len(live) AS live, len(m) AS remembered, coalesce(list_sum(list_transform(m, lambda a: a.w * a.h)), 0) AS area, coalesce(list_sum(list_transform(m, lambda a: a.x)), 0) AS left_edges FROM o"))
def zone_memory(spark, sf_dir):
    d = coarse(spark, sf_dir, 6).filter("score >= 0.5").select("clip_id", "frame", "event_id", "x", "y", "w", "h")
    return stateful.zone_memory(d, camera(spark, sf_dir).filter("frame < 720").select("clip_id", "frame", "dx", "dy"), "clip_id", 12, size=(1600, 1300))


STRIDE = f"""{CAMERA_SQL}, t AS (SELECT c.clip_id, c.frame, coalesce(b.busy, false) AS busy, CASE WHEN dx <> 0 OR dy <> 0 THEN sqrt(dx * dx + dy * dy) END AS move FROM cam c LEFT JOIN (SELECT clip_id, frame, bool_or(score > 0.9) AS busy FROM det GROUP BY ALL) b USING (clip_id, frame)),
r AS (SELECT clip_id, frame, true AS look, CASE WHEN busy THEN 0 ELSE 1 END AS calm, 0 AS since FROM t WHERE frame = 0
UNION ALL SELECT clip_id, frame, NOT skip, CASE WHEN skip THEN calm WHEN busy THEN 0 ELSE calm + 1 END, CASE WHEN skip THEN since + 1 ELSE 0 END
 FROM (SELECT t.clip_id, t.frame, t.busy, r.calm, r.since, r.calm >= 3 AND r.since < 3 AND t.move IS NOT NULL AND t.move < 2 AS skip FROM r JOIN t ON t.clip_id = r.clip_id AND t.frame = r.frame + 1))"""


@query(recursive(f"{STRIDE} SELECT clip_id, frame, look FROM r"))
def adaptive_stride(spark, sf_dir):
    busy = detections(spark, sf_dir).groupBy("clip_id", "frame").agg((F.max("score") > 0.9).alias("busy"))
    f = camera(spark, sf_dir).join(busy, ["clip_id", "frame"], "left").withColumn("busy", F.coalesce("busy", F.lit(False)))
    return stateful.adaptive_stride(f, "clip_id", "frame", "busy", "dx", "dy", 3, 4, 2.0)


@query()
def clock_fit_iterated(spark, sf_dir):
    """Frames are all events of a key, rows the same instants on a clock that runs fast and starts late, less every ninth."""
    e = events(spark, sf_dir).select((F.col("user_id") % 5).alias("k"), (F.col("us") - 1704067200000000).alias("t"))
    rows = e.filter("t % 9 <> 0").withColumn("t", F.col("t") + F.floor(F.col("t") / 50_000_000) + 900)
    return asof.fit_clock(e, rows, "k", "t", 400_000)


LEFT, RIGHT = ("(SELECT clip_id, frame, event_id, x + w / 2 AS cx, y + event_id % 997 / 1000.0::DOUBLE + h / 2 AS cy, row_number() OVER (PARTITION BY clip_id, frame ORDER BY event_id) AS n, count(*) OVER (PARTITION BY clip_id, frame) AS cnt FROM (SELECT * REPLACE (frame // 12 AS frame) FROM det) WHERE source = 'SIDE' QUALIFY n <= 2)".replace('SIDE', s) for s in ("view", "click"))


@query(with_detections(f"""a AS {LEFT}, b AS {RIGHT},
p AS (SELECT a.clip_id, a.frame, a.n AS i, b.n AS j, least(a.cnt, 2) AS na, least(b.cnt, 2) AS nb, a.event_id AS left_id, b.event_id AS right_id, CASE WHEN a.cx - b.cx BETWEEN -900 AND 900 THEN abs(a.cy - b.cy) ELSE 1e9 END AS cost FROM a JOIN b ON a.clip_id = b.clip_id AND a.frame = b.frame),
g AS (SELECT clip_id, frame, least(any_value(na), any_value(nb)) AS pairs, CASE WHEN any_value(na) = 2 AND any_value(nb) = 2 THEN least(sum(CASE WHEN i = j THEN cost END), sum(CASE WHEN i <> j THEN cost END)) ELSE min(cost) END AS cost FROM p GROUP BY clip_id, frame)
SELECT clip_id, frame, pairs, round(cost, 5) AS cost FROM g"""))
def two_view_matches(spark, sf_dir):
    """Pairs of each frame and their total cost: of matchings that cost the same, as distances on a line often do, any is best."""
    from pyspark.sql.window import Window

    d = coarse(spark, sf_dir, 12).withColumn("y", F.col("y") + F.col("event_id") % 997 / 1000.0)
    first = d.withColumn("n", F.row_number().over(Window.partitionBy("clip_id", "frame", "source").orderBy("event_id"))).filter("n <= 2")
    found = stateful.matched_views(first.filter("source = 'view'"), first.filter("source = 'click'"), ["clip_id", "frame"], 1e10, (-900.0, 900.0))
    return found.groupBy("clip_id", "frame").agg(F.count("*").alias("pairs"), F.round(F.sum("cost"), 5).alias("cost"))


@query()
def hand_identity(spark, sf_dir):
    from pyspark.sql.window import Window

    d = coarse(spark, sf_dir, 6).withColumn("n", F.row_number().over(Window.partitionBy("clip_id", "frame").orderBy("event_id"))).filter("n <= 2")
    d = d.select("clip_id", "frame", "event_id", (F.col("x") / 1000).alias("px"), (F.col("y") / 1000).alias("py"), F.col("score").alias("pz"), (F.when(F.col("event_id") % 2 == 0, F.col("score")).otherwise(-F.col("score"))).alias("vote"))
    return stateful.hand_names(d, "clip_id")
