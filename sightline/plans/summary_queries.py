"""Evaluation reports, deliveries, ledgers and hand reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import bucket, long_side
from ..functions.rules import spread_places
from ..operators import evaluation, hands, intervals
from .registry import CAMERA_SQL, camera, detections, events, load, query, rounded, with_detections
from .rule_queries import KINDS, UNION, kinds


def ident():
    return F.col("event_id")

SIDE = "greatest(w, h)"


@query(with_detections(f"{KINDS} SELECT clip_id, coalesce(kind, 'face') AS kind, event_id FROM k QUALIFY row_number() OVER (PARTITION BY clip_id, coalesce(kind, 'face') ORDER BY frame, {SIDE} DESC, event_id) <= 20"))
def residual_rows(spark, sf_dir):
    r = kinds(spark, sf_dir).withColumn("kind", F.coalesce("kind", F.lit("face")))
    return evaluation.top_per(r, ["clip_id", "kind"], 20, F.col("frame"), -long_side(), ident()).select("clip_id", "kind", "event_id")


@query(with_detections(f"""{KINDS}, f AS (SELECT * FROM k WHERE coalesce(kind, 'face') = 'face' AND hand IS NULL AND zone IS NULL)
SELECT clip_id, count(*) AS faces, count(DISTINCT frame) AS frames, coalesce(max({SIDE}), 0) AS max_px, count(*) FILTER ({SIDE} >= 140) AS large, count(*) FILTER ({SIDE} >= 80 AND {SIDE} < 140) AS middle, count(*) FILTER ({SIDE} < 80) AS small FROM f GROUP BY clip_id"""))
def residual_faces(spark, sf_dir):
    f = kinds(spark, sf_dir).filter("coalesce(kind, 'face') = 'face' AND hand IS NULL AND zone IS NULL")
    side, size = long_side(), lambda lo, hi: F.count_if((long_side() >= lo) & (long_side() < hi))
    return f.groupBy("clip_id").agg(F.count("*").alias("faces"), F.count_distinct("frame").alias("frames"), F.coalesce(F.max(side), F.lit(0.0)).alias("max_px"), size(140, 1e9).alias("large"), size(80, 140).alias("middle"), size(0, 80).alias("small"))


@query(with_detections(f"{KINDS} SELECT clip_id, coalesce(kind, 'face') AS kind, count(*) FILTER (score < 0.1) AS flat FROM k GROUP BY ALL UNION ALL SELECT clip_id, 'all', count(*) FILTER (score < 0.1) FROM k GROUP BY clip_id"))
def flat_by_kind(spark, sf_dir):
    r = kinds(spark, sf_dir).withColumn("kind", F.coalesce("kind", F.lit("face")))
    by = r.groupBy("clip_id", "kind").agg(F.count_if(F.col("score") < 0.1).alias("flat"))
    return by.unionByName(by.groupBy("clip_id").agg(F.sum("flat").alias("flat")).withColumn("kind", F.lit("all")))


@query(with_detections("z AS (SELECT clip_id, frame, max(score) AS changed FROM det WHERE source = 'error' GROUP BY ALL) SELECT clip_id, frame, changed FROM z WHERE changed > 0.5 QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY changed DESC, frame) <= 50"))
def zone_rows(spark, sf_dir):
    z = detections(spark, sf_dir).filter("source = 'error'").groupBy("clip_id", "frame").agg(F.max("score").alias("changed")).filter("changed > 0.5")
    return evaluation.top_per(z, ["clip_id"], 50, F.desc("changed"), F.col("frame"))


GATES = f"""{KINDS}, h AS (SELECT DISTINCT clip_id, kind, frame // 36 AS f FROM k WHERE kind IS NOT NULL AND kind <> 'face' AND {SIDE} >= 60 AND zone IS NULL),
i AS (SELECT *, f - row_number() OVER (PARTITION BY clip_id, kind ORDER BY f) AS g FROM h), longest AS (SELECT clip_id, kind, max(n) AS n FROM (SELECT clip_id, kind, g, count(*) AS n FROM i GROUP BY ALL) GROUP BY clip_id, kind),
c AS (SELECT clip_id, count(*) FILTER (zone IS NOT NULL AND score > 0.9) AS n_over, max(CASE WHEN coalesce(kind, 'face') = 'face' AND hand IS NULL AND zone IS NULL THEN {SIDE} END) AS face FROM k GROUP BY clip_id)"""
LONG = lambda kind, n: f"CASE WHEN (SELECT n FROM longest l WHERE l.clip_id = c.clip_id AND l.kind = '{kind}') >= {n} THEN '{kind}' END"


@query(with_detections(f"{GATES} SELECT clip_id, concat_ws(',', CASE WHEN n_over > 1 THEN 'zone' END, CASE WHEN face >= 100 THEN 'face' END, {LONG('text', 4)}, {LONG('plate', 4)}, {LONG('screen', 5)}) AS held_for FROM c"))
def hold_gate_kinds(spark, sf_dir):
    k = kinds(spark, sf_dir)
    seen = k.filter((F.col("kind") != "face") & (long_side() >= 60) & F.col("zone").isNull()).withColumn("f", F.floor(F.col("frame") / 36))
    runs = intervals.flag_runs(seen, ["clip_id", "kind"], "f", F.lit(True)).groupBy("clip_id", "kind").agg(F.max("hits").alias("n"))
    runs = runs.groupBy("clip_id").agg(*(F.max(F.when(F.col("kind") == x, F.col("n"))).alias(x) for x in ("text", "plate", "screen")))
    face = (F.coalesce("kind", F.lit("face")) == "face") & F.col("hand").isNull() & F.col("zone").isNull()
    c = k.groupBy("clip_id").agg(F.count_if(F.col("zone").isNotNull() & (F.col("score") > 0.9)).alias("over"), F.max(F.when(face, long_side())).alias("face")).join(runs, "clip_id", "left")
    gates = {"zone": F.col("over") > 1, "face": F.col("face") >= 100, "text": F.col("text") >= 4, "plate": F.col("plate") >= 4, "screen": F.col("screen") >= 5}
    return c.select("clip_id", F.concat_ws(",", *(F.when(test, F.lit(name)) for name, test in gates.items())).alias("held_for"))


SHARES = "s AS (SELECT clip_id, frame, sum(w * h) / (1600 * 1300) AS share FROM det GROUP BY clip_id, frame)"


def _shares(spark, sf_dir, *by):
    return detections(spark, sf_dir).groupBy("clip_id", "frame", *by).agg((F.sum(F.col("w") * F.col("h")) / (1600 * 1300)).alias("share"))


@query(with_detections(f"{SHARES}, o AS (SELECT * FROM s WHERE share > 0.012), f AS (SELECT clip_id, list(frame ORDER BY frame) AS f FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY frame) <= 30) GROUP BY clip_id) SELECT s.clip_id, count(*) FILTER (share > 0.012) AS \"over\", array_to_string(coalesce(any_value(f), []), ',') AS first FROM s LEFT JOIN f USING (clip_id) GROUP BY s.clip_id"))
def frames_over_budget(spark, sf_dir):
    return evaluation.flagged(_shares(spark, sf_dir), ["clip_id"], "frame", "share", 0.012, 30).withColumn("first", F.concat_ws(",", F.transform("first", lambda x: x.cast("string"))))


@query(with_detections("s AS (SELECT clip_id, frame, source, sum(w * h) / (1600 * 1300) AS share FROM det GROUP BY ALL) SELECT clip_id, source, round(avg(share), 12) AS mean, max(share) AS max, count(*) FILTER (share > 0.01) AS \"over\" FROM s GROUP BY clip_id, source"))
def mask_share_by_kind(spark, sf_dir):
    s = _shares(spark, sf_dir, "source").groupBy("clip_id", "source")
    return s.agg(F.round(F.avg("share"), 12).alias("mean"), F.max("share").alias("max"), F.count_if(F.col("share") > 0.01).alias("over"))


AREA = UNION.format(a="f", b="g", on="a.event_id = b.clip_id * 10000000 + b.frame * 10 + b.n")


@query(with_detections(f"""cc AS (SELECT *, frame // 36 AS fr, CASE source WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS n FROM det), g AS (SELECT clip_id, fr AS frame, n, x, y, w, h FROM cc), f AS (SELECT DISTINCT clip_id * 10000000 + fr * 10 + n AS event_id, 0::DOUBLE AS x, 0::DOUBLE AS y, 1600::DOUBLE AS w, 1300::DOUBLE AS h FROM cc), {AREA}
SELECT p.event_id // 10000000 AS clip_id, p.event_id % 10000000 // 10 AS frame, p.event_id % 10 AS kind, round(coalesce(covered, 0) / area, 9) AS share FROM p LEFT JOIN cover USING (event_id)"""))
def masked_area_by_kind(spark, sf_dir):
    s = F.col("source")
    d = detections(spark, sf_dir).withColumns({"frame": F.floor(F.col("frame") / 36), "kind": F.when(s == "view", 0).when(s == "click", 1).otherwise(2).cast("long")})
    return rounded(evaluation.covered_picture(d, ["clip_id", "frame", "kind"], 1600, 1300), 9, "share")


@query(with_detections("z AS (SELECT clip_id, frame, count(*) FILTER (score >= 0.5) AS live, least(sum(CASE WHEN score >= 0.5 THEN w * h ELSE 0 END) / (1600 * 1300), 1) AS share FROM det GROUP BY ALL) SELECT clip_id, count(*) FILTER (live > 0) AS frames, round(avg(share), 9)::DOUBLE AS mean, max(share)::DOUBLE AS max, round(avg(live), 9) AS hands FROM z GROUP BY clip_id"))
def zone_stats(spark, sf_dir):
    live = F.col("score") >= 0.5
    z = detections(spark, sf_dir).groupBy("clip_id", "frame").agg(F.count_if(live).alias("live"), F.least(F.sum(F.when(live, F.col("w") * F.col("h")).otherwise(0.0)) / (1600 * 1300), F.lit(1.0)).alias("share"))
    return z.groupBy("clip_id").agg(F.count_if(F.col("live") > 0).alias("frames"), F.round(F.avg("share"), 9).alias("mean"), F.max("share").alias("max"), F.round(F.avg("live"), 9).alias("hands"))


@query(with_detections("b AS (SELECT CASE WHEN greatest(w, h) < 64 THEN 'small' WHEN greatest(w, h) < 128 THEN 'middle' ELSE 'large' END AS size, score >= 0.5 AS hit, score FROM det) SELECT CASE WHEN grouping(size) = 1 THEN 'all' ELSE size END AS size, count(*) FILTER (hit) AS hit, count(*) AS total, count(*) FILTER (hit) / count(*) AS recall, round(quantile_cont(score, 0.95), 9) AS p95 FROM b GROUP BY ROLLUP (size)"))
def recall_by_size(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("size", bucket(long_side(), [64, 128], ["small", "middle", "large"]))
    hit = F.count_if(F.col("score") >= 0.5)
    return evaluation.with_total(d, "size", [hit.alias("hit"), F.count("*").alias("total"), (hit / F.count("*")).alias("recall"), F.round(F.percentile("score", F.lit(0.95)), 9).alias("p95")])


@query("""WITH t AS (SELECT o_orderkey, any_value(o_totalprice) AS total, count(*) AS n, sum(l_quantity) AS q, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
b AS (SELECT o_orderkey, n <= 6 AS a, q >= 30 AS b, v >= 30000 AS c FROM t), c AS (SELECT o_orderkey, unnest(['lines', 'quantity', 'value']) AS "check", unnest([a, b, CASE WHEN a AND b THEN c END]) AS ok, a AND b AND c AS passed FROM b) SELECT * FROM c""")
def check_suite_skipping(spark, sf_dir):
    o, l = load(spark, sf_dir, "orders").select("o_orderkey"), load(spark, sf_dir, "lineitem")  # noqa: E741
    q = F.sum("l_quantity")
    t = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"), q.alias("q"), (F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / q).alias("v"))
    return evaluation.ordered_checks(t, ["o_orderkey"], {"lines": F.col("n") <= 6, "quantity": F.col("q") >= 30, "value": F.col("v") >= 30000}, "value")


@query("""WITH h AS (SELECT DISTINCT user_id % 20 AS k, epoch_us(ts) // 3600000000 AS pos FROM events WHERE value >= 40), i AS (SELECT *, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS g FROM h),
r AS (SELECT k, min(pos) AS first, max(pos) + 1 AS "end", count(*) AS hits FROM i GROUP BY k, g), t AS (SELECT k, sum(hits)::BIGINT AS flagged FROM r GROUP BY k)
SELECT r.k, first, "end", hits, flagged FROM (SELECT * FROM r WHERE hits >= 3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY first) <= 10) r JOIN t USING (k)""")
def unconfirmed_runs(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 20).alias("k"), F.floor(F.col("us") / 3_600_000_000).alias("at"), "value")
    return evaluation.long_runs(intervals.flag_runs(e, ["k"], "at", F.col("value") >= 40), ["k"], 3, 10)


LEAKS = "v AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 'blind' WHEN event_id % 10 < 4 THEN 'unidentifiable' WHEN score >= 0.6 THEN 'leak' ELSE 'covered' END AS verdict, CASE WHEN greatest(w, h) >= 100 THEN 'large' ELSE 'small' END AS size FROM det)"


def _verdicts(spark, sf_dir):
    v = F.when(ident() % 10 == 0, "blind").when(ident() % 10 < 4, "unidentifiable").when(F.col("score") >= 0.6, "leak").otherwise("covered")
    return detections(spark, sf_dir).withColumns({"verdict": v, "size": F.when(long_side() >= 100, "large").otherwise("small"), "floor": F.col("score") / 2})


@query(with_detections(f"""{LEAKS} SELECT CASE WHEN grouping(size) = 1 THEN 'all' ELSE size END AS size, count(*) AS checked, {', '.join(f"count(*) FILTER (verdict = '{x}') AS {x}" for x in ('blind', 'unidentifiable', 'leak', 'covered'))}, count(*) FILTER (verdict = 'leak') / nullif(count(*) FILTER (verdict IN ('leak', 'covered')), 0) AS rate,
 median(score) FILTER (verdict IN ('leak', 'covered')) AS median, max(score) FILTER (verdict IN ('leak', 'covered')) AS worst, median(score / 2) FILTER (verdict IN ('leak', 'covered')) AS median_floor FROM v GROUP BY ROLLUP (size)"""))
def leak_report(spark, sf_dir):
    return evaluation.leak_report(_verdicts(spark, sf_dir), "size")


@query(with_detections(f"{LEAKS} SELECT event_id, frame, score FROM v WHERE verdict = 'leak' ORDER BY score DESC, event_id LIMIT 200"))
def worst_leaks(spark, sf_dir):
    return _verdicts(spark, sf_dir).filter("verdict = 'leak'").orderBy(F.desc("score"), "event_id").limit(200).select("event_id", "frame", "score")


RESULTS = "r AS (SELECT l_partkey % 40 AS setting, l_linenumber AS file, max(l_tax) <= 0.08 AS passes, count(*) FILTER (l_discount > 0.08) AS exposed_40, count(*) FILTER (l_discount > 0.05) AS exposed_24, avg(l_quantity) AS score, max(l_tax) AS off_face, CASE WHEN count(*) % 3 > 0 THEN min(l_discount) END AS hand_damage, avg(l_extendedprice) AS masked FROM lineitem GROUP BY ALL)"


def _results(spark, sf_dir):
    hit = lambda x: F.count_if(F.col("l_discount") > x)
    l = load(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 40).alias("setting"), F.col("l_linenumber").alias("file"))  # noqa: E741
    return l.agg((F.max("l_tax") <= 0.08).alias("passes"), hit(0.08).alias("exposed_40"), hit(0.05).alias("exposed_24"), F.avg("l_quantity").alias("score"), F.max("l_tax").alias("off_face"), F.when(F.count("*") % 3 > 0, F.min("l_discount")).alias("hand_damage"), F.avg("l_extendedprice").alias("masked"))


@query(f"""WITH {RESULTS}, c AS (SELECT setting, bool_and(passes) AS passes_everywhere, sum(exposed_40)::BIGINT AS exposed_40, sum(exposed_24)::BIGINT AS exposed_24, avg(score) AS score, max(off_face) AS off_face, coalesce(max(hand_damage), 0) AS hand_worst, avg(masked) AS masked FROM r GROUP BY setting HAVING count(DISTINCT file) = (SELECT count(DISTINCT file) FROM r))
SELECT setting, passes_everywhere, exposed_40, exposed_24, round(score, 6) AS score, off_face, hand_worst, round(masked, 4) AS masked, row_number() OVER (ORDER BY NOT passes_everywhere, exposed_40, exposed_24, -round(score, 4), off_face, setting) AS place FROM c""")
def combined_settings(spark, sf_dir):
    return evaluation.combined(_results(spark, sf_dir), "setting", "file").withColumns({"score": F.round("score", 6), "masked": F.round("masked", 4)})


@query(f"WITH {RESULTS} SELECT setting, file, exposed_40, round(score, 4) AS score FROM r WHERE off_face <= 0.08 AND coalesce(hand_damage <= 0.01, true) ORDER BY exposed_40, exposed_24, -round(score, 4), off_face, setting, file LIMIT 1")
def sweep_choice(spark, sf_dir):
    gates = (F.col("off_face") <= 0.08) & F.coalesce(F.col("hand_damage") <= 0.01, F.lit(True))
    order = [F.col("exposed_40"), F.col("exposed_24"), -F.round("score", 4), F.col("off_face"), F.col("setting"), F.col("file")]
    return evaluation.chosen(_results(spark, sf_dir), gates, order).select("setting", "file", "exposed_40", F.round("score", 4).alias("score"))


@query(f"WITH {RESULTS} SELECT file, exposed_40, exposed_24 FROM r WHERE setting = 7")
def shipped_row(spark, sf_dir):
    wanted = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("file")).distinct()
    whole = evaluation.complete_or_fail(_results(spark, sf_dir), wanted, "file")
    return whole.filter("setting = 7").select("file", "exposed_40", "exposed_24")


SEEKS = "s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'opencv' ELSE 'pyav' END AS lib, CASE WHEN event_id % 3 = 0 THEN 'source' ELSE 'converted' END AS file, event_id % 97 <> 5 OR event_id % 2 = 0 AS exact, value AS ms FROM events)"


@query(f"""WITH {SEEKS}, a AS (SELECT lib, {', '.join(f"count(*) FILTER (file = '{f}' AND exact) AS {f}_exact, count(*) FILTER (file = '{f}') AS {f}_total, avg(ms) FILTER (file = '{f}') AS {f}_mean, median(ms) FILTER (file = '{f}') AS {f}_median" for f in ('converted', 'source'))} FROM s GROUP BY lib)
SELECT * REPLACE (round(converted_mean, 6) AS converted_mean, round(source_mean, 6) AS source_mean), round(converted_mean / source_mean, 9) AS ratio, bool_and(converted_exact = converted_total AND source_exact = source_total AND converted_mean / source_mean <= 2) OVER () AS passed FROM a""")
def random_access(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    s = e.select(F.when(ident() % 2 == 0, "opencv").otherwise("pyav").alias("lib"), F.when(ident() % 3 == 0, "source").otherwise("converted").alias("file"), ((ident() % 97 != 5) | (ident() % 2 == 0)).alias("exact"), F.col("value").alias("ms"))
    return rounded(rounded(evaluation.random_access(s, 2.0), 6, "converted_mean", "source_mean"), 9, "ratio")


@query("""WITH f AS (SELECT source AS file, doc_id AS frame, sha256(text) AS sha FROM documents), s AS (SELECT a.file, a.frame AS wanted, CASE WHEN a.frame % 5 = 0 THEN coalesce(b.sha, 'none') WHEN a.frame % 7 = 0 THEN 'none' ELSE a.sha END AS sha FROM f a LEFT JOIN f b ON b.file = a.file AND b.frame = a.frame + 20),
w AS (SELECT s.* FROM s JOIN f ON f.file = s.file AND f.frame = s.wanted WHERE s.sha <> f.sha) SELECT w.file, wanted, (SELECT min(frame) FROM f WHERE f.file = w.file AND f.sha = w.sha) - wanted AS "offset" FROM w""")
def seek_offsets(spark, sf_dir):
    f = load(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("frame"), F.sha2("text", 256).alias("sha"))
    later = f.select("file", (F.col("frame") - 20).alias("frame"), F.col("sha").alias("other"))
    sha = F.when(F.col("frame") % 5 == 0, F.coalesce("other", F.lit("none"))).when(F.col("frame") % 7 == 0, "none").otherwise(F.col("sha"))
    return evaluation.seek_offsets(f.join(later, ["file", "frame"], "left").select("file", F.col("frame").alias("wanted"), sha.alias("sha")), f)


@query(with_detections("""f AS (SELECT clip_id, frame, score < 0.1 AS flat, CASE WHEN event_id % 7 = 0 THEN 1 END AS hands, CASE WHEN event_id % 11 = 0 THEN 1 END AS in_zone FROM det), r AS (SELECT clip_id, frame - 5 AS start, frame + 6 AS "end" FROM det WHERE score > 0.98),
i AS (SELECT f.*, EXISTS (SELECT 1 FROM r WHERE r.clip_id = f.clip_id AND f.frame >= r.start AND f.frame < r."end") AS inside FROM f), m AS (SELECT clip_id, frame, flat::INT AS flat, hands, in_zone FROM i WHERE NOT inside AND frame % 2 = 0 UNION ALL SELECT clip_id, frame, 0, NULL, in_zone FROM i WHERE inside)
SELECT clip_id, count(DISTINCT frame) AS checked, sum(flat)::BIGINT AS flat, count(hands) AS hands, count(in_zone) AS in_zone, count(*) FILTER (hands IS NULL AND in_zone IS NULL) AS "left" FROM m GROUP BY clip_id"""))
def merged_checks(spark, sf_dir):
    d = detections(spark, sf_dir)
    f = d.select("clip_id", "frame", (F.col("score") < 0.1).cast("int").alias("flat"), F.when(ident() % 7 == 0, 1).alias("hands"), F.when(ident() % 11 == 0, 1).alias("in_zone"))
    r = d.filter("score > 0.98").select("clip_id", (F.col("frame") - 5).alias("start"), (F.col("frame") + 6).alias("end"))
    inside = intervals.dilate(d.filter("score > 0.98").select("clip_id", "frame"), ["clip_id"], "frame", 5)
    again = f.join(inside, ["clip_id", "frame"], "left_semi").withColumns({"flat": F.lit(0), "hands": F.lit(None).cast("int")})
    return evaluation.merged_checks(f, again, r, ["clip_id"], 2)


@query(with_detections(f"{KINDS} SELECT event_id, clip_id, frame, score FROM k WHERE coalesce(kind, 'face') = 'face' AND hand IS NULL AND zone IS NULL AND greatest(w, h) >= 64 AND score < 0.6"))
def second_chance_seeds(spark, sf_dir):
    k = kinds(spark, sf_dir).filter("coalesce(kind, 'face') = 'face' AND hand IS NULL AND zone IS NULL AND score < 0.6")
    return k.filter(long_side() >= 64).select("event_id", "clip_id", "frame", "score")


@query(with_detections("""h AS (SELECT clip_id, frame, event_id % 2 = 0 AS mine, w * h AS area, score * w * h AS hit FROM det WHERE source = 'signup'), f AS (SELECT clip_id, frame, sum(hit) / nullif(sum(area), 0) AS share FROM h GROUP BY ALL)
SELECT h.clip_id, round(sum(hit) FILTER (mine) / nullif(sum(area) FILTER (mine), 0), 9) AS wearer, round(sum(hit) FILTER (NOT mine) / nullif(sum(area) FILTER (NOT mine), 0), 9) AS other, any_value(w.frame) AS worst_frame, round(any_value(w.share), 9) AS worst FROM h JOIN (SELECT clip_id, arg_max(frame, (share, -frame)) AS frame, max(share) AS share FROM f GROUP BY clip_id) w USING (clip_id) GROUP BY h.clip_id"""))
def hand_damage(spark, sf_dir):
    h = detections(spark, sf_dir).filter("source = 'signup'").select("clip_id", "frame", (ident() % 2 == 0).alias("mine"), (F.col("w") * F.col("h")).alias("area"), (F.col("score") * F.col("w") * F.col("h")).alias("hit"))
    share = lambda test: F.sum(F.when(test, F.col("hit"))) / F.nullif(F.sum(F.when(test, F.col("area"))), F.lit(0.0))
    f = h.groupBy("clip_id", "frame").agg(share(F.lit(True)).alias("share")).groupBy("clip_id").agg(F.max_by("frame", F.struct("share", -F.col("frame"))).alias("worst_frame"), F.round(F.max("share"), 9).alias("worst"))
    return h.groupBy("clip_id").agg(F.round(share(F.col("mine")), 9).alias("wearer"), F.round(share(~F.col("mine")), 9).alias("other")).join(f, "clip_id")



@query("""WITH d AS (SELECT o_orderkey AS path, round_even(o_totalprice, 0)::BIGINT % 1000 AS size FROM orders), e AS (SELECT path, CASE WHEN path % 13 = 0 THEN size + 1 ELSE size END AS want FROM d WHERE path % 7 <> 0), u AS (SELECT path, CASE WHEN path % 5 = 0 THEN size ELSE size + 9 END AS raw FROM d WHERE path % 3 <> 0)
SELECT path, size, CASE WHEN coalesce(size = raw, false) THEN 'raw' WHEN want IS NULL THEN 'unknown' ELSE 'size' END AS why FROM d LEFT JOIN e USING (path) LEFT JOIN u USING (path) WHERE size >= 100 AND (size IS DISTINCT FROM want OR coalesce(size = raw, false))""")
def delivery_leaks(spark, sf_dir):
    d = _files(spark, sf_dir)
    p = F.col("path")
    e = d.filter(p % 7 != 0).withColumn("size", F.when(p % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))
    u = d.filter(p % 3 != 0).withColumn("size", F.when(p % 5 == 0, F.col("size")).otherwise(F.col("size") + 9))
    return evaluation.delivery_leaks(d, e, u, 100)


def _files(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.rint("o_totalprice").cast("long") % 1000).alias("size"), F.col("o_orderstatus").alias("state"))


LEDGER = """d AS (SELECT o_orderkey AS path, round_even(o_totalprice, 0)::BIGINT % 1000 AS size, o_orderstatus AS state FROM orders), done AS (SELECT path, CASE state WHEN 'F' THEN 'retimed' ELSE 'already' END AS status, CASE WHEN path % 11 = 0 THEN size + 1 ELSE size END AS delivered, size + 7 AS bytes FROM d WHERE state <> 'P' AND path % 4 < 3)"""


def _ledger(spark, sf_dir):
    d = _files(spark, sf_dir)
    p = F.col("path")
    status = F.when(F.col("state") == "F", "retimed").otherwise("already")
    return d, d.filter((F.col("state") != "P") & (p % 4 < 3)).select("path", status.alias("status"), F.when(p % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("delivered"), (F.col("size") + 7).alias("bytes"))


@query(f"WITH {LEDGER} SELECT path, size, CASE WHEN size < 100 THEN 'stub' WHEN size = delivered THEN 'done' ELSE 'todo' END AS action FROM d LEFT JOIN done USING (path)")
def ledger_pass(spark, sf_dir):
    return evaluation.ledger_pass(*_ledger(spark, sf_dir), 100)


@query(f"WITH {LEDGER}, s AS (SELECT path, CASE WHEN path % 9 = 0 THEN 0 ELSE size + 7 END AS staged FROM d WHERE path % 8 <> 1) SELECT path, CASE WHEN size IS DISTINCT FROM delivered THEN 'mismatched' WHEN status = 'already' THEN 'already' WHEN staged IS NOT DISTINCT FROM bytes THEN 'publish' ELSE 'mismatched' END AS action FROM done LEFT JOIN d USING (path) LEFT JOIN s USING (path)")
def publish_plan(spark, sf_dir):
    d, done = _ledger(spark, sf_dir)
    p = F.col("path")
    staged = d.filter(p % 8 != 1).select("path", F.when(p % 9 == 0, 0).otherwise(F.col("size") + 7).alias("size"))
    return evaluation.publish_plan(done, d, staged)


@query(f"WITH {LEDGER} SELECT status, count(*) AS n, max(bytes - delivered) AS worst FROM done GROUP BY status")
def ledger_counts(spark, sf_dir):
    return _ledger(spark, sf_dir)[1].groupBy("status").agg(F.count("*").alias("n"), F.max(F.col("bytes") - F.col("delivered")).alias("worst"))


OUTPUTS = "v AS (SELECT doc_id AS d, source || '/' || doc_id || '.mp4' AS path FROM documents), o AS (SELECT source || '/' || doc_id || '_out.mp4' AS path FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT source || '/quarantine/' || doc_id || '_out.mp4' FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT source || '/' || doc_id || '_out.mp4.json' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source || '/quarantine/' || doc_id || '_out.mp4.json' FROM documents WHERE doc_id % 5 < 3)"


@query(f"WITH {OUTPUTS} SELECT path, (d % 3 = 0 AND d % 2 = 0) OR (d % 3 = 1 AND d % 5 < 3) AS done FROM v")
def finished_or_held(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("source", "doc_id")
    i = F.col("doc_id")
    name = lambda a, b: F.concat("source", F.lit(a), i.cast("string"), F.lit(b)).alias("path")
    out = [d.filter(i % 3 == 0).select(name("/", "_out.mp4")), d.filter(i % 3 == 1).select(name("/quarantine/", "_out.mp4")), d.filter(i % 2 == 0).select(name("/", "_out.mp4.json")), d.filter(i % 5 < 3).select(name("/quarantine/", "_out.mp4.json"))]
    return evaluation.finished(d.select(name("/", ".mp4")), out[0].union(out[1]).union(out[2]).union(out[3]), "_out")


@query("""SELECT doc_id AS path, sha256(text) AS sha256_before, CASE WHEN doc_id % 5 > 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha256_after, strlen(text)::BIGINT AS size_before, strlen(text)::BIGINT // 2 AS size_after, CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 2 = 0 THEN 'applied' ELSE 'dry-run' END AS status FROM documents""")
def conversion_rows(spark, sf_dir):
    i, size = F.col("doc_id"), F.octet_length("text").cast("long")
    f = load(spark, sf_dir, "documents").select(i.alias("path"), F.sha2("text", 256).alias("sha"), size.alias("size"), F.sha2(F.concat("text", F.lit("!")), 256).alias("new_sha"), F.floor(size / 2).alias("new_size"), (i % 5 > 0).alias("passed"), (i % 2 == 0).alias("apply"))
    return evaluation.conversion_rows(f)


NAMES = ["/onnxruntime/run", "/cv2/resize", "_io.Buffered read", "/numpy/core", "other.py"]


@query(f"""WITH n AS (SELECT event_id, {NAMES}[event_id % 5 + 1] AS name, value FROM events), c AS (SELECT *, CASE WHEN name LIKE '%/onnxruntime/%' THEN 'gpu' WHEN name LIKE '%_io.Buffered%' THEN 'subprocess' WHEN name LIKE '%/cv2/%' THEN 'cv2' WHEN name LIKE '%numpy%' THEN 'numpy' ELSE 'python' END AS kind FROM n)
SELECT kind, count(*) AS calls, round(sum(value), 4) AS seconds FROM c GROUP BY kind""")
def profile_categories(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (ident() % 5 + 1).cast("int"))
    kind = evaluation.category(name, [("/onnxruntime/", "gpu"), ("_io\\.Buffered", "subprocess"), ("/cv2/", "cv2"), ("numpy", "numpy")], "python")
    return load(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("seconds"))


@query("""WITH w AS (SELECT c_custkey AS name FROM customer), r AS (SELECT o_custkey AS name, sum(o_totalprice) AS wall, count(*) AS frames FROM orders GROUP BY 1), v AS (SELECT o_custkey AS name, max(o_orderpriority) AS settings, count(*) FILTER (o_orderstatus = 'F') AS residual FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1)
SELECT name, round(wall, 2) AS wall, frames, residual, (SELECT min(settings) FROM v) AS settings, round((SELECT sum(wall) FROM r), 0) AS total FROM w LEFT JOIN r USING (name) LEFT JOIN v USING (name)""")
def bench_report(spark, sf_dir):
    names, o = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name")), load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "name")
    r = o.groupBy("name").agg(F.sum("o_totalprice").alias("wall"), F.count("*").alias("frames"))
    v = o.filter("name % 3 > 0").groupBy("name").agg(F.max("o_orderpriority").alias("settings"), F.count_if(F.col("o_orderstatus") == "F").alias("residual"))
    whole = r.agg(F.round(F.sum("wall"), 0).alias("total")).join(v.agg(F.min("settings").alias("settings")), F.lit(True))
    rows = names.join(r, "name", "left").join(v.drop("settings"), "name", "left")
    return rows.join(F.broadcast(whole), F.lit(True)).select("name", F.round("wall", 2).alias("wall"), "frames", "residual", "settings", "total")


@query(with_detections("t AS (SELECT row_number() OVER (PARTITION BY source ORDER BY event_id) - 1 AS i, event_id, source FROM det) SELECT event_id, source, [24, 32, 48, 64][i % 4 + 1]::BIGINT AS size, [0, 2, 4][i // 4 % 3 + 1]::BIGINT AS blur FROM t"))
def cyclic_tasks(spark, sf_dir):
    from ..operators.records import cyclic

    return cyclic(detections(spark, sf_dir).select("event_id", "source"), ["source"], "event_id", {"size": [24, 32, 48, 64], "blur": [0, 2, 4]})


@query(with_detections("SELECT clip_id, count(*) AS faces, count(*) FILTER (score / 5 > 0.1) AS taken, count(*) FILTER (score > 0) AS touched, count(*) FILTER (score / 5 > 0.1) / count(*) AS share FROM det GROUP BY clip_id"))
def zone_bias(spark, sf_dir):
    taken = F.count_if(F.col("score") / 5 > 0.1)
    return detections(spark, sf_dir).groupBy("clip_id").agg(F.count("*").alias("faces"), taken.alias("taken"), F.count_if(F.col("score") > 0).alias("touched"), (taken / F.count("*")).alias("share"))


@query(with_detections("""p AS (SELECT clip_id, max(frame) + 1 AS n FROM det GROUP BY clip_id), q AS (SELECT DISTINCT clip_id, round_even(i * (n - 1) / 119, 0)::BIGINT AS frame FROM p, range(0, 120) r(i)),
f AS (SELECT q.clip_id, q.frame, count(d.event_id) AS lines, coalesce(sum(d.w * d.h), 0) / (1600 * 1300) AS share FROM q LEFT JOIN det d USING (clip_id, frame) GROUP BY ALL)
SELECT clip_id, count(*) AS frames, round(avg(lines), 9) AS lines_mean, max(lines) AS lines_max, count(*) FILTER (lines > 0) AS with_text, round(avg(share), 9) AS share_mean, max(share) AS share_max, round(quantile_cont(share, 0.95), 9) AS share_p95, count(*) FILTER (share > 0.004) AS over_budget, count(*) FILTER (share = 0) AS empty FROM f GROUP BY clip_id"""))
def sampled_frames(spark, sf_dir):
    d = detections(spark, sf_dir)
    n = d.groupBy("clip_id").agg((F.max("frame") + 1).alias("n"))
    picks = n.select("clip_id", F.explode(spread_places(F.col("n"), 120)).alias("frame"))
    per = d.groupBy("clip_id", "frame").agg(F.count("*").alias("lines"), (F.sum(F.col("w") * F.col("h")) / (1600 * 1300)).alias("share"))
    f = picks.join(per, ["clip_id", "frame"], "left").fillna(0, ["lines", "share"])
    out = f.groupBy("clip_id").agg(F.count("*").alias("frames"), F.avg("lines").alias("lines_mean"), F.max("lines").alias("lines_max"), F.count_if(F.col("lines") > 0).alias("with_text"), F.avg("share").alias("share_mean"), F.max("share").alias("share_max"), F.percentile("share", F.lit(0.95)).alias("share_p95"), F.count_if(F.col("share") > 0.004).alias("over_budget"), F.count_if(F.col("share") == 0).alias("empty"))
    return rounded(out, 9, "lines_mean", "share_mean", "share_p95")


@query(with_detections("SELECT source AS surface, count(*) AS lines, count(DISTINCT (clip_id, frame)) AS frames, count(*) / (SELECT count(*) FROM det) AS share FROM det GROUP BY source"))
def surface_histogram(spark, sf_dir):
    d = detections(spark, sf_dir)
    n = d.groupBy(F.col("source").alias("surface")).agg(F.count("*").alias("lines"), F.count_distinct(F.struct("clip_id", "frame")).alias("frames"))
    return n.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy()))


@query(with_detections("""p AS (SELECT event_id, clip_id, frame, x - lag(x, 5) OVER w AS dx, y - lag(y, 5) OVER w AS dy, frame - lag(frame, 5) OVER w AS span FROM (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY track_id, frame ORDER BY event_id) = 1) WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT event_id, round(sqrt(dx * dx + dy * dy) / span, 9) AS speed FROM p WHERE sqrt(dx * dx + dy * dy) / span >= 0.01"""))
def fast_spans(spark, sf_dir):
    from ..operators.records import fast_spans

    one = detections(spark, sf_dir).withColumn("_n", F.row_number().over(Window.partitionBy("track_id", "frame").orderBy("event_id"))).filter("_n = 1")
    return fast_spans(one, ["track_id"], "frame", "x", "y", 5, 0.01).select("event_id", F.round("speed", 9).alias("speed"))


# ---- hands and poses

POSES = """ev AS (SELECT user_id % 5 AS k, event_id AS id, epoch_us(ts) AS t, event_id AS i FROM events),
raw AS (SELECT k, id, t, [i % 7 / 7.0::DOUBLE, i % 11 / 11.0::DOUBLE, i % 13 / 13.0::DOUBLE] AS p, [i % 7 - 3, i % 5 - 2, i % 3 - 1, 1 + i % 4]::DOUBLE[] AS r FROM ev WHERE i % 3 = 0),
poses AS (SELECT k, id, t, p, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS q FROM raw), asked AS (SELECT k, id, t FROM ev WHERE i % 3 = 1),
around AS (SELECT a.k, a.t, a.id, (SELECT max((t, id)) FROM poses b WHERE b.k = a.k AND b.t <= a.t) AS l, (SELECT min((t, id)) FROM poses b WHERE b.k = a.k AND b.t >= a.t) AS n FROM asked a),
pair AS (SELECT o.*, x.p AS pp, x.q AS pq, y.p AS np, y.q AS nq, CASE WHEN n[1] > l[1] THEN (o.t - l[1]) / (n[1] - l[1]) ELSE 0 END AS s, coalesce(l IS NOT NULL AND n IS NOT NULL AND least(o.t - l[1], n[1] - o.t) <= 3600000000, false) AS valid FROM around o LEFT JOIN poses x ON x.id = l[2] LEFT JOIN poses y ON y.id = n[2]),
dots AS (SELECT *, list_sum(list_transform(list_zip(pq, nq), lambda z: z[1] * z[2])) AS d FROM pair), angles AS (SELECT *, acos(least(1.0, abs(d))) AS a FROM dots),
parts AS (SELECT *, CASE WHEN a > 1e-9 THEN sin((1 - s) * a) / sin(a) ELSE 1 - s END AS u, CASE WHEN a > 1e-9 THEN sin(s * a) / sin(a) ELSE s END * CASE WHEN d < 0 THEN -1 ELSE 1 END AS v FROM angles),
posed AS (SELECT k, t, id, valid, CASE WHEN valid THEN list_transform(list_zip(pp, np), lambda z: z[1] + s * (z[2] - z[1])) END AS p, CASE WHEN valid THEN list_transform(list_zip(pq, nq), lambda z: u * z[1] + v * z[2]) END AS q FROM parts)"""


def _poses(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 5).alias("k"), ident().alias("id"), F.col("us").alias("t"))
    i = F.col("id")
    raw = F.array((i % 7 - 3).cast("double"), (i % 5 - 2).cast("double"), (i % 3 - 1).cast("double"), (1 + i % 4).cast("double"))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    poses = e.filter(i % 3 == 0).select("k", "id", "t", F.array(i % 7 / 7.0, i % 11 / 11.0, i % 13 / 13.0).alias("p"), F.transform(raw, lambda x: x / norm).alias("q"))
    return poses, e.filter(i % 3 == 1)


HOUR = 3_600_000_000


@query(f"WITH {POSES} SELECT k, id, valid, {', '.join(f'round(p[{j}], 8) AS p{j}' for j in (1, 2, 3))}, {', '.join(f'round(q[{j}], 8) AS q{j}' for j in (1, 2, 3, 4))} FROM posed")
def pose_interpolation(spark, sf_dir):
    poses, asked = _poses(spark, sf_dir)
    at = hands.poses_at(asked, poses, ["k"], "t", "id", HOUR)
    return at.select("k", "id", "valid", *(F.round(F.col("p")[j], 8).alias(f"p{j + 1}") for j in range(3)), *(F.round(F.col("q")[j], 8).alias(f"q{j + 1}") for j in range(4)))


TURN = lambda a, b, c: f"(2 * (q[{a}] * v[{b}] - q[{b}] * v[{a}]))"
TURNED = "t AS (SELECT *, 2 * (q[2] * v[3] - q[3] * v[2]) AS tx, 2 * (q[3] * v[1] - q[1] * v[3]) AS ty, 2 * (q[1] * v[2] - q[2] * v[1]) AS tz FROM c), w AS (SELECT *, v[1] + q[4] * tx + q[2] * tz - q[3] * ty AS x, v[2] + q[4] * ty + q[3] * tx - q[1] * tz AS y, v[3] + q[4] * tz + q[1] * ty - q[2] * tx AS z FROM t)"


@query(f"WITH {POSES}, c AS (SELECT k, id, p, q, [id % 17 / 17.0::DOUBLE, id % 19 / 19.0::DOUBLE, id % 23 / 23.0::DOUBLE] AS v FROM posed), {TURNED} SELECT k, id, round(x + p[1], 8) AS wx, round(y + p[2], 8) AS wy, round(z + p[3], 8) AS wz FROM w")
def joints_in_world(spark, sf_dir):
    poses, asked = _poses(spark, sf_dir)
    at = hands.poses_at(asked, poses, ["k"], "t", "id", HOUR)
    i = F.col("id")
    points = at.withColumns({"x": i % 17 / 17.0, "y": i % 19 / 19.0, "z": i % 23 / 23.0})
    return rounded(hands.in_world(points).select("k", "id", "wx", "wy", "wz"), 8, "wx", "wy", "wz")


@query(f"""WITH {POSES}, nearest AS (SELECT k, id, CASE WHEN t - l[1] <= n[1] - t THEN l[2] ELSE n[2] END AS pose FROM around WHERE l IS NOT NULL AND n IS NOT NULL),
c AS (SELECT a.k, a.id, b.q, [a.id % 3 / 10.0::DOUBLE, a.id % 5 / 10.0::DOUBLE, 9.8::DOUBLE] AS v FROM nearest a JOIN poses b ON b.id = a.pose), {TURNED}, m AS (SELECT k, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS samples FROM w GROUP BY k)
SELECT k, round(degrees(acos(z / sqrt(x * x + y * y + z * z))), 7) AS angle, samples FROM m""")
def gravity_angle(spark, sf_dir):
    poses, asked = _poses(spark, sf_dir)
    i = F.col("id")
    samples = asked.withColumn("v", F.array(i % 3 / 10.0, i % 5 / 10.0, F.lit(9.8)))
    return hands.gravity_angle(poses, samples, ["k"], "t", "id").withColumn("angle", F.round("angle", 7))


@query("""WITH l AS (SELECT user_id % 10 AS k, event_id AS row, epoch_us(ts) AS t, event_id * 2 AS frame FROM events WHERE event_type = 'click'), r AS (SELECT user_id % 10 AS k, event_id AS row, event_id * 3 AS frame FROM events WHERE event_type = 'purchase' AND event_id % 4 > 0),
p AS (SELECT l.k, l.row AS left_row, r.row AS right_row, l.t FROM l JOIN r ON l.k = r.k AND r.row = l.row + 10) SELECT p.k, left_row, right_row, p.t, l.frame AS left_frame, r.frame AS right_frame FROM p JOIN l ON l.k = p.k AND l.row = left_row AND l.row % 5 > 0 JOIN r ON r.k = p.k AND r.row = right_row WHERE p.t >= 1704500000000000 AND p.t < 1706000000000000""")
def stereo_frames(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 10).alias("k"), ident().alias("row"), F.col("us").alias("t"), "event_type")
    l, r = e.filter("event_type = 'click'"), e.filter("event_type = 'purchase' AND row % 4 > 0")  # noqa: E741
    pairs = l.select("k", F.col("row").alias("left_row"), (F.col("row") + 10).alias("right_row"), "t").join(r.select("k", F.col("row").alias("right_row")), ["k", "right_row"])
    frames = lambda df, n: df.select("k", "row", (F.col("row") * n).alias("frame"))
    return hands.stereo_frames(pairs, frames(l.filter("row % 5 > 0"), 2), frames(r, 3), ["k"], 1704500000000000, 1706000000000000).select("k", "left_row", "right_row", "t", "left_frame", "right_frame")


BONES = "b AS (SELECT user_id % 60 AS bone, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v, event_id % 10 < user_id % 12 AS sure FROM events)"


@query(f"WITH {BONES} SELECT bone, count(v) FILTER (sure) AS sure, round(CASE WHEN count(v) FILTER (sure) >= 10 THEN median(v) FILTER (sure) ELSE median(v) END, 9) AS length FROM b GROUP BY bone")
def reference_lengths(spark, sf_dir):
    b = load(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("bone"), F.when(ident() % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"), (ident() % 10 < F.col("user_id") % 12).alias("sure"))
    return hands.reference_lengths(b, ["bone"], "v", F.col("sure")).withColumn("length", F.round("length", 9))


@query(with_detections("""j AS (SELECT clip_id, frame // 6 AS f, track_id % 7 AS joint, avg(x) AS x, avg(y) AS y, bool_and(event_id % 29 > 0) AS ok FROM det GROUP BY ALL),
s AS (SELECT clip_id, joint, lag(x) OVER w - 2 * x + lead(x) OVER w AS dx, lag(y) OVER w - 2 * y + lead(y) OVER w AS dy, ok AND lag(ok) OVER w AND lead(ok) OVER w AND lead(f) OVER w - lag(f) OVER w = 2 AS fine FROM j WINDOW w AS (PARTITION BY clip_id, joint ORDER BY f)),
r AS (SELECT clip_id, joint, sqrt(sum(dx * dx + dy * dy) FILTER (fine) / (2 * nullif(count(*) FILTER (fine), 0))) AS rms FROM s GROUP BY ALL) SELECT clip_id, round(median(rms), 8) AS jitter, count(rms) AS joints FROM r GROUP BY clip_id"""))
def joint_jitter(spark, sf_dir):
    d = detections(spark, sf_dir).groupBy("clip_id", F.floor(F.col("frame") / 6).alias("f"), (F.col("track_id") % 7).alias("joint")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.bool_and(ident() % 29 > 0).alias("ok"))
    return hands.joint_jitter(d, ["clip_id"], "joint", "f", ["x", "y"], "ok").withColumn("jitter", F.round("jitter", 8))


@query(with_detections(f"""{CAMERA_SQL}, p AS (SELECT clip_id, frame, px / 50 AS tx, py / 50 AS ty, frame / 500 AS tz, frame % 37 > 2 AS ok FROM path), s AS (SELECT *, ok AND lag(ok) OVER w AS fine, sqrt((tx - lag(tx) OVER w) ** 2 + (ty - lag(ty) OVER w) ** 2 + (tz - lag(tz) OVER w) ** 2) AS step FROM p WINDOW w AS (PARTITION BY clip_id ORDER BY frame))
SELECT clip_id, round(avg(ok::INT), 9) AS coverage, sum(ok::INT)::BIGINT AS frames, round(sum(step) FILTER (fine), 6) AS length, round(median(step) FILTER (fine) * 30, 8) AS median_speed, round(quantile_cont(step, 0.95) FILTER (fine) * 30, 8) AS p95_speed FROM s GROUP BY clip_id"""))
def world_section(spark, sf_dir):
    c = camera(spark, sf_dir).select("clip_id", "frame", (F.col("path_x") / 50).alias("tx"), (F.col("path_y") / 50).alias("ty"), (F.col("frame") / 500).alias("tz"), (F.col("frame") % 37 > 2).alias("ok"))
    w = hands.world_section(c, ["clip_id"], "frame", "ok", 30.0)
    return rounded(rounded(w, 9, "coverage"), 6, "length").withColumns({"median_speed": F.round("median_speed", 8), "p95_speed": F.round("p95_speed", 8)})
