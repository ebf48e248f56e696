"""Verdicts and formulas over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures
from .registry import detections, events, load, query, with_detections


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, greatest(l_quantity - l_linenumber, 0) AS c, greatest(l_extendedprice / 1000 - l_linenumber, 0) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN w < 4 THEN 'flat' WHEN c < 0.3 * w THEN 'missed' ELSE 'masked' END AS verdict FROM p""")
def masking_verdicts(spark, sf_dir):
    verdict = measures.masking(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_linenumber"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query(with_detections("""s AS (SELECT *, least(greatest(w, h) * 1.5, 1300) AS side FROM det)
SELECT event_id, greatest(0, least(x + w / 2 - side / 2, 1600 - side)) AS x, greatest(0, least(y + h / 2 - side / 2, 1300 - side)) AS y, side FROM s"""))
def crop_windows(spark, sf_dir):
    return detections(spark, sf_dir).select("event_id", measures.crop(*map(F.col, ("x", "y", "w", "h")), 1.5, 1600, 1300).alias("c")).select("event_id", "c.*")


@query(with_detections("o AS (SELECT event_id, w, h, w * h * 1.6 / (2 * (w + h)) AS d FROM det) SELECT event_id, w + 2 * d AS w, h + 2 * d AS h, d AS \"offset\" FROM o"))
def unclip_rects(spark, sf_dir):
    return detections(spark, sf_dir).select("event_id", measures.unclipped(F.col("w"), F.col("h"), 1.6).alias("u")).select("event_id", "u.*")


@query(with_detections("""v AS (SELECT event_id, (x - 800) / 400 AS px, (y - 650) / 400 AS py, 1 + score AS pz FROM det), a AS (SELECT *, sqrt(px * px + py * py) AS r, atan2(sqrt(px * px + py * py), pz) AS a FROM v),
s AS (SELECT *, CASE WHEN r > 0 THEN a * (1 + 0.02 * a ** 2 - 0.003 * a ** 4 + 0.001 * a ** 6 - 0.0002 * a ** 8) / r ELSE 1 END AS s FROM a)
SELECT event_id, round(500 * px * s + 800, 6) AS u, round(500 * py * s + 650, 6) AS v FROM s"""))
def fisheye_project(spark, sf_dir):
    p = measures.fisheye((F.col("x") - 800) / 400, (F.col("y") - 650) / 400, 1 + F.col("score"), (0.02, -0.003, 0.001, -0.0002), 500.0, (800.0, 650.0))
    return detections(spark, sf_dir).select("event_id", p.alias("p")).select("event_id", F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"))


@query("SELECT l_suppkey, round(median(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber + l_tax * l_tax)), 9) AS gravity FROM lineitem GROUP BY l_suppkey")
def gravity_check(spark, sf_dir):
    g = measures.gravity(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_tax"))
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(g, 9).alias("gravity"))


SIZES = " ".join(f"WHEN n < {1000 * unit} THEN printf('%.1f {name}', round_even(n / {unit // 10}, 0) / 10)" for name, unit in (("kB", 10**3), ("MB", 10**6), ("GB", 10**9)))


@query(f"SELECT doc_id, CASE WHEN n IS NULL THEN NULL WHEN n < 1000 THEN printf('%d B', n) {SIZES} ELSE printf('%.1f TB', round_even(n / 100000000000, 0) / 10) END AS size FROM (SELECT doc_id, n_chars AS n FROM documents)")
def human_sizes(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", measures.human_size(F.col("n_chars")).alias("size"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey % 8 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 7 THEN NULL ELSE concat_ws(',', CASE WHEN k & 1 > 0 THEN 'face' END, CASE WHEN k & 2 > 0 THEN 'text' END, CASE WHEN k & 4 > 0 THEN 'plate' END) END AS kinds FROM a""")
def kinds_listed(spark, sf_dir):
    k = F.col("o_custkey") % 8
    asked = F.concat_ws(",", F.when(k.bitwiseAND(4) > 0, " Plate"), F.when(k.bitwiseAND(2) > 0, "text"), F.when(k.bitwiseAND(1) > 0, "FACE "), F.when(k.bitwiseAND(2) > 0, "text "), F.when(k == 7, "car"))
    return load(spark, sf_dir, "orders").select("o_orderkey", measures.listed_kinds(asked, ["face", "text", "plate"]).alias("kinds"))


@query("""WITH RECURSIVE e AS (SELECT user_id % 20 AS k, epoch_us(ts) // 60000000 - 28401120 AS pos FROM events), g AS (SELECT k, min(pos) AS a, max(pos) + 1 AS z FROM e GROUP BY k),
c AS (SELECT k, a AS start, z FROM g UNION ALL SELECT k, cut, z FROM (SELECT c.k, c.z, (SELECT max(pos) FROM e WHERE e.k = c.k AND e.pos > c.start AND e.pos <= c.start + 300) AS cut FROM c WHERE c.k % 4 > 0 AND c.z - c.start > 300) WHERE cut IS NOT NULL AND cut < z) SELECT k, start FROM c""")
def split_segments(spark, sf_dir):
    """Every fourth segment is a copy, which is never cut."""
    e = events(spark, sf_dir).select((F.col("user_id") % 20).alias("k"), F.floor(F.col("us") / 60_000_000 - 28401120).alias("at"))
    keys = e.groupBy("k").agg(F.array_sort(F.collect_set("at")).alias("keys"), F.min("at").alias("a"), (F.max("at") + 1).alias("z"))
    cuts = measures.split_points(F.col("keys"), F.col("a"), F.col("z"), F.lit(300))
    return keys.select("k", F.explode(F.when(F.col("k") % 4 == 0, F.array("a")).otherwise(cuts)).alias("start"))
