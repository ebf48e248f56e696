"""Summaries, gates and reconciliation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import bucket, long_side
from ..operators import dispatch, evaluation, identity, quality
from ..sources.ingest import fixed_point, manifest_of, refreshed
from .registry import detections, events, load, query, with_detections

POINTS = "p AS (SELECT l_returnflag AS codec, l_linenumber AS level, l_discount + 0.1 AS ratio, l_quantity AS score, CASE WHEN l_tax > 0.04 THEN l_extendedprice END AS speed, l_tax <= 0.08 AS ok FROM lineitem)"
SUMMARY = f"{POINTS}, s AS (SELECT codec, level, count(*) AS n, avg(ratio) AS mean_ratio, min(ratio) AS min_ratio, max(ratio) AS max_ratio, min(score) AS min_score, avg(score) AS mean_score, avg(speed) AS mean_speed, bool_and(ok) AS all_ok FROM p GROUP BY codec, level)"


def _summary(spark, sf_dir):
    p = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("codec"), F.col("l_linenumber").alias("level"), (F.col("l_discount") + 0.1).alias("ratio"), F.col("l_quantity").alias("score"), F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice")).alias("speed"), (F.col("l_tax") <= 0.08).alias("ok"))
    return quality.calibration_summary(p, ["codec", "level"])


@query(f"WITH {SUMMARY} SELECT codec, level, n, round(mean_ratio, 6) AS mean_ratio, min_ratio, max_ratio, min_score, round(mean_score, 6) AS mean_score, round(mean_speed, 4) AS mean_speed, all_ok FROM s")
def calibration_summary(spark, sf_dir):
    return _summary(spark, sf_dir).withColumns({"mean_ratio": F.round("mean_ratio", 6), "mean_score": F.round("mean_score", 6), "mean_speed": F.round("mean_speed", 4)})


@query(f"""WITH {SUMMARY}, r AS (SELECT *, row_number() OVER (PARTITION BY codec ORDER BY (all_ok AND min_score >= 1) DESC, CASE WHEN all_ok AND min_score >= 1 THEN round(mean_ratio, 9) END, CASE WHEN all_ok AND min_score >= 1 THEN level END, all_ok DESC, min_score DESC, level) AS k FROM s)
SELECT codec, level, round(mean_ratio, 6) AS mean_ratio, min_score, all_ok AND min_score >= 1 AS meets_floor, min_score >= 2 AS meets_target FROM r WHERE k = 1""")
def calibration_choice(spark, sf_dir):
    s = _summary(spark, sf_dir).withColumn("mean_ratio", F.round("mean_ratio", 9))
    return quality.calibration_choice(s, ["codec"], "level", 1.0, 2.0).withColumn("mean_ratio", F.round("mean_ratio", 6))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY l_suppkey")
def weighted_mean(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(quality.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("mean"))


@query("""WITH t AS (SELECT o_orderkey, any_value(o_totalprice) AS total, count(*) AS n, sum(l_quantity) AS q, max(l_discount) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
c AS (SELECT o_orderkey, unnest(['lines', 'quantity', 'discount']) AS "check", unnest([n <= 5, q >= 50, d <= 0.09]) AS ok FROM t)
SELECT *, bool_and(ok) OVER (PARTITION BY o_orderkey) AS passed FROM c""")
def check_suite(spark, sf_dir):
    o, l = load(spark, sf_dir, "orders").select("o_orderkey"), load(spark, sf_dir, "lineitem")  # noqa: E741
    t = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    return quality.check_suite(t, ["o_orderkey"], {"lines": F.col("n") <= 5, "quantity": F.col("q") >= 50, "discount": F.col("d") <= 0.09})


RESIDUAL = "SELECT clip_id, count(*) AS boxes, count(DISTINCT frame) AS frames, count(*) FILTER (greatest(w, h) >= 140) AS large, count(*) FILTER (greatest(w, h) >= 80 AND greatest(w, h) < 140) AS middle, count(*) FILTER (greatest(w, h) < 80) AS small, coalesce(max(CASE WHEN source = 'error' THEN greatest(w, h) END), 0) AS worst FROM det GROUP BY clip_id"


def _residual(spark, sf_dir):
    side = long_side()
    size = lambda lo, hi: F.count_if((side >= lo) & (side < hi))
    return detections(spark, sf_dir).groupBy("clip_id").agg(F.count("*").alias("boxes"), F.count_distinct("frame").alias("frames"), size(140, 1e9).alias("large"), size(80, 140).alias("middle"), size(0, 80).alias("small"), F.coalesce(F.max(F.when(F.col("source") == "error", side)), F.lit(0.0)).alias("worst"))


@query(with_detections(f"r AS ({RESIDUAL}) SELECT * FROM r"))
def residual_summary(spark, sf_dir):
    return _residual(spark, sf_dir)


@query(with_detections(f"r AS ({RESIDUAL}) SELECT clip_id, concat_ws(',', CASE WHEN large > 450 THEN 'face' END, CASE WHEN middle > 1000 THEN 'text' END, CASE WHEN worst > 158 THEN 'plate' END) AS held_for FROM r"))
def hold_gate(spark, sf_dir):
    return quality.held_for(_residual(spark, sf_dir), {"face": F.col("large") > 450, "text": F.col("middle") > 1000, "plate": F.col("worst") > 158}).select("clip_id", "held_for")


@query(with_detections("s AS (SELECT clip_id, frame, sum(w * h) / (1600 * 1300) AS share FROM det GROUP BY clip_id, frame) SELECT clip_id, round(avg(share), 8) AS mean, round(quantile_cont(share, 0.95), 8) AS p95, max(share) AS max, count(*) FILTER (share > 0.01) AS over FROM s GROUP BY clip_id").replace(" AS over ", ' AS "over" '))
def mask_share_stats(spark, sf_dir):
    s = detections(spark, sf_dir).groupBy("clip_id", "frame").agg((F.sum(F.col("w") * F.col("h")) / (1600 * 1300)).alias("share"))
    return quality.share_stats(s, ["clip_id"], "share", 0.01).withColumns({"mean": F.round("mean", 8), "p95": F.round("p95", 8)})


@query(with_detections("""k AS (SELECT unnest([CASE WHEN greatest(w, h) < 80 THEN 'small' WHEN greatest(w, h) < 140 THEN 'middle' ELSE 'large' END, source, CASE WHEN w >= h THEN 'wide' ELSE 'high' END, 'all']) AS key, (score >= 0.5)::INT AS hit FROM det)
SELECT key, sum(hit)::BIGINT AS hit, count(*) AS total, round(avg(hit), 9) AS share FROM k GROUP BY key"""))
def multi_key_cube(spark, sf_dir):
    keys = [bucket(long_side(), [80, 140], ["small", "middle", "large"]), F.col("source"), F.when(F.col("w") >= F.col("h"), "wide").otherwise("high"), F.lit("all")]
    return quality.counted_in_all(detections(spark, sf_dir), keys, F.col("score") >= 0.5).withColumn("share", F.round("share", 9))


@query(with_detections("""b AS (SELECT unnest(['<32', '32-63', '64-95', '96-127', '128+', '1000+']) AS size), d AS (SELECT CASE WHEN greatest(w, h) < 32 THEN '<32' WHEN greatest(w, h) < 64 THEN '32-63' WHEN greatest(w, h) < 96 THEN '64-95' WHEN greatest(w, h) < 128 THEN '96-127' ELSE '128+' END AS size, score FROM det)
SELECT b.size, count(d.size) AS n, count(*) FILTER (score >= 0.5) / nullif(count(d.size), 0) AS recall FROM b LEFT JOIN d USING (size) GROUP BY b.size"""))
def size_bucket_recall(spark, sf_dir):
    size = bucket(long_side(), [32, 64, 96, 128], ["<32", "32-63", "64-95", "96-127", "128+"])
    got = detections(spark, sf_dir).groupBy(size.alias("size")).agg(F.count("*").alias("n"), (F.count_if(F.col("score") >= 0.5) / F.count("*")).alias("recall"))
    return quality.with_zeros(got, ["<32", "32-63", "64-95", "96-127", "128+", "1000+"], "size").fillna(0, ["n"])


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[least(count(*), (0.5 * count(*))::DOUBLE::INT64 + 1)] AS q50, list_sort(list(l_extendedprice))[least(count(*), floor(0.9::DOUBLE * count(*))::INT64 + 1)] AS q90 FROM lineitem GROUP BY l_suppkey".replace("(0.5 * count(*))::DOUBLE::INT64", "floor(0.5::DOUBLE * count(*))::INT64"))
def nearest_rank_quantiles(spark, sf_dir):
    return quality.nearest_ranks(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", {"q50": 0.5, "q90": 0.9})


@query("WITH f AS (SELECT unnest([0.0, 0.02, 0.05, 0.08])::DOUBLE AS floor) SELECT floor, l_returnflag, count(*) AS kept FROM lineitem, f WHERE l_discount >= floor GROUP BY ALL")
def threshold_sweep(spark, sf_dir):
    return quality.threshold_sweep(load(spark, sf_dir, "lineitem"), [0.0, 0.02, 0.05, 0.08], "l_discount", "l_returnflag")


@query("SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS fine, count(*) FILTER (quality = 1 AND toxic = 1) AS toxic, count(*) FILTER (quality = 0) AS poor FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def verdict_crosstab(spark, sf_dir):
    d = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return d.groupBy("lang").agg(F.count_if(q & ~t).alias("fine"), F.count_if(q & t).alias("toxic"), F.count_if(~q).alias("poor"))


@query("""WITH s AS (SELECT l_partkey, l_returnflag, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY ALL),
a AS (SELECT l_partkey FROM s GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)),
c AS (SELECT l_partkey, round(avg(d), 4) AS d, round(max(t), 4) AS t FROM s JOIN a USING (l_partkey) GROUP BY l_partkey)
SELECT l_partkey, d, t FROM c WHERE t <= 0.06 ORDER BY d DESC, t, l_partkey LIMIT 20""")
def sweep_rank(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    c = s.join(quality.on_all(s, ["l_partkey"], "l_returnflag").select("l_partkey"), "l_partkey").groupBy("l_partkey").agg(F.round(F.avg("d"), 4).alias("d"), F.round(F.max("t"), 4).alias("t"))
    return c.filter("t <= 0.06").orderBy(F.desc("d"), "t", "l_partkey").limit(20)


@query("SELECT l_partkey, count(DISTINCT l_shipmode) AS items FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY l_partkey HAVING count(DISTINCT l_shipmode) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)")
def settings_on_all_files(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("file"))
    return quality.on_all(d, ["l_partkey"], "file")


@query("""WITH y AS (SELECT l_suppkey, avg(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS before, avg(CASE WHEN l_linenumber = 7 AND l_tax > 0.02 THEN l_quantity END) AS after FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN after IS NOT NULL THEN after <= before END AS faster, CASE WHEN after IS NOT NULL THEN after >= 10 END AS recall_ok, coalesce(after <= before, true) AND coalesce(after >= 10, true) AS passed FROM y""")
def speed_gates(spark, sf_dir):
    pick = lambda test: F.avg(F.when(test, F.col("l_quantity")))
    y = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(pick(F.col("l_linenumber") == 1).alias("before"), pick((F.col("l_linenumber") == 7) & (F.col("l_tax") > 0.02)).alias("after"))
    known = F.col("after").isNotNull()
    y = y.withColumns({"faster": F.when(known, F.col("after") <= F.col("before")), "recall_ok": F.when(known, F.col("after") >= 10)})
    return y.select("l_suppkey", "faster", "recall_ok", (F.coalesce("faster", F.lit(True)) & F.coalesce("recall_ok", F.lit(True))).alias("passed"))


@query("""WITH s AS (SELECT user_id, lag(value) OVER w - 2 * value + lead(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(sqrt(avg(d * d)), 6) AS jitter, count(d) AS triples FROM s GROUP BY user_id""")
def jitter(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("at", F.struct("us", "event_id"))
    return quality.jitter(e, ["user_id"], "at", "value").withColumn("jitter", F.round("jitter", 6))


@query("SELECT user_id, CASE WHEN count(value) >= 2 THEN round(stddev_pop(value) / avg(value), 8) END AS cv, count(value) AS n FROM events GROUP BY user_id")
def bone_cv(spark, sf_dir):
    return quality.variation(events(spark, sf_dir), ["user_id"], "value").withColumn("cv", F.round("cv", 8))


@query("""WITH d AS (SELECT user_id % 50 AS k, epoch_us(ts) % 1000003 AS d FROM events), m AS (SELECT k, list_sort(list(d))[len(list(d)) // 2 + 1] AS m, count(*) AS n FROM d GROUP BY k)
SELECT k, m AS upper_median, max(abs(d - m)) AS worst, count(*) FILTER (abs(d - m) <= 100000) AS near FROM d JOIN m USING (k) GROUP BY k, m""")
def clock_error(spark, sf_dir):
    d = events(spark, sf_dir).select((F.col("user_id") % 50).alias("k"), (F.col("us") % 1000003).alias("d"))
    m = quality.nearest_ranks(d, ["k"], "d", {"upper_median": 0.5})
    far = F.abs(F.col("d") - F.col("upper_median"))
    return d.join(m, "k").groupBy("k", "upper_median").agg(F.max(far).alias("worst"), F.count_if(far <= 100000).alias("near"))


#: Sixteen vectors make a frame; each has a box in it.
FACES = "n AS (SELECT vec_id, label, vec_id // 16 AS frame, (vec_id * 97 % 1500)::DOUBLE AS x, (vec_id * 61 % 1200)::DOUBLE AS y, (10 + vec_id * 31 % 120)::DOUBLE AS w, (10 + vec_id * 17 % 120)::DOUBLE AS h, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS s FROM embeddings), f AS (SELECT * FROM n WHERE s <= 40 OR p IN (SELECT (k * s) // 40 FROM range(0, 40) r(k)))"
MEASURED = "list_cosine_similarity(a.v, b.v) AS score, least(greatest(a.w, a.h), greatest(b.w, b.h)) AS smaller, greatest(a.w, a.h, b.w, b.h) AS larger"
PAIRS = f"""{FACES}, q AS (SELECT a.vec_id AS a, b.vec_id AS b, 'genuine' AS kind, {MEASURED} FROM f a JOIN f b ON a.vec_id < b.vec_id AND a.label = b.label AND a.frame <> b.frame
 UNION ALL SELECT a.vec_id, b.vec_id, 'impostor', {MEASURED} FROM n a JOIN n b ON a.vec_id < b.vec_id AND a.label <> b.label AND a.frame = b.frame
 AND NOT (least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)) AND sqrt((a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2) >= 1.5 * greatest(a.w, a.h, b.w, b.h))"""


def _pairs(spark, sf_dir):
    i = F.col("vec_id")
    whole = lambda c: c.cast("double")
    boxes = {"frame": F.floor(i / 16), "x": whole(i * 97 % 1500), "y": whole(i * 61 % 1200), "w": whole(10 + i * 31 % 120), "h": whole(10 + i * 17 % 120)}
    return identity.pairs(load(spark, sf_dir, "embeddings").withColumns(boxes), "vec_id", "label", "embedding", "frame")


@query(f"WITH {PAIRS} SELECT a, b, kind, round(score, 9) AS score, smaller, larger FROM q")
def cosine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("score", F.round("score", 9))


EDGES = [16, 24, 32, 40, 64, 96, 10**6]
SIZE = "CASE " + " ".join(f"WHEN smaller < {hi} THEN '{lo}-{hi}'" for lo, hi in zip([0, *EDGES], EDGES[:-1], strict=False)) + " ELSE '96+' END"


@query(f"""WITH {PAIRS}, b AS (SELECT unnest([{', '.join(f"'{lo}-{hi}'" for lo, hi in zip([0, *EDGES], EDGES[:-1], strict=False))}, '96+']) AS size), s AS (SELECT *, {SIZE} AS size, (score >= 0.1)::INT AS hit FROM q)
SELECT b.size, count(score) FILTER (kind = 'genuine') AS genuine, avg(hit) FILTER (kind = 'genuine') AS recognised, round(median(score) FILTER (kind = 'genuine'), 9) AS median_same, count(score) FILTER (kind = 'impostor') AS impostors, avg(hit) FILTER (kind = 'impostor') AS false_match FROM b LEFT JOIN s USING (size) GROUP BY b.size""")
def match_by_size(spark, sf_dir):
    return evaluation.by_size(_pairs(spark, sf_dir), EDGES, F.lit(0.1)).withColumn("median_same", F.round("median_same", 9))


CALIBRATION = """SELECT count(i) AS impostors, quantile_cont(i, 0.5) AS impostor_median, quantile_cont(i, 0.95) AS impostor_p95, quantile_cont(i, 0.99) AS p99, max(i) AS impostor_max, count(*) FILTER (i >= 0.363) / count(i) AS over_published,
 count(g) AS genuine, quantile_cont(g, 0.5) AS genuine_median, quantile_cont(g, 0.05) AS genuine_p05 FROM (SELECT CASE WHEN kind = 'impostor' THEN score END AS i, CASE WHEN kind = 'genuine' THEN score END AS g FROM q)"""
NUMBERS = ["impostor_median", "impostor_p95", "p99", "impostor_max", "over_published", "genuine_median", "genuine_p05"]


@query(f"WITH {PAIRS}, c AS ({CALIBRATION}) SELECT impostors, genuine, {', '.join(f'round({n}, 8) AS {n}' for n in NUMBERS)}, (SELECT count(*) FROM q WHERE kind = 'genuine' AND score >= p99) AS genuine_passed FROM c")
def similarity_calibration(spark, sf_dir):
    return identity.calibration(_pairs(spark, sf_dir), 0.363).withColumns({n: F.round(n, 8) for n in NUMBERS})


BEST = f"{FACES}, m AS (SELECT a.vec_id, a.label, coalesce(max(CASE WHEN a.vec_id <> b.vec_id THEN list_cosine_similarity(a.v, b.v) END), -1) AS best FROM n a JOIN n b ON a.label = b.label GROUP BY ALL)"


@query(f"WITH {BEST} SELECT vec_id, label, round(best, 9) AS best FROM m")
def best_same_identity(spark, sf_dir):
    return identity.best_elsewhere(load(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding").withColumn("best", F.round("best", 9))


@query(f"""WITH {BEST}, v AS (SELECT CASE WHEN vec_id % 100 < 16 THEN 'blind' WHEN best < 0.25 THEN 'unidentifiable' WHEN best >= 0.3 THEN 'leak' ELSE 'covered' END AS verdict, CASE WHEN vec_id % 100 < 32 THEN 'small' ELSE 'large' END AS size FROM m)
SELECT size, count(*) FILTER (verdict = 'blind') AS blind, count(*) FILTER (verdict = 'unidentifiable') AS unidentifiable, count(*) FILTER (verdict = 'leak') AS leak, count(*) FILTER (verdict = 'covered') AS covered FROM v GROUP BY size""")
def leak_verdicts(spark, sf_dir):
    best, size = identity.best_elsewhere(load(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"), F.col("vec_id") % 100
    v = best.select(identity.verdict(F.col("best"), size, 16, 0.3, 0.05).alias("verdict"), bucket(size, [32], ["small", "large"]).alias("size"))
    return v.groupBy("size").agg(*(F.count_if(F.col("verdict") == x).alias(x) for x in ("blind", "unidentifiable", "leak", "covered")))


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, o_totalprice * 1.5 AS o_totalprice, o_custkey + 1 AS o_custkey FROM orders WHERE o_orderkey % 5 <> 0),
f AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'second' WHEN b.o_orderkey IS NULL THEN 'first' ELSE 'both' END AS side, unnest(['o_totalprice', 'o_custkey']) AS field, unnest([a.o_totalprice, a.o_custkey::DOUBLE]) AS a, unnest([b.o_totalprice, b.o_custkey::DOUBLE]) AS b FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT *, b - a AS difference, (b - a) / nullif(a, 0) AS relative FROM f""")
def run_diff(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    b = o.filter("o_orderkey % 5 <> 0").select("o_orderkey", (F.col("o_totalprice") * 1.5).alias("o_totalprice"), (F.col("o_custkey") + 1).alias("o_custkey"))
    return dispatch.record_diff(o.filter("o_orderkey % 3 <> 0"), b, "o_orderkey", ["o_totalprice", "o_custkey"])


@query("""WITH n AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), r AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS k, CASE WHEN n.k IS NOT NULL THEN 'normal' WHEN r.k IS NOT NULL THEN 'held' ELSE 'missing' END AS place, coalesce(n.v, r.v) AS found FROM orders LEFT JOIN n ON n.k = o_orderkey LEFT JOIN r ON r.k = o_orderkey""")
def reconcile_outputs(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    of = lambda flag: l.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return dispatch.reconcile(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), [("normal", of("N")), ("held", of("R"))], "k", "v")


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
 AND NOT EXISTS (SELECT 1 FROM orders l WHERE l.o_orderkey = o.o_orderkey AND l.o_custkey % 4 = 0 AND 1000 - l.o_orderkey % 1000 < 400)""")
def unfinished_work(spark, sf_dir):
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")  # noqa: E741
    done = [l.filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("o_orderkey")) for f in "NR"]
    leases = o.filter("o_custkey % 4 = 0").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("time"))
    return dispatch.unfinished(o.select("o_orderkey"), done, leases, "o_orderkey", 1000, 400)


@query("SELECT l_partkey, l_orderkey * 10 + l_linenumber AS line, l_linestatus AS status, l_quantity FROM lineitem WHERE l_linestatus = 'F' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1")
def ledger_last_wins(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_linestatus").alias("status"), "l_quantity")
    return dispatch.last_done(rows, "l_partkey", "line", "status", ["F"])


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, coalesce(role, '') || ':' || coalesce(text, '') AS payload FROM conversations),
h AS (SELECT *, sha256(payload) AS own FROM c), p AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY seq), repeat('0', 64)) AS prev FROM h),
t AS (SELECT conv_id, seq, prev, payload, sha256(prev || payload || CASE WHEN conv_id % 7 = 3 AND seq = 1 THEN '!' ELSE '' END) AS own FROM p),
v AS (SELECT conv_id, seq, CASE WHEN own <> sha256(prev || payload) THEN 'hash' WHEN prev <> coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY seq), repeat('0', 64)) THEN 'prev' END AS problem FROM t)
SELECT conv_id, count(problem) = 0 AS ok, count(*) AS checked, arg_min(problem, seq) FILTER (problem IS NOT NULL) AS problem FROM v GROUP BY conv_id""")
def audit_chain_verify(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf_dir, "conversations").withColumn("seq", (F.row_number().over(w) - 1).cast("long")).withColumn("payload", F.concat(F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    c = c.withColumn("_h", F.sha2("payload", 256)).withColumn("prev", F.coalesce(F.lag("_h").over(Window.partitionBy("conv_id").orderBy("seq")), F.lit("0" * 64)))
    edited = F.when((F.col("conv_id") % 7 == 3) & (F.col("seq") == 1), F.lit("!")).otherwise(F.lit(""))
    return dispatch.audit_chain(c.withColumn("own", F.sha2(F.concat("prev", "payload", edited), 256)), ["conv_id"], "seq", "prev", "payload", "own")


@query("SELECT source, sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY source, sha256(text)")
def frame_hash_lookup(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256"), "doc_id")
    return d.groupBy("source", "sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("SELECT source || '/' || doc_id AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS size, CASE WHEN doc_id % 4 = 0 THEN 'applied' ELSE 'listed' END AS status FROM documents")
def manifest(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    earlier = manifest_of(d.filter("doc_id % 4 = 0")).withColumn("status", F.lit("applied"))
    return refreshed(earlier, manifest_of(d))


@query("""WITH RECURSIVE s AS (SELECT s_nationkey, s_name AS name, (abs(s_acctbal) * 100)::DOUBLE AS raw, trunc(abs(s_acctbal) * 100)::BIGINT AS size FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY size DESC, name) AS k FROM s),
r AS (SELECT s_nationkey, k, name, size, 0 AS share, [size, 0, 0]::BIGINT[] AS loads FROM o WHERE k = 1 UNION ALL SELECT o.s_nationkey, o.k, o.name, o.size, list_position(r.loads, list_min(r.loads))::INT - 1, list_transform(r.loads, lambda x, i: CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN x + o.size ELSE x END) FROM r JOIN o ON o.s_nationkey = r.s_nationkey AND o.k = r.k + 1)
SELECT s_nationkey, name, size, share FROM r""")
def lpt_shares(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey"), F.col("s_name").alias("name"), (F.abs("s_acctbal") * 100).cast("long").alias("size"))
    return dispatch.balanced_shares(s, "s_nationkey", "name", "size", 3)


@query("SELECT l_orderkey, l_linenumber, l_orderkey || ',' || l_linenumber || ',' || printf('%.2f', l_extendedprice) || ',' || printf('%.2f', l_discount) AS line FROM lineitem")
def csv_roundtrip(spark, sf_dir):
    fields = [F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), fixed_point(F.col("l_extendedprice"), 2), fixed_point(F.col("l_discount"), 2)]
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", *fields).alias("line"))
