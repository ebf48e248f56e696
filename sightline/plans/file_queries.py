"""Files written and read again, listings, logs and text reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import measures
from ..operators import asof
from ..sources import audit, ingest
from ..sources.scratch import fresh_folder
from .registry import events, load, query

LINES = """l AS (SELECT l_linenumber AS n, (l_orderkey * 10 + l_linenumber) || ',' || printf('%.2f', l_quantity - 25) || ',' || printf('%.2f', l_discount) || ',' || printf('%.2f', l_extendedprice) || ',' || CASE WHEN l_orderkey % 2 = 0 THEN 'accel' ELSE 'gyro' END AS line FROM lineitem)"""


@query(f"WITH {LINES} SELECT n, 'imu' AS kind, count(*) AS rows, (sum(strlen(line) + 1) + 24)::BIGINT AS size, 0::BIGINT AS different, true AS closing_newline, true AS ok FROM l GROUP BY n")
def csv_files_roundtrip(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").withColumn("t", F.col("l_orderkey") * 10 + F.col("l_linenumber"))  # noqa: E741
    line = F.concat_ws(",", F.col("t").cast("string"), *(ingest.fixed_point(c, 2) for c in (F.col("l_quantity") - 25, F.col("l_discount"), F.col("l_extendedprice"))), F.when(F.col("l_orderkey") % 2 == 0, "accel").otherwise("gyro"))
    lines = l.select(F.col("l_linenumber").alias("n"), "t", line.alias("value"))
    heads = lines.select("n").distinct().select("n", F.lit(-1).cast("long").alias("t"), F.lit("timestamp_us,x,y,z,type").alias("value"))
    folder = fresh_folder(spark, "csv")
    lines.unionByName(heads).repartition("n").sortWithinPartitions("n", "t").select("n", "value").write.partitionBy("n").text(folder)
    report = ingest.convert_csv(spark, folder, fresh_folder(spark, "imu"), "*.txt")
    return report.select(F.regexp_extract("path", r"n=(\d+)", 1).cast("int").alias("n"), "kind", "rows", "size", "different", "closing_newline", "ok")


HEADS = ["timestamp_us,x,y,z,type\n1,0.10,-2.5,3,accel\n", "timestamp_us\r\n17\r\n", "time,x,y\n1,2,3", "\ttimestamp_us, x,y ,z,type\n", "timestamp_us,x,y,z,type\n1,1e-3,2,3,gyro\n"]


@query("""SELECT doc_id AS path, CASE doc_id % 5 WHEN 1 THEN 'pts' WHEN 0 THEN 'imu' WHEN 3 THEN 'imu' END AS kind, doc_id % 5 = 1 AS crlf, CASE doc_id % 5 WHEN 0 THEN '2,1,0' END AS decimals, doc_id % 5 <> 2 AS closing_newline FROM documents""")
def sniffed_files(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return ingest.sniffed(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), head.alias("head"), F.right(head, F.lit(2)).alias("tail")))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 3600000000 AS t, event_type, event_id, value FROM events WHERE epoch_us(ts) // 3600000000 BETWEEN 473400 AND 473800), f AS (SELECT * FROM e WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id % 20, t, event_type ORDER BY event_id) = 1)
SELECT a.user_id % 20 AS k, a.t, a.value AS click_value, b.value AS view_value FROM f a JOIN f b ON a.user_id % 20 = b.user_id % 20 AND a.t = b.t AND a.event_type = 'click' AND b.event_type = 'view'""")
def imu_range(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 20).alias("k"), F.floor(F.col("us") / 3_600_000_000).alias("t"), "event_type", "event_id", "value")
    return asof.both_kinds(ingest.between(e, "t", 473400, 473800), ["k", "t"], "event_type", "event_id", "click", "view", ["value"])


@query("SELECT user_id % 20 AS k, epoch_us(ts) AS pts, row_number() OVER w - 1 AS row, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id % 20) AS since FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY epoch_us(ts), event_id)")
def pts_rows(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 20).alias("k"), F.col("us").alias("pts"), "event_id")
    w = Window.partitionBy("k")
    return e.select("k", "pts", (F.row_number().over(w.orderBy("pts", "event_id")) - 1).cast("long").alias("row"), (F.col("pts") - F.min("pts").over(w)).alias("since"))


@query("""WITH p AS (SELECT user_id % 50 AS k, CASE WHEN event_id % 501 = 0 THEN NULL ELSE epoch_us(ts) // 10000000 END AS pts, event_id % 4 * 10 AS duration, event_id FROM events), s AS (SELECT k, pts, lead(pts) OVER (PARTITION BY k ORDER BY pts) - pts AS step FROM p WHERE pts IS NOT NULL),
m AS (SELECT k, list_sort(list(step) FILTER (step IS NOT NULL)) AS s FROM s GROUP BY k), l AS (SELECT k, count(*) AS packets, count(*) FILTER (pts IS NULL) AS missing, count(pts) - count(DISTINCT pts) AS repeated, arg_max(duration, (pts, duration)) FILTER (pts IS NOT NULL) AS last FROM p GROUP BY k)
SELECT k, packets, missing, repeated, greatest(1, CASE WHEN last > 0 OR len(s) = 0 THEN last ELSE s[len(s) // 2 + 1] END) AS last_duration, missing = 0 AND repeated = 0 AS ok FROM l JOIN m USING (k)""")
def packet_validation(spark, sf_dir):
    from ..operators.records import packet_timing

    p = events(spark, sf_dir).select((F.col("user_id") % 50).alias("k"), F.when(F.col("event_id") % 501 != 0, F.floor(F.col("us") / 10_000_000)).alias("pts"), (F.col("event_id") % 4 * 10).alias("duration"))
    return packet_timing(p, ["k"], "pts", "duration")


KINDS = ["dataset", "group", "soft link", "dataset", "external link", "dataset", "dataset"]
FOLDERS = ["image/left", "image/right", "audio", "sensors", "image", "sensors/imu"]


@query(f"""WITH t AS (SELECT {FOLDERS}[doc_id % 6 + 1] || '/' || CASE WHEN doc_id % 4 = 0 THEN 'video' ELSE 'm' || doc_id END AS path, {KINDS}[doc_id % 7 + 1] AS type, doc_id FROM documents)
SELECT path, type, CASE WHEN type LIKE '%link' OR (type = 'dataset' AND path LIKE '%/video' AND path NOT LIKE 'image/%') THEN 'refuse' WHEN path LIKE 'image/%' OR path LIKE 'audio/%' THEN 'skip' ELSE 'copy' END AS action FROM t""")
def passed_through(spark, sf_dir):
    i = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    tree = load(spark, sf_dir, "documents").select(F.concat(pick(FOLDERS, 6), F.lit("/"), F.when(i % 4 == 0, "video").otherwise(F.concat(F.lit("m"), i.cast("string")))).alias("path"), pick(KINDS, 7).alias("type"))
    return ingest.passed_through(tree, ["image", "audio"], "video", "image")


@query("""WITH h AS (SELECT user_id % 10 AS clip, event_id AS frame, epoch_us(ts) AS t, value, 'left' AS hand, 0 AS side FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id % 10, event_id, epoch_us(ts), -value, 'right', 1 FROM events WHERE event_id % 3 = 0)
SELECT clip, frame, t AS timestamp_us, hand, value AS j00_x, value > 20 AS valid, row_number() OVER (PARTITION BY clip ORDER BY side, frame) AS place FROM h""")
def joints_table(spark, sf_dir):
    """Left rows, then right ones, written and read again; place is a row's in its clip's file."""
    e = events(spark, sf_dir).select((F.col("user_id") % 10).alias("clip"), F.col("event_id").alias("frame"), F.col("us").alias("timestamp_us"), "value")
    side = lambda df, hand, sign: df.select("clip", "frame", "timestamp_us", F.lit(hand).alias("hand"), (F.col("value") * sign).alias("j00_x"))
    both = side(e.filter("frame % 2 = 0"), "left", 1).unionByName(side(e.filter("frame % 3 = 0"), "right", -1)).withColumn("valid", F.col("j00_x") > 20)
    place = F.row_number().over(Window.partitionBy("clip").orderBy("hand", "frame"))
    rows, folder = both.withColumn("place", place.cast("long")), fresh_folder(spark, "joints")
    rows.repartition("clip").sortWithinPartitions("clip", "place").write.option("compression", "snappy").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


@query("""WITH m AS (SELECT source || '/' || doc_id AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS size, 'listed' AS status, doc_id FROM documents)
SELECT path, sha256, size, 'applied' AS status FROM m WHERE doc_id % 4 = 0 UNION ALL SELECT path, sha256, size, 'failed' FROM m WHERE doc_id % 8 = 3 UNION ALL SELECT path, sha256, size, status FROM m WHERE doc_id % 4 <> 0 AND doc_id % 8 <> 3""")
def manifest_files(spark, sf_dir):
    """Two appended batches of finished files, then a listing of everything: what is more than a listing stays."""
    d = load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    folder = fresh_folder(spark, "manifest")
    for test, status in (("doc_id % 4 = 0", "applied"), ("doc_id % 8 = 3", "failed"), ("doc_id % 4 = 1", "listed")):
        known = ingest.append_manifest(spark, folder, ingest.manifest_of(d.filter(test)).withColumn("status", F.lit(status)))
    return ingest.refreshed(known, ingest.manifest_of(d))


@query("SELECT source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mov' ELSE '.csv' END AS path, n_chars AS size FROM documents WHERE doc_id % 3 < 2 AND n_chars >= 1024")
def object_listing(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, [".MP4", ".mov", ".csv"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return ingest.videos_of(load(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"), F.col("n_chars").alias("size")), [".mp4", ".mov"])


@query("SELECT s_suppkey, left(sha256(concat_ws(chr(10), s_name, 'conf=' || s_nationkey, 'gap=' || (s_suppkey % 7))), 16) AS fingerprint FROM supplier")
def cache_keys(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    return s.select("s_suppkey", ingest.fingerprint(F.col("s_name"), {"gap": F.col("s_suppkey") % 7, "conf": F.col("s_nationkey")}).alias("fingerprint"))


@query("SELECT l_returnflag, '| ' || l_returnflag || ' | ' || l_linestatus || ' | ' || count(*) || ' | ' || CASE WHEN count(*) FILTER (l_tax > 0.07) > 0 THEN printf('%.2f', 100.0 * count(*) FILTER (l_tax > 0.07) / count(*)) || '%' ELSE 'n/a' END || ' |' AS line FROM lineitem GROUP BY l_returnflag, l_linestatus")
def report_lines(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0.07).alias("over"))
    g = g.withColumn("share", F.when(F.col("over") > 0, F.concat(ingest.fixed_point(F.lit(100.0) * F.col("over") / F.col("n"), 2), F.lit("%"))))
    return g.select("l_returnflag", ingest.markdown(g, ["l_returnflag", "l_linestatus", "n", "share"]).alias("line"))


@query("SELECT doc_id, 'https://example.org/' || replace(url_encode(source || '/a b+' || doc_id), '%2F', '/') AS url, CASE WHEN n_chars < 1000 THEN printf('%d B', n_chars) WHEN n_chars < 1000000 THEN printf('%.1f kB', round_even(n_chars / 100, 0) / 10) ELSE printf('%.1f MB', round_even(n_chars / 100000, 0) / 10) END AS size FROM documents")
def link_list(spark, sf_dir):
    from ..functions.measures import link

    return load(spark, sf_dir, "documents").select("doc_id", link("https://example.org/", F.concat("source", F.lit("/a b+"), F.col("doc_id").cast("string"))).alias("url"), measures.human_size(F.col("n_chars")).alias("size"))


@query("SELECT event_id, (epoch_us(ts) * 1000) || ',' || printf('%.6f', value) || ',' || printf('%.6f', -value) AS line FROM events")
def euroc_lines(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", F.concat_ws(",", (F.col("us") * 1000).cast("string"), ingest.fixed_point(F.col("value"), 6), ingest.fixed_point(-F.col("value"), 6)).alias("line"))


#: Logs of conversations; by conv_id % 6 they are whole, edited, cut, spoilt, without a beginning, or go on after their footer; every fourteenth begins without a header.
LOGS = """t AS (SELECT conv_id, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY conv_id) AS n, length(coalesce(text, '')) AS size FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
y AS (SELECT conv_id, seq, n, CASE WHEN seq = 0 AND conv_id % 14 <> 6 THEN 'header' WHEN seq = n - CASE WHEN conv_id % 6 = 5 THEN 2 ELSE 1 END AND seq > 0 THEN 'footer' ELSE 'frame' END AS type, size FROM t),
p AS (SELECT *, CASE type WHEN 'header' THEN '"input":"c' || conv_id || '",' ELSE '' END AS a, CASE type WHEN 'frame' THEN ',"size":' || size WHEN 'footer' THEN ',"status":"done"' ELSE '' END AS b FROM y),
c AS (SELECT p.*, repeat('0', 64) AS prev, sha256(repeat('0', 64) || '{' || a || '"prev":"' || repeat('0', 64) || '","seq":0' || b || ',"type":"' || type || '"}') AS hash FROM p WHERE seq = 0
 UNION ALL SELECT p.*, c.hash, sha256(c.hash || '{' || p.a || '"prev":"' || c.hash || '","seq":' || p.seq || p.b || ',"type":"' || p.type || '"}') FROM c JOIN p ON p.conv_id = c.conv_id AND p.seq = c.seq + 1),
e AS (SELECT conv_id, seq, type, prev, hash, conv_id % 6 = 3 AND seq = 2 AS bad, conv_id % 6 = 1 AND seq = 1 AND type = 'frame' AS edited FROM c WHERE NOT (conv_id % 6 = 2 AND seq = 1) AND NOT (conv_id % 6 = 4 AND seq = 0)),
v AS (SELECT *, row_number() OVER w AS number, CASE WHEN row_number() OVER w = 1 THEN repeat('0', 64) ELSE lag(CASE WHEN NOT bad THEN hash END) OVER w END AS before, lead(seq) OVER w IS NULL AS last FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
q AS (SELECT conv_id, number, CASE WHEN bad THEN 'bad json at line ' || number WHEN edited THEN 'hash mismatch at seq ' || seq WHEN prev IS DISTINCT FROM before THEN 'prev mismatch at seq ' || seq WHEN seq <> number - 1 THEN 'seq mismatch at seq ' || seq
 WHEN (seq = 0) <> (type = 'header') THEN 'header misplaced at seq ' || seq WHEN type = 'footer' AND NOT last THEN 'footer not last at seq ' || seq END AS problem FROM v)"""


def _logs(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    t = load(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(w.orderBy("turn")) - 1).alias("seq"), F.count("*").over(w).alias("n"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    c, seq = F.col("conv_id"), F.col("seq")
    kind = F.when((seq == 0) & (c % 14 != 6), "header").when((seq == F.col("n") - F.when(c % 6 == 5, 2).otherwise(1)) & (seq > 0), "footer").otherwise("frame")
    t = t.withColumn("type", kind)
    payload = F.to_json(F.struct("type", F.when(kind == "header", F.concat(F.lit("c"), c.cast("string"))).alias("input"), F.when(kind == "frame", F.col("size")).alias("size"), F.when(kind == "footer", "done").alias("status")))
    lines = audit.write_logs(t.withColumn("payload", payload), "conv_id", "seq", "payload")
    n = F.col("number")
    cut = lines.filter(~((c % 6 == 2) & (n == 2)) & ~((c % 6 == 4) & (n == 1)))
    return cut.withColumn("line", F.when((c % 6 == 3) & (n == 3), "{bad").when((c % 6 == 1) & (n == 2), F.regexp_replace("line", '"size":', '"size":9')).otherwise(F.col("line")))


@query(f"WITH RECURSIVE {LOGS} SELECT conv_id, count(problem) = 0 AS ok, coalesce(min(CASE WHEN problem IS NOT NULL THEN number END) - 1, count(*)) AS checked, coalesce(arg_min(problem, number) FILTER (problem IS NOT NULL), '') AS problem FROM q GROUP BY conv_id")
def audit_log_verify(spark, sf_dir):
    return audit.verify_logs(_logs(spark, sf_dir), "conv_id")


@query(f"WITH RECURSIVE {LOGS} SELECT conv_id, count(*) AS lines, count(*) FILTER (NOT bad) AS valid FROM v GROUP BY conv_id")
def audit_records_valid(spark, sf_dir):
    lines = _logs(spark, sf_dir)
    return lines.withColumn("v", audit.valid_records(lines)).groupBy("conv_id").agg(F.count("*").alias("lines"), F.count_if("v").alias("valid"))
