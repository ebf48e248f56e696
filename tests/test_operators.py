"""Interval, time and ordered operators on small tables, against plain Python."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from sightline import plans
from sightline.operators import asof, dispatch, identity, intervals
from sightline.sources import ingest
from sightline.streaming import twins


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_gap_runs(spark):
    df = spark.createDataFrame([("a", t) for t in (1, 1, 4, 9, 10, 16)] + [("b", 3), ("b", None)], "k string, t long")
    assert rows(intervals.gap_runs(df, ["k"], "t", 5)) == [("a", 1, 10, 4), ("a", 16, 16, 1), ("b", 3, 3, 1)]
    assert rows(intervals.gap_runs(df, ["k"], "t", 5, 2)) == [("a", 1, 10, 4)]
    assert rows(intervals.gap_runs(df.limit(0), ["k"], "t", 5)) == []


def test_speech_segments(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 0, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([("a", k, f) for k, f in enumerate(flags)], "k string, at long, f int")
    found = intervals.speech_segments(df, ["k"], "at", F.col("f") == 1, 10, 20, 20, 5, F.lit(130))
    assert rows(found) == [("a", 5, 55, 1), ("a", 75, 130, 1)]


def planned(flags, least):
    """(copy, length) of the parts: runs of equal flags, short clean ones turned where there is another run, then runs again."""
    runs = [(not m, len(list(g))) for m, g in itertools.groupby(flags)]
    blocks = [copy and not (len(runs) > 1 and n < least) for copy, n in runs for _ in range(n)]
    return [(copy, len(list(g))) for copy, g in itertools.groupby(blocks)]


def test_segment_plan(spark):
    rng = random.Random(1)
    lists = {k: [rng.random() < 0.4 for _ in range(rng.randint(1, 12))] for k in range(60)}
    df = spark.createDataFrame([(k, i, i + 1, m) for k, ms in lists.items() for i, m in enumerate(ms)], "k long, s long, e long, masked boolean")
    found = {}
    for k, a, b, copy in rows(intervals.segment_plan(df, ["k"], "s", "s", "e", "masked", 3)):
        found.setdefault(k, []).append((copy, b - a))
    assert found == {k: planned(ms, 3) for k, ms in lists.items()}


def test_hold(spark):
    df = spark.createDataFrame([("a", 0, 3, 1.0), ("a", 0, 6, 2.0), ("a", 1, 50, 9.0)], "k string, run long, at long, x double")
    found = rows(intervals.hold(df, ["k"], "run", "at", 2, 2, 1, 100).select("at", "x", "held"))
    assert found == [(3, 1.0, False), (4, 2.0, True), (5, 2.0, True), (6, 2.0, False), (7, 2.0, True), (8, 2.0, True)]


def test_nearest(spark):
    left = spark.createDataFrame([(1, t, t) for t in (10, 20, 35, 90)], "k long, t long, id long")
    right = spark.createDataFrame([(1, t, t) for t in (8, 12, 30, 34, 60)], "k long, t long, id long")
    found = asof.nearest(left, right, ["k"], "t", "id", 10)
    assert [r[3] for r in rows(found)] == [8, 12, 34]
    assert rows(asof.nearest(left, right.limit(0), ["k"], "t", "id", 10)) == []


def test_fit_clock(spark):
    """A fast clock that starts late, jitter, a frame seen twice and one dropped."""
    rng = random.Random(0)
    t = [round(k * 1e6 / 30) + rng.randint(-500, 500) for k in range(2000)]
    clock = [round((x - t[0]) * 1.000169) + 700 for x in t]
    container = sorted(clock[:40] + [clock[39] + 16_000] + clock[40:1500] + clock[1501:])
    frames, rows_ = (spark.createDataFrame([(1, x) for x in v], "k long, t long") for v in (container, t))
    found = asof.fit_clock(frames, rows_, "k", "t", 4000).first()
    assert abs(found["slope"] - 1.000169) < 2e-6 and abs(found["intercept"] - 700) < 150 and found["matched"] == 1999
    place, *_ = asof.frame_rows(np.array(container, dtype=float), np.array(t, dtype=float), 4000)
    assert place.tolist() == [*range(40), -1, *range(40, 1500), *range(1501, 2000)]
    assert asof.fit_clock(frames.limit(0), rows_, "k", "t", 4000).count() == 0


def test_fixed_point(spark):
    values = [0.0, -0.0, 1.25, -1.25, 0.005, 123456.789, -0.001, 2.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    expected = [("-" if np.signbit(v) else "") + f"{int(np.rint(abs(v) * 100)) // 100}.{int(np.rint(abs(v) * 100)) % 100:02d}" for v in values]
    assert sorted(r[0] for r in df.select(ingest.fixed_point(F.col("v"), 2)).collect()) == sorted(expected)


def test_csv(spark, tmp_path):
    lines = ["timestamp_us,x,y,z,type", "1,0.10,-0.00,2.50,accel", "2,1.00,0.25,-3.75,gyro"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    df = ingest.read_typed_csv(spark, str(tmp_path / "a.csv"), ingest.IMU)
    original = spark.createDataFrame([(x,) for x in lines[1:]], "line string")
    assert ingest.same_lines(original, df, {"x": 2, "y": 2, "z": 2}).first()[0] == 0
    assert ingest.same_lines(original, df, {"x": 3, "y": 2, "z": 2}).first()[0] == 4
    raw = (tmp_path / "a.csv").read_bytes()
    assert ingest.sniff(raw, raw[-2:]) == {"kind": "imu", "line_end": "\n", "decimals": {"x": 2, "y": 2, "z": 2}, "closing_newline": True}


def test_evenly(spark):
    df = spark.createDataFrame([(k, k) for k in range(103)], "id long, v long").withColumn("g", F.lit(1))
    assert [r[0] for r in rows(identity.evenly(df, "g", "id", 40))] == sorted({int(k * 103 / 40) for k in range(40)})


def vectors(n, labels, seed):
    rng = np.random.default_rng(seed)
    return [(k, int(rng.integers(labels)), rng.normal(size=8).tolist()) for k in range(n)]


def cosines(items):
    v = np.array([x[2] for x in items])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v @ v.T


def test_best_elsewhere_compares_all(spark):
    """A near twin counts wherever it stands among more than 40 rows, in one block or in a grid of them."""
    items = vectors(200, 2, 5)
    items[101] = (101, items[100][1], [x + 1e-4 for x in items[100][2]])
    c, label = cosines(items), np.array([x[1] for x in items])
    c[(label[:, None] != label[None, :]) | np.eye(len(items), dtype=bool)] = -1
    extra = [(900, 77, [1.0] * 8), (901, None, [1.0] * 8), (902, 0, None), (903, 0, [0.0] * 8), (904, 0, [1.0, None])]
    df = spark.createDataFrame(items + extra, "id long, label int, v array<float>")
    for grid in ({}, {"numbers": 160}):
        found = {r["id"]: r["best"] for r in identity.best_elsewhere(df, "id", "label", "v", **grid).collect()}
        assert len(found) == 205 and all(found[k] == -1 for k in range(900, 905))
        assert np.allclose([found[k] for k in range(200)], c.max(axis=1), atol=1e-6)
        assert found[100] > 0.999 and found[101] > 0.999
    assert rows(identity.best_elsewhere(df.limit(0), "id", "label", "v")) == []


def test_pairs_cap_only_genuine(spark):
    """Impostors are all pairs of different identities in a frame that lie apart, however many rows an identity has."""
    items = vectors(230, 2, 6)
    box = {k: ((k * 97 % 400) * 1.0, (k * 61 % 300) * 1.0, 10.0 + k % 40, 10.0 + k % 30) for k in range(231)}
    c, few = cosines(items), set()
    for g in (0, 1):
        ids = [k for k, label, _ in items if label == g]
        few |= {ids[int(k * len(ids) / 40)] for k in range(40)}

    def apart(a, b):
        (x, y, w, h), (u, v, p, q) = box[a], box[b]
        meet = min(x + w, u + p) > max(x, u) and min(y + h, v + q) > max(y, v)
        return not meet and math.hypot(x + w / 2 - u - p / 2, y + h / 2 - v - q / 2) >= 1.5 * max(w, h, p, q)

    expected = {(a, b, "genuine") for a in few for b in few if a < b and items[a][1] == items[b][1] and a // 23 != b // 23}
    expected |= {(a, b, "impostor") for a in range(230) for b in range(a + 1, 230) if items[a][1] != items[b][1] and a // 23 == b // 23 and apart(a, b)}
    df = spark.createDataFrame([(k, g, v, k // 23, *box[k]) for k, g, v in items], "id long, label int, v array<double>, frame long, x double, y double, w double, h double")
    found = identity.pairs(df, "id", "label", "v", "frame")
    got = found.collect()
    assert len(got) == len(expected) and {(r["a"], r["b"], r["kind"]) for r in got} == expected
    assert np.allclose([r["score"] for r in got], [c[r["a"], r["b"]] for r in got])
    assert all(r["smaller"] == min(max(box[r[k]][2:]) for k in "ab") and r["larger"] == max(max(box[r[k]][2:]) for k in "ab") for r in got)
    imp, gen = ([r["score"] for r in got if r["kind"] == k] for k in ("impostor", "genuine"))
    one = identity.calibration(found, 0.363).first()
    assert np.allclose([one["impostor_median"], one["impostor_p95"], one["p99"], one["impostor_max"]], [*np.quantile(imp, [0.5, 0.95, 0.99]), max(imp)])
    assert np.allclose([one["genuine_median"], one["genuine_p05"], one["over_published"]], [*np.quantile(gen, [0.5, 0.05]), np.mean(np.array(imp) >= 0.363)])
    assert (one["impostors"], one["genuine"], one["genuine_passed"]) == (len(imp), len(gen), sum(x >= one["p99"] for x in gen))
    assert identity.calibration(found.limit(0), 0.363).first()["p99"] is None


def test_human_sizes_of_every_document(spark, tmp_path):
    sizes = {1: 999, 2: 1250, 3: 999_949, 4: 1_000_000, 5: 2_350_000, 6: 3_000_000_000, 7: 4_500_000_000_000, 8: 7_000_000_000_000_000, 9: None}
    spark.createDataFrame(list(sizes.items()), "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["size"] for r in plans.QUERIES["human_sizes"](spark, str(tmp_path)).collect()}
    assert found == {1: "999 B", 2: "1.2 kB", 3: "999.9 kB", 4: "1.0 MB", 5: "2.4 MB", 6: "3.0 GB", 7: "4.5 TB", 8: "7000.0 TB", 9: None}


def test_audit_chain(spark):
    import hashlib

    prev, lines = "0" * 64, []
    for k in range(5):
        own = hashlib.sha256((prev + f"p{k}").encode()).hexdigest()
        lines.append(("a", k, prev, f"p{k}", own))
        prev = own
    cut = [("b", *x[1:]) for x in lines if x[1] != 2]
    edited = [("c", k, p, pay + "!" * (k == 3), h) for _, k, p, pay, h in lines]
    missing = [("d", k, p, None if k == 2 else pay, h) for _, k, p, pay, h in lines] + [("e", k, p, pay, None if k == 4 else h) for _, k, p, pay, h in lines]
    df = spark.createDataFrame(lines + cut + edited + missing, "f string, seq long, prev string, payload string, own string")
    want = [("a", True, 5, None), ("b", False, 4, "prev"), ("c", False, 5, "hash"), ("d", False, 5, "hash"), ("e", False, 5, "hash")]
    assert rows(dispatch.audit_chain(df, ["f"], "seq", "prev", "payload", "own")) == want


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").filter("user_id < 40")
    closing = events.limit(1).selectExpr("-1L AS event_id", "TIMESTAMP_NTZ'2030-01-01 00:00:00' AS ts", "-1L AS user_id", "event_type", "value", "props")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    closing.select(events.columns).write.mode("append").parquet(str(tmp_path / "in"))
    stream = twins.stream_of(spark, str(tmp_path / "in"), events.schema, 10)
    got = twins.drained(twins.session_runs(stream, "user_id", "ts", "1 day", "40 days"), "runs", str(tmp_path / "c"))
    day = 86_400_000_000
    timed = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    batch = intervals.gap_runs(timed, ["user_id"], "us", day - 1, 1).filter("hits >= 2")
    assert sorted((r.user_id, r.hits) for r in got.collect()) == sorted((r.user_id, r.hits) for r in batch.collect())


def test_split_points(spark):
    """The farthest key in reach each time; where none is in reach, the rest stays whole."""
    from sightline.functions import measures

    def plain(keys, start, end, most):
        cuts = [start]
        while end - cuts[-1] > most and (near := [k for k in keys if cuts[-1] < k <= cuts[-1] + most and k < end]):
            cuts.append(max(near))
        return cuts

    rng = random.Random(8)
    data = [(k, sorted(rng.sample(range(200), rng.randint(0, 25))), rng.randint(0, 20), rng.randint(150, 220), rng.randint(5, 60)) for k in range(80)] + [(99, [5, 100], 0, 180, 30)]
    df = spark.createDataFrame(data, "k long, keys array<long>, a long, z long, m long")
    found = {r.k: r.cuts for r in df.select("k", measures.split_points(F.col("keys"), F.col("a"), F.col("z"), F.col("m")).alias("cuts")).collect()}
    assert found == {k: plain(keys, a, z, m) for k, keys, a, z, m in data} and found[99] == [0, 5]


def test_polygons():
    from sightline.functions import polygons

    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], dtype=float)
    tilted = np.array([[2, -2], [6, 2], [2, 6], [-2, 2]], dtype=float)
    assert polygons.covered_share(square, square + 2) == 0.25 and polygons.covered_share(square, square + 9) == 0
    assert polygons.covered_share(square, tilted) == 1.0 and abs(polygons.covered_share(tilted, square) - 0.5) < 1e-12
    assert polygons.covered_share(square[:2], square) == 0


def test_union_area(spark):
    from sightline.functions.rules import union_area

    rng = random.Random(2)
    sets = [[(rng.randrange(12), rng.randrange(12), rng.randint(1, 6), rng.randint(1, 6)) for _ in range(rng.randint(0, 6))] for _ in range(40)]
    df = spark.createDataFrame([(k, [tuple(map(float, b)) for b in s]) for k, s in enumerate(sets)], "k long, b array<struct<x: double, y: double, w: double, h: double>>")
    found = {r.k: r.a for r in df.select("k", union_area(F.col("b")).alias("a")).collect()}
    assert found == {k: len({(i, j) for x, y, w, h in s for i in range(x, x + w) for j in range(y, y + h)}) for k, s in enumerate(sets)}


def sensor_files(folder):
    imu = "timestamp_us,x,y,z,type"
    files = {
        "lf.csv": f"{imu}\n1,0.10,-0.00,2.5,accel\n2,1.00,0.25,-3.7,gyro\n", "crlf.csv": f"{imu}\r\n1,0.10,2.00,3,accel\r\n", "open.csv": "timestamp_us\n1\n20", "spaced.csv": "\ttimestamp_us, x,y ,z,type\n5,1,2,3,accel\n",
        "mixed.csv": f"{imu}\n1,0.10,0.1,0.1,accel\n2,0.1,0.1,0.1,accel\n", "exponent.csv": f"{imu}\n1,1e-3,2,3,accel\n", "header.csv": "time,x\n1,2\n", "empty.csv": f"{imu}\n1,,2,3,accel\n", "ends.csv": "timestamp_us\r\n1\n2\r\n", "wide.csv": f"{imu}\n1,0,0,0,a,b\n", "bare.csv": f"{imu}\n",
    }
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    return files


def test_csv_files(spark, tmp_path):
    """What can be made again byte for byte is kept; nothing else is."""
    (tmp_path / "in").mkdir()
    files = sensor_files(tmp_path / "in")
    report = {r["file"]: r for r in ingest.convert_csv(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert {f for f in files if report[f]["ok"]} == {"lf.csv", "crlf.csv", "open.csv", "spaced.csv", "bare.csv"}
    assert [report[f]["closing_newline"] for f in ("lf.csv", "crlf.csv", "open.csv")] == [True, True, False] and report["crlf.csv"]["crlf"] and report["open.csv"]["kind"] == "pts"
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == 6 and kept.filter("x = 0.1 AND z = 2.5").count() == 1
    df = spark.createDataFrame([(n, t[:64], t[-2:]) for n, t in files.items()], "path string, head string, tail string")
    seen = {r["path"]: (r["kind"], r["crlf"], r["decimals"], r["closing_newline"]) for r in ingest.sniffed(df).collect()}
    assert seen["lf.csv"] == ("imu", False, "2,2,1", True) and seen["crlf.csv"] == ("imu", True, "2,2,0", True) and seen["open.csv"] == ("pts", False, None, False)
    assert seen["exponent.csv"][0] is None and seen["header.csv"][0] is None and seen["bare.csv"] == ("imu", False, None, True)


def test_audit_logs(spark):
    """Written logs verify; each way of spoiling one is named where it shows first."""
    import json

    from sightline.sources import audit

    payloads = [{"type": "header", "input": "a"}, {"type": "frame", "size": 3}, {"type": "frame", "size": 5}, {"type": "footer", "status": "done"}]
    df = spark.createDataFrame([("good", k, json.dumps(p)) for k, p in enumerate(payloads)], "log string, n long, payload string")
    good = [r["line"] for r in audit.write_logs(df, "log", "n", "payload").orderBy("number").collect()]
    assert good == audit.chained(payloads)
    again = audit.chained(payloads[1:3], json.loads(good[0])["hash"], 1)
    assert good[1:3] == again  # appending goes on from the last hash
    logs = {
        "good": good, "blank": [good[0], "", *good[1:]], "edited": [good[0], good[1].replace('"size":3', '"size":4'), *good[2:]], "cut": [good[0], *good[2:]], "junk": [good[0], "{x", *good[2:]],
        "headless": good[1:], "frames": audit.chained(payloads[1:]), "late": audit.chained([payloads[0], payloads[3], payloads[1]]), "twice": audit.chained([payloads[0], payloads[0]]), "nohash": [good[0], "{}"], "empty": [" "],
    }
    lines = spark.createDataFrame([(k, n, x) for k, v in logs.items() for n, x in enumerate(v, 1)], "log string, number long, line string")
    found = {r["log"]: (r["ok"], r["checked"], r["problem"]) for r in audit.verify_logs(lines, "log").collect()}
    assert found == {
        "good": (True, 4, ""), "blank": (True, 4, ""), "edited": (False, 1, "hash mismatch at seq 1"), "cut": (False, 1, "prev mismatch at seq 2"), "junk": (False, 1, "bad json at line 2"),
        "headless": (False, 0, "prev mismatch at seq 1"), "frames": (False, 0, "header misplaced at seq 0"), "late": (False, 1, "footer not last at seq 1"), "twice": (False, 1, "header misplaced at seq 1"), "nohash": (False, 1, "bad json at line 2"),
    }
    valid = lines.filter("log IN ('good', 'junk')").withColumn("v", audit.valid_records(lines)).groupBy("log").agg(F.count_if("v").alias("n"))
    assert rows(valid) == [("good", 4), ("junk", 3)]


def test_second_chance(spark, tmp_path):
    """Rounds end when no seed is left or nothing changes; a clean file is never tracked again."""
    from sightline.operators import evaluation

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    calls = []
    schema = "frame long, x double"
    truth = spark.createDataFrame([(k, float(k)) for k in range(6)], schema)

    def check(masks, where):
        calls.append(None if where is None else where.count())
        return truth.join(masks, ["frame", "x"], "left_anti")

    seeds = lambda found: found.orderBy("frame").limit(2)
    changed = lambda a, b: b.join(a, ["frame", "x"], "left_anti")
    strong = truth.filter("frame < 1")
    masks = evaluation.second_chance(strong, seeds, lambda s: s, check, changed, 2)
    assert rows(masks) == [(k, float(k)) for k in range(5)] and calls == [None, 2, 2]
    assert rows(evaluation.second_chance(strong, seeds, lambda s: s.filter("frame < 1"), check, changed, 5)) == [(0, 0.0)] and calls[3:] == [None]
