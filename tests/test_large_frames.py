"""Kernels for frames of thousands of boxes, held against plain rules; their work doesn't follow the pairs."""

import time

import numpy as np
import pyarrow as pa

from sightline.functions import areas, polygons
from sightline.operators import suppression


def some_boxes(n, seed=1, side=400):
    r = np.random.default_rng(seed)
    return np.concatenate([r.integers(0, side, (n, 2)), r.integers(1, 80, (n, 2))], axis=1).astype(float)


def greedy(n, pair):
    kept = []
    for i in range(n):
        if not any(pair(k, i) for k in kept):
            kept.append(i)
    return np.isin(np.arange(n), kept)


def test_boxes_and_hands_go_as_by_the_rule(monkeypatch):
    monkeypatch.setattr(suppression, "BLOCK", 16)  # several blocks
    boxes = some_boxes(150)
    boxes[[5, 40], [0, 2]] = np.nan
    share = suppression.shares(boxes, boxes)
    for least in (0.05, 0.3):
        assert (suppression.kept_boxes(boxes, lambda s, t=least: s >= t) == greedy(150, lambda a, b, t=least: share[a, b] >= t)).all()
    hands = np.random.default_rng(2).normal(0, 6, (150, 21, 2)) + np.random.default_rng(3).integers(0, 3, (150, 1, 2)) * 12
    hands[7, 3:] = np.nan
    near = lambda a, b: (np.hypot(*(hands[a] - hands[b]).T) <= 10).sum() >= 11
    assert (suppression.kept_hands(hands, 11, 10.0) == greedy(150, near)).all()
    assert suppression.kept_hands(hands, 22, 10.0).all() and suppression.kept_hands(hands, 0, 10.0).sum() == 1


def test_frames_across_batches():
    rows = pa.table({"k": pa.array([None, None, 1, 1, 1, 2, 3, 3], pa.int64()), "v": list(range(8))})
    for size in range(1, 9):
        parts = []
        for batch, at in suppression._frames(iter(rows.to_batches(size)), ["k"]):
            parts += np.split(np.array(batch.column("v")), at[1:])
        assert [p.tolist() for p in parts] == [[0, 1], [2, 3, 4], [5], [6, 7]]


def test_covered_by_the_union(monkeypatch):
    zones, boxes = some_boxes(60), np.concatenate([some_boxes(20, 4), [[0, 0, 500, 500], [3, 3, 0, 9]]])
    grid = np.zeros((600, 600), dtype=bool)
    for x, y, w, h in zones.astype(int):
        grid[x : x + w, y : y + h] = True
    want = [grid[x : x + w, y : y + h].sum() for x, y, w, h in boxes.astype(int)]
    for cells in (4_000_000, 300):  # strips of a column or two
        monkeypatch.setattr(areas, "CELLS", cells)
        assert np.allclose(areas.covered(zones, boxes), want)
    assert areas.covered(zones[:0], boxes).sum() == 0


def test_quads_by_many():
    r = np.random.default_rng(5)
    turn = r.uniform(0, 7, (300, 1)) + np.arange(4) * np.pi / 2
    quads = r.uniform(0, 300, (300, 1, 2)) + 80 * np.stack([np.cos(turn), np.sin(turn)], axis=-1)
    a, b = quads[:150], quads[150:]
    b[::3] = b[::3, ::-1]  # the other way round
    one = np.array([polygons.covered_share(p, q) for p, q in zip(a, b, strict=True)])
    assert np.allclose(polygons.covered_shares(a, b), one, atol=1e-12)
    assert (polygons.quads_that_meet(a, b) == (one > 0)).all()


def test_a_large_frame_takes_seconds():
    start = time.time()
    boxes = some_boxes(8000, side=1500)
    suppression.kept_boxes(boxes, lambda s: s > 0.6)
    suppression.kept_hands(boxes[:, None, :2] + np.arange(21)[:, None] * np.array([4.0, 3.0]), 11, 10.0)
    areas.covered(boxes, boxes)
    assert time.time() - start < 30


def test_few_small_rows_are_the_work_of_all_tasks(spark):
    from sightline.operators import evaluation

    boxes = spark.range(4000).selectExpr("id % 100 AS k", "DOUBLE(id * 7 % 1500) AS x", "DOUBLE(id * 11 % 1200) AS y", "50.0D AS w", "60.0D AS h")
    found = evaluation.covered_picture(boxes, ["k"], 1600, 1300)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # small shuffles are merged into one task otherwise
    assert found.count() == 100


def test_one_box_and_many_boxes_are_covered_alike():
    zones, picture = some_boxes(3000, side=1500), np.array([[0.0, 0.0, 1600.0, 1300.0]])
    alone = areas.covered(zones, picture)
    assert alone == areas.covered(zones, np.repeat(picture, 3, axis=0))[:1]


def test_zones_of_small_tables_are_the_work_of_all_tasks(spark):
    from sightline.operators import spatial

    boxes = spark.range(4000).selectExpr("id AS event_id", "id % 100 AS k", "DOUBLE(id * 7 % 1500) AS x", "DOUBLE(id * 11 % 1200) AS y", "50.0D AS w", "60.0D AS h")
    found = spatial.covered_by_union(boxes.filter("event_id % 5 = 0"), boxes.filter("event_id % 5 > 0"), ["k"], "event_id")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 800


def test_quads_that_lie_apart_are_told_without_python(spark):
    from pyspark.sql import functions as F

    from sightline.plans.region_queries import covered_pairs

    square = [0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0]
    moved = lambda by: [v + by * (k % 2 == 0) for k, v in enumerate(square)]
    pairs = [(1, square, moved(4)), (2, square, moved(10)), (3, square, moved(50)), (4, None, square), (5, square, square), (6, moved(50), None)]
    df = spark.createDataFrame(pairs, "i long, a_flat array<double>, b_flat array<double>")
    for s in "ab":
        for c, k in (("x", 0), ("y", 1)):
            one = F.expr(f"transform(sequence({k}, 7, 2), i -> {s}_flat[i])")
            df = df.withColumns({f"{s}_low_{c}": F.array_min(one), f"{s}_high_{c}": F.array_max(one)})
    found = covered_pairs(df)
    assert {r["i"]: r["share"] for r in found.collect()} == {1: 0.6, 2: 0.0, 3: 0.0, 4: None, 5: 1.0, 6: None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" in plan


def test_long_trails_and_walks_look_at_few():
    from sightline.operators.tracker import Camera, Rules, Tracker

    start = time.time()
    frames = {f: [(float(f % 50), 0.0, 20.0, 20.0, 0.9, f)] for f in range(20000)}
    trails = Tracker(frames, Camera({}), Rules(reach=3.0)).run()
    assert [len(t.at) for t in trails] == [20000] and trails[0].ends == (20000, 0, 19998, 19999)
    assert time.time() - start < 8  # every frame sorted the whole trail
    boxes = [(*b, 0.5, k) for k, b in enumerate(some_boxes(300).tolist())]
    tracker = Tracker({0: boxes}, Camera({}), Rules())
    want = boxes[7]
    touch = [b for b in boxes if min(b[0] + b[2], want[0] + want[2]) > max(b[0], want[0]) and min(b[1] + b[3], want[1] + want[3]) > max(b[1], want[1])]
    assert set(touch) <= set(tracker.near(0, want, 0.0)) and len(tracker.near(0, want, 0.0)) < 300
