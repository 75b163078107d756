import numpy as np
import pytest
from pyspark.sql import functions as F

from pairset.operators import detect
from tests.conftest import rows


def boxes(spark, n, seed, images=3):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        x, y = rng.uniform(0, 120, 2)
        w, h = rng.uniform(15, 50, 2)
        # A third of all boxes sit in one image and class.
        image, cls = ("hot", 0) if i % 3 == 0 else (f"i{rng.integers(images)}", int(rng.integers(2)))
        data.append((image, i, float(x), float(y), float(x + w), float(y + h), round(float(rng.random()), 2), cls))
    return spark.createDataFrame(data, "image_id string, det_id int, x1 double, y1 double, x2 double, y2 double, score double, cls int")


def iou(a, b):
    w = max(0.0, min(a.x2, b.x2) - max(a.x1, b.x1) + 1)
    h = max(0.0, min(a.y2, b.y2) - max(a.y1, b.y1) + 1)
    size = lambda r: (r.x2 - r.x1 + 1) * (r.y2 - r.y1 + 1)
    return w * h / (size(a) + size(b) - w * h)


def greedy(df, limit=0.45):
    kept = []
    for r in sorted(df.collect(), key=lambda r: (-r.score, r.det_id)):
        if not any(k.image_id == r.image_id and k.cls == r.cls and iou(k, r) > limit for k in kept):
            kept.append(r)
    return sorted(r.det_id for r in kept)


@pytest.mark.parametrize("tile_boxes", [4_000, 60])
def test_suppression_equals_the_greedy_pass(spark, tile_boxes):
    df = boxes(spark, 450, 11)
    got = detect.suppress_overlaps(df, tile_boxes=tile_boxes)
    assert [r[0] for r in rows(got, "det_id")] == greedy(df)
    assert got.columns == df.columns


def spread_boxes(n, seed, side=400):
    """Boxes of many sizes, some of them without an area, over a wide frame and a crowded corner of it."""
    rng = np.random.default_rng(seed)
    at = np.where(rng.random(n) < 0.3, 40, side)[:, None] * rng.random((n, 2))
    size = np.exp(rng.uniform(-1, 5, (n, 1))) * rng.uniform(0.6, 1.6, (n, 2)) - 1.2
    return np.concatenate([at, at + size], axis=1), np.round(rng.random(n), 2)


@pytest.mark.parametrize("tile_boxes", [200])
@pytest.mark.parametrize("limit", [0.45, 0.1, 0.8])
def test_tiles_of_a_crowded_image_equal_the_greedy_pass(spark, tile_boxes, limit):
    corners, scores = spread_boxes(1500, 5)
    data = [("i", k, *map(float, c), float(s), 0) for k, (c, s) in enumerate(zip(corners, scores))]
    df = spark.createDataFrame(data, "image_id string, det_id int, x1 double, y1 double, x2 double, y2 double, score double, cls int")
    order = np.lexsort((np.arange(len(scores)), -scores))
    want = sorted(int(order[k]) for k in detect._suppress(corners[order], limit))
    assert [r[0] for r in rows(detect.suppress_overlaps(df, limit=limit, tile_boxes=tile_boxes), "det_id")] == want


def test_a_chain_over_many_tiles(spark):
    """Each box overlaps the next, better one, so decisions run through all tiles."""
    data = [("i", k, 4.0 * k, 0.0, 4.0 * k + 11.0, 9.0, k / 1000, 0) for k in range(300)]
    df = spark.createDataFrame(data, "image_id string, det_id int, x1 double, y1 double, x2 double, y2 double, score double, cls int")
    assert [r[0] for r in rows(detect.suppress_overlaps(df, tile_boxes=40), "det_id")] == list(range(1, 300, 2))


def test_corners_without_a_number(spark):
    nan, inf = float("nan"), float("inf")
    data = [("i", k, x, 0.0, 9.0, y, 0.5, 0) for k, (x, y) in enumerate([(0.0, 9.0), (0.0, 9.0), (nan, 9.0), (None, 9.0), (0.0, inf), (20.0, 9.0)])]
    df = spark.createDataFrame(data, "image_id string, det_id int, x1 double, y1 double, x2 double, y2 double, score double, cls int")
    for tile_boxes in (4_000, 2):
        assert [r[0] for r in rows(detect.suppress_overlaps(df, tile_boxes=tile_boxes), "det_id")] == [0, 2, 3, 4, 5]


def test_groups_running_across_batches(spark):
    df = boxes(spark, 600, 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert [r[0] for r in rows(detect.suppress_overlaps(df), "det_id")] == greedy(df)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("slab", [1, 5, 64])
def test_slabs(slab):
    rng = np.random.default_rng(2)
    at = rng.uniform(0, 60, (200, 2))
    b = np.concatenate([at, at + rng.uniform(5, 30, (200, 2))], axis=1)
    assert list(detect._suppress(b, 0.3, slab)) == list(detect._suppress(b, 0.3, 1000))


def test_corners(spark):
    raw = spark.createDataFrame([(10.0, 20.0, 4.0, 8.0, 0.5, 0), (1.0, 1.0, 1.0, 1.0, 0.1, 0), (1.0, 1.0, 1.0, 1.0, 0.9, 1)],
                                "cx double, cy double, w double, h double, score double, cls int")
    out = detect.corner_boxes(raw, F.lit(2.0))
    assert out.count() == 2
    assert rows(detect.confident(out), "x1", "y1", "x2", "y2") == [(4.0, 8.0, 6.0, 12.0)]


def joint(candidate, j, x, y, s, image="i"):
    return (image, candidate, j, float(x), float(y), float(s))


def test_best_candidate(spark):
    data = []
    for j in range(1, 14):
        data += [joint(1, j, 10 + j, 10 + j, 0.9), joint(2, j, 10 + 5 * j, 10 + 5 * j, 0.5), joint(3, j, j * 90, j * 90, 0.2)]
    data += [joint(7, 0, 0, 0, 1.0)] + [joint(c, 3, 5, 5, s, "flat") for c, s in ((1, 0.4), (2, 0.8), (3, 0.8))]
    df = spark.createDataFrame(data, "image_id string, candidate int, joint int, x double, y double, score double")
    assert rows(detect.best_candidate(df), "image_id", "candidate") == [("flat", 2), ("i", 2)]


def test_equal_weights_go_to_the_lower_candidate(spark):
    data = [joint(2, 1, 1, 1, 0.5), joint(2, 2, 3, 3, 0.5), joint(1, 1, 1, 1, 1.0), joint(1, 2, 2, 3, 1.0)]
    df = spark.createDataFrame(data, "image_id string, candidate int, joint int, x double, y double, score double")
    assert rows(detect.best_candidate(df), "candidate") == [(1,)]


def points(spark, array):
    return spark.createDataFrame([([tuple(map(float, p)) for p in array],)], "p array<struct<x:double,y:double,score:double>>")


def test_neck_and_layout(spark):
    df = points(spark, [(j, 10 * j, 0.5) for j in range(17)])
    got = df.select(detect.with_neck(F.col("p")).alias("p")).first()["p"]
    assert (got[1]["x"], got[1]["y"], got[1]["score"]) == (5.5, 55.0, 1.0)
    assert [int(q["x"]) for i, q in enumerate(got) if i != 1] == [0, 6, 8, 10, 5, 7, 9, 12, 14, 16, 11, 13, 15, 2, 1, 4, 3]
    hidden = points(spark, [(j, j, 0.3 if j == 6 else 0.9) for j in range(17)])
    assert hidden.select(detect.with_neck(F.col("p"))[1]["score"]).first()[0] == 0.0


def test_normalised(spark):
    df = points(spark, [(50, 20, 0.9), (50, 20, 0.29)])
    got = df.select(detect.normalised(F.col("p"), F.lit(100.0), F.lit(40.0)).alias("p")).first()["p"]
    assert [(q["x"], q["y"]) for q in got] == [(0.5, 0.5), (-1.0, -1.0)]


def test_peaks(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9], [0.2, 0.4, 0.3]), ([-1.0, -2.0], [0.5, 0.6])], "x array<double>, y array<double>")
    got = [tuple(r[0]) for r in df.select(detect.peak(F.col("x"), F.col("y"))).collect()]
    assert got == [(0.5, 0.5, 0.4), (-0.5, -0.5, -1.0)]


def test_centre_and_scale(spark):
    df = spark.createDataFrame([(0.0, 0.0, 30.0, 40.0)], "x1 double, y1 double, x2 double, y2 double")
    assert tuple(df.select(*[c.alias(n) for n, c in detect.centre_and_scale().items()]).first()) == (15.0, 20.0, 37.5, 50.0)
    assert tuple(df.select(*[c.alias(n) for n, c in detect.centre_and_scale(1.0, 0.5).items()]).first())[2:] == (30.0, 60.0)


@pytest.mark.parametrize("tile_boxes", [4_000, 50])
def test_repeated_ids_and_equal_boxes(spark, tile_boxes):
    df = boxes(spark, 300, 13).withColumn("det_id", F.col("det_id") % 40)
    df = df.unionByName(df.where("det_id < 5"))
    names = ["image_id", "det_id", "x1", "y1", "x2", "y2", "score", "cls"]
    order = lambda r: (-r.score, r.det_id, r.x1, r.y1, r.x2, r.y2)
    kept = []
    for r in sorted(df.collect(), key=order):
        if not any(k.image_id == r.image_id and k.cls == r.cls and iou(k, r) > 0.45 for k in kept):
            kept.append(r)
    assert rows(detect.suppress_overlaps(df, tile_boxes=tile_boxes), *names) == sorted(tuple(r[c] for c in names) for r in kept)


def test_boxes_without_ids(spark):
    df = boxes(spark, 90, 14).drop("det_id")
    names = df.columns
    assert rows(detect.suppress_overlaps(df, tile_boxes=40), *names) == rows(detect.suppress_overlaps(df), *names)
