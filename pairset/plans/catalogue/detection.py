"""Detections from line items, keypoints from the embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.operators import detect
from pairset.plans.catalogue.common import Registry, r6, rounded, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def raw_detections(spark: SparkSession, sf: str) -> DataFrame:
    """One raw box per line item; the supplier is the image and the return flag the class."""
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("det_id"),
        F.col("l_partkey").cast("double").alias("cx"), (F.col("l_quantity") * 20).alias("cy"),
        (F.lit(100.0) + F.col("l_discount") * 2000).alias("w"), (F.lit(100.0) + F.col("l_tax") * 2500).alias("h"),
        (F.col("l_extendedprice") / 110000.0).alias("score"), cls.alias("cls"),
    )


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return detect.corner_boxes(raw_detections(spark, sf), F.lit(0.5))


_RAW = """
raw AS (SELECT l_suppkey AS image_id, l_orderkey * 10 + l_linenumber AS det_id, l_partkey::DOUBLE AS cx, l_quantity * 20 AS cy, 100.0::DOUBLE + l_discount * 2000 AS w,
               100.0::DOUBLE + l_tax * 2500 AS h, l_extendedprice / 110000.0::DOUBLE AS score, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls FROM lineitem),
box AS (SELECT image_id, det_id, score, cls, (cx - w / 2) / 0.5::DOUBLE AS x1, (cy - h / 2) / 0.5::DOUBLE AS y1, (cx + w / 2) / 0.5::DOUBLE AS x2, (cy + h / 2) / 0.5::DOUBLE AS y2
        FROM raw WHERE score > 0.1)
"""


@_r.query(f"WITH {_RAW} SELECT image_id, det_id, cls, round(score, 6) AS score, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM box WHERE score > 0.3 AND cls = 0")
def detection_filter(spark, sf):
    out = detect.confident(boxes(spark, sf))
    return rounded(out, "score", "x1", "y1", "x2", "y2")


@_r.query(f"""
WITH {_RAW},
g AS (SELECT image_id, cls, list({{'id': det_id, 's': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, det_id) AS b FROM box GROUP BY image_id, cls),
k AS (SELECT image_id, cls, list_reduce([[x] for x in b], lambda acc, nb: CASE WHEN len(list_filter(acc, lambda a:
    greatest(0, least(a.x2, nb[1].x2) - greatest(a.x1, nb[1].x1) + 1) * greatest(0, least(a.y2, nb[1].y2) - greatest(a.y1, nb[1].y1) + 1)
    / ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (nb[1].x2 - nb[1].x1 + 1) * (nb[1].y2 - nb[1].y1 + 1)
       - greatest(0, least(a.x2, nb[1].x2) - greatest(a.x1, nb[1].x1) + 1) * greatest(0, least(a.y2, nb[1].y2) - greatest(a.y1, nb[1].y1) + 1)) > 0.45)) > 0
    THEN acc ELSE list_concat(acc, nb) END) AS kept FROM g),
u AS (SELECT image_id, cls, unnest(kept) AS d FROM k)
SELECT image_id, cls, d.id AS det_id, round(d.s, 6) AS score, round(d.x1, 6) AS x1 FROM u
""")
def overlap_suppression(spark, sf):
    out = detect.suppress_overlaps(boxes(spark, sf)).select("image_id", "cls", "det_id", "score", "x1")
    return rounded(out, "score", "x1")


@_r.query(f"""
WITH {_RAW}, s AS (SELECT *, (x2 - x1) * 1.25 AS w, (y2 - y1) * 1.25 AS h FROM box)
SELECT det_id, image_id, round((x1 + x2) * 0.5, 6) AS center_x, round((y1 + y2) * 0.5, 6) AS center_y,
       round(CASE WHEN w > h * 0.75 THEN w ELSE h * 0.75 END, 6) AS scale_w, round(CASE WHEN w > h * 0.75 THEN w / 0.75 ELSE h END, 6) AS scale_h FROM s
""")
def box_centre_scale(spark, sf):
    out = boxes(spark, sf).select("det_id", "image_id", *[c.alias(n) for n, c in detect.centre_and_scale(1.25, 0.75).items()])
    return rounded(out, "center_x", "center_y", "scale_w", "scale_h")


def keypoints(spark: SparkSession, sf: str) -> DataFrame:
    """Seventeen joints per vector, in pixels of a 192 x 256 image; the label is the image."""
    def at(i: Column) -> Column:
        return F.abs(F.get("embedding", i).cast("double"))

    joints = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.struct(
        (at(j) * 192.0).alias("x"), (at(j + 17) * 256.0).alias("y"), (at(j + 34) * 4.0).alias("score")))
    return table(spark, sf, "embeddings").select("vec_id", "label", joints.alias("points"))


_POINTS = """
kp AS (SELECT vec_id, label, j AS joint, abs(embedding[j + 1]::DOUBLE) * 192 AS x, abs(embedding[j + 18]::DOUBLE) * 256 AS y, abs(embedding[j + 35]::DOUBLE) * 4 AS score
       FROM embeddings CROSS JOIN range(17) t(j))
"""


@_r.query(f"""
WITH {_POINTS}, a AS (SELECT label, vec_id, sum(CASE WHEN score > 0.3 THEN score ELSE 0 END) AS joint_score,
    coalesce((max(x) FILTER (score > 0.3 AND x > 0) - min(x) FILTER (score > 0.3 AND x > 0)) * (max(y) FILTER (score > 0.3 AND y > 0) - min(y) FILTER (score > 0.3 AND y > 0)), 0) AS area
  FROM kp WHERE joint BETWEEN 1 AND 13 GROUP BY label, vec_id)
SELECT label, vec_id, round(joint_score, 6) AS joint_score, round(area, 4) AS area FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY joint_score * area DESC, vec_id) AS rn FROM a) WHERE rn = 1
""")
def best_candidate(spark, sf):
    flat = detect.flatten_points(keypoints(spark, sf), "points", ["label", "vec_id"])
    best = detect.best_candidate(flat, "label", "vec_id")
    return best.select("label", "vec_id", r6("joint_score").alias("joint_score"), F.round("area", 4).alias("area"))


@_r.query(f"""
WITH {_POINTS} SELECT vec_id, CAST(joint AS INTEGER) AS joint, round(CASE WHEN score < 0.3 THEN -1 ELSE x / 192 END, 6) AS x,
       round(CASE WHEN score < 0.3 THEN -1 ELSE y / 256 END, 6) AS y FROM kp
""")
def normalised_keypoints(spark, sf):
    points = keypoints(spark, sf).withColumn("points", detect.normalised(F.col("points"), F.lit(192.0), F.lit(256.0)))
    return rounded(detect.flatten_points(points, "points", ["vec_id"]).drop("score"), "x", "y")


@_r.query(f"""
WITH {_POINTS}, l(joint, src) AS (VALUES (0, 0), (2, 6), (3, 8), (4, 10), (5, 5), (6, 7), (7, 9), (8, 12), (9, 14), (10, 16), (11, 11), (12, 13), (13, 15), (14, 2), (15, 1), (16, 4), (17, 3)),
n AS (SELECT vec_id, 1 AS joint, avg(x) AS x, avg(y) AS y, CASE WHEN min(score) > 0.3 THEN 1.0::DOUBLE ELSE 0 END AS score FROM kp WHERE joint IN (5, 6) GROUP BY vec_id)
SELECT vec_id, joint, round(x, 6) AS x, round(y, 6) AS y, round(score, 6) AS score FROM (
  SELECT kp.vec_id, l.joint, kp.x, kp.y, kp.score FROM kp JOIN l ON l.src = kp.joint UNION ALL SELECT * FROM n)
""")
def neck_joint(spark, sf):
    points = keypoints(spark, sf).withColumn("points", detect.with_neck(F.col("points")))
    return rounded(detect.flatten_points(points, "points", ["vec_id"]), "x", "y", "score")


@_r.query("""
WITH p AS (SELECT vec_id, [x::DOUBLE - 0.15 for x in embedding[1:32]] AS a, [x::DOUBLE - 0.15 for x in embedding[33:64]] AS b FROM embeddings),
v AS (SELECT *, least(list_max(a), list_max(b)) AS value FROM p)
SELECT vec_id, CASE WHEN value <= 0 THEN -0.5 ELSE (list_position(a, list_max(a)) - 1) / 2.0 END::DOUBLE AS x,
       CASE WHEN value <= 0 THEN -0.5 ELSE (list_position(b, list_max(b)) - 1) / 2.0 END::DOUBLE AS y, round(value, 6) AS score FROM v
""")
def response_peaks(spark, sf):
    """Half of a vector as the response along x, half as the response along y."""
    v = F.transform("embedding", lambda x: x.cast("double") - F.lit(0.15))
    out = table(spark, sf, "embeddings").select("vec_id", detect.peak(F.slice(v, 1, 32), F.slice(v, 33, 32)).alias("p"))
    return out.select("vec_id", "p.x", "p.y", r6("p.score").alias("score"))
