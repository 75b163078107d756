"""Raster jobs over byte rasters built from the embedding vectors: 8 x 8 pixels, three rotated channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.functions.keys import chosen_with_probability
from pairset.operators import evaluate, raster
from pairset.plans.catalogue.common import Registry, rounded, table
from pairset.session import spread

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

SIDE = 8
# Canvases in one task: 7 MB of pixels.
CANVASES = 1_000


def _binary(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def _bytes_of(vector: str) -> Column:
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.5) * 255.0), F.lit(0)), F.lit(255)).cast("int"))


def rasters(spark: SparkSession, sf: str, task_rows: int | None = None) -> DataFrame:
    b = spread(table(spark, sf, "embeddings"), task_rows).select("vec_id", _bytes_of("embedding").alias("b"))
    at = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))

    def shifted(i: Column, by: int) -> Column:
        return F.get("b", (i + by) % (SIDE * SIDE))

    rgb = F.flatten(F.transform(at, lambda i: F.array(shifted(i, 0), shifted(i, 21), shifted(i, 42))))
    return b.select(
        "vec_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), _binary(rgb).alias("data"),
        _binary(F.transform("b", lambda x: x % 4)).alias("labels"),
        _binary(F.transform("b", lambda x: (x >= 150).cast("int"))).alias("mask"),
    )


_PIXELS = """
b AS (SELECT vec_id, [greatest(0, least(255, CAST(floor((x::DOUBLE + 0.5) * 255) AS INTEGER))) for x in embedding] AS v FROM embeddings),
px AS MATERIALIZED (SELECT vec_id, i // 8 AS y, i % 8 AS x, v[i + 1] AS r, v[(i + 21) % 64 + 1] AS g, v[(i + 42) % 64 + 1] AS b FROM b CROSS JOIN range(64) t(i))
"""


def canvases(spark: SparkSession, sf: str) -> DataFrame:
    """The rasters on a 48 x 48 canvas, where each of their pixels covers 6 x 6."""
    placed = raster.to_canvas(rasters(spark, sf, CANVASES).select("vec_id", "height", "width", "data"), 48, 48, id_col="vec_id")
    return placed.select("vec_id", F.col("out_height").alias("height"), F.col("out_width").alias("width"),
                         F.col("out_data").alias("data"))


# Box sums run along rows, then along columns, over a frame mirrored at its border.
@_r.query(f"""
WITH {_PIXELS},
g AS MATERIALIZED (SELECT vec_id, y, x, CAST(round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS BIGINT) AS v FROM px),
pos AS (SELECT i, CASE WHEN i < 0 THEN -i WHEN i > 47 THEN 94 - i ELSE i END // 6 AS at FROM range(-2, 50) t(i)),
frame AS (SELECT vec_id, a.i AS y, b.i AS x, v FROM pos a CROSS JOIN pos b JOIN g ON g.y = a.at AND g.x = b.at),
s1 AS (SELECT vec_id, y, x, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM frame WINDOW w AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s2 AS (SELECT vec_id, y, x, (sum(s) OVER w)::DOUBLE / 25 AS m, (sum(q) OVER w)::DOUBLE / 25 AS mq FROM s1 WINDOW w AS (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
f AS (SELECT vec_id, avg(CASE WHEN sqrt(greatest(mq - m * m, 0)) < 3 THEN 1 ELSE 0 END) AS flat_frac FROM s2 WHERE y BETWEEN 0 AND 47 AND x BETWEEN 0 AND 47 GROUP BY vec_id),
c AS (SELECT vec_id, avg(CASE WHEN least(r, g, b) >= 110 THEN 1 ELSE 0 END) AS white_frac,
             sqrt(var_pop(abs(r - g)) + var_pop(abs((r + g) / 2.0::DOUBLE - b))) + 0.3 * sqrt(avg(abs(r - g)) ** 2 + avg(abs((r + g) / 2.0::DOUBLE - b)) ** 2) AS colorfulness FROM px GROUP BY vec_id)
SELECT vec_id, round(white_frac, 6) AS white_frac, round(colorfulness, 6) AS colorfulness, round(flat_frac, 6) AS flat_frac, TRUE AS probe_ok FROM c JOIN f USING (vec_id)
""")
def image_stats(spark, sf):
    out = raster.image_stats(canvases(spark, sf), "vec_id", white_at=110).drop("n_components", "probe_error")
    return rounded(out, "white_frac", "colorfulness", "flat_frac")


# Opening and closing are running minima and maxima along rows and columns; blobs are connected runs of
# pixels, whose labels sink to the lowest one in reach.
@_r.query(f"""
WITH RECURSIVE {_PIXELS},
g AS (SELECT vec_id, y, x, CAST(round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS INTEGER) AS v FROM px),
h AS (SELECT vec_id, v, count(*)::DOUBLE AS n FROM g GROUP BY vec_id, v),
c AS (SELECT vec_id, v, sum(n) OVER w AS lo, sum(n * v) OVER w AS lo_sum, sum(n) OVER p AS n, sum(n * v) OVER p AS all_sum
      FROM h WINDOW w AS (PARTITION BY vec_id ORDER BY v), p AS (PARTITION BY vec_id)),
t AS (SELECT vec_id, coalesce(arg_min(v, {{'s': -((all_sum * lo / n - lo_sum) ** 2 / (lo * (n - lo))), 'v': v}}) FILTER (lo < n), 0) AS level FROM c GROUP BY vec_id),
m0 AS (SELECT vec_id, y * 6 + oy AS y, x * 6 + ox AS x, v <= level AS f FROM g JOIN t USING (vec_id) CROSS JOIN range(6) a(oy) CROSS JOIN range(6) b(ox)),
m1 AS (SELECT vec_id, y, x, min(f) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS f FROM m0),
m2 AS (SELECT vec_id, y, x, min(f) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS f FROM m1),
m3 AS (SELECT vec_id, y, x, max(f) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS f FROM m2),
m4 AS (SELECT vec_id, y, x, max(f) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS f FROM m3),
m5 AS (SELECT vec_id, y, x, min(f) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS f FROM m4),
m6 AS (SELECT vec_id, y, x, min(f) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS f FROM m5),
i AS (SELECT vec_id, y, x, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS island FROM m6 WHERE f),
run AS MATERIALIZED (SELECT vec_id, y, min(x) AS x1, max(x) AS x2, count(*) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY y, min(x)) AS id FROM i GROUP BY vec_id, y, island),
touch AS (SELECT a.vec_id, a.id AS p, b.id AS q FROM run a JOIN run b ON a.vec_id = b.vec_id AND b.y = a.y + 1 AND b.x1 <= a.x2 + 1 AND b.x2 >= a.x1 - 1),
edge AS MATERIALIZED (SELECT * FROM touch UNION ALL SELECT vec_id, q, p FROM touch UNION ALL SELECT vec_id, id, id FROM run),
lab AS (
  SELECT 0 AS step, vec_id, id, id AS label FROM run
  UNION ALL
  SELECT any_value(lab.step) + 1, edge.vec_id, edge.p, min(lab.label) FROM lab JOIN edge ON edge.vec_id = lab.vec_id AND edge.q = lab.id
  WHERE lab.step < 250 GROUP BY edge.vec_id, edge.p),
blob AS (SELECT lab.vec_id, lab.label, sum(run.n) AS n FROM lab JOIN run ON run.vec_id = lab.vec_id AND run.id = lab.id WHERE step = 250 GROUP BY ALL)
SELECT e.vec_id, CAST(count(blob.n) FILTER (blob.n >= 0.02 * 48 * 48) AS INTEGER) AS n_components FROM embeddings e LEFT JOIN blob USING (vec_id) GROUP BY e.vec_id
""")
def foreground_components(spark, sf):
    """Number of large dark blobs on a 48 x 48 canvas."""
    return raster.image_stats(canvases(spark, sf), "vec_id").select("vec_id", "n_components")


@_r.query(f"""
WITH {_PIXELS},
m AS (SELECT *, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo FROM px),
t AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN rr = hi THEN (hi - bb) / (hi - lo) - (hi - gg) / (hi - lo)
        WHEN gg = hi THEN 2 + (hi - rr) / (hi - lo) - (hi - bb) / (hi - lo) ELSE 4 + (hi - gg) / (hi - lo) - (hi - rr) / (hi - lo) END / 6 AS q FROM m),
hsv AS (SELECT vec_id, q - floor(q) AS h, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS s, hi AS v FROM t),
k AS (SELECT *, s > 0.15 AND v > 0.15 AND v < 0.97 AS vivid FROM hsv),
e AS (SELECT *, count(*) FILTER (vivid) OVER (PARTITION BY vec_id) > 50 AS enough FROM k),
u AS (SELECT *, CAST(floor(h * 18) AS INTEGER) AS bin FROM e WHERE vivid OR NOT enough),
n AS (SELECT vec_id, bin, count(*) AS n FROM u GROUP BY vec_id, bin),
w AS (SELECT vec_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, bin) AS rn FROM n) WHERE rn = 1)
SELECT vec_id, round((any_value(w.bin) + 0.5) / 18.0::DOUBLE, 6) AS hue, round(avg(s), 6) AS sat, round(avg(v), 6) AS val FROM u JOIN w USING (vec_id) GROUP BY vec_id
""")
def dominant_hue(spark, sf):
    out = raster.dominant_hue(raster.pixel_table(rasters(spark, sf), "vec_id"), "vec_id")
    return rounded(out, "hue", "sat", "val")


_LOOKUP = {1: "face", 2: "top", 3: "dress", 4: "skirt", 5: "pants", 6: "hair", 7: "arms"}


@_r.query("""
SELECT l_orderkey, round(sum(l_quantity) FILTER (l_linenumber IN (1, 6, 7)) / sum(l_quantity), 6) AS person_frac,
       round(sum(l_quantity) FILTER (l_linenumber IN (1, 6)) / sum(l_quantity), 6) AS face_frac,
       coalesce(sum(l_quantity) FILTER (l_linenumber IN (1, 6)) / sum(l_quantity) >= 0.25, FALSE) AS flagged
FROM lineitem GROUP BY l_orderkey
""".replace("round(sum(l_quantity) FILTER", "round(coalesce(sum(l_quantity) FILTER").replace(")) / sum(l_quantity), 6)", ")), 0) / sum(l_quantity), 6)"))
def label_shares(spark, sf):
    """Line numbers as segmentation classes, quantities as pixel counts."""
    lookup = spark.createDataFrame(list(_LOOKUP.items()), "label_id int, name string")
    long = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("label_id"), F.col("l_quantity").cast("bigint").alias("n_pixels"))
    sets = {k: raster.SHARE_SETS[k] for k in ("person_frac", "face_frac")}
    out = raster.label_shares(long, lookup, sets, "l_orderkey").withColumn("flagged", raster.share_flag("face_frac", 0.25))
    return rounded(out, "person_frac", "face_frac")


@_r.query(f"""
WITH {_PIXELS}, l AS (SELECT vec_id, y, x, r % 4 AS label FROM px),
s AS (SELECT vec_id, l.label FROM l CROSS JOIN range(20) a(oy) CROSS JOIN range(20) b(ox)
      WHERE CAST(floor((a.oy + 0.5) * 8 / 20) AS INTEGER) = l.y AND CAST(floor((b.ox + 0.5) * 8 / 20) AS INTEGER) = l.x
      UNION ALL SELECT vec_id, 0 FROM embeddings CROSS JOIN range(20 * 4))
SELECT vec_id, label AS label_id, count(*) AS n_pixels FROM s GROUP BY vec_id, label
""")
def canvas_label_counts(spark, sf):
    """Label maps brought onto a 24 x 20 canvas by nearest neighbour, then counted."""
    maps = rasters(spark, sf).select("vec_id", "height", "width", F.col("labels").alias("data"))
    placed = raster.to_canvas(maps, 24, 20, channels=1, id_col="vec_id")
    return raster.label_counts(placed.select("vec_id", F.col("out_data").alias("data")), "vec_id")


@_r.query(f"""
WITH {_PIXELS}, k AS (SELECT vec_id, r % 4 IN (1, 2) AS shown, r, g, b FROM px),
c AS (SELECT vec_id, CASE WHEN shown THEN r ELSE 127 END AS r, CASE WHEN shown THEN g ELSE 127 END AS g, CASE WHEN shown THEN b ELSE 127 END AS b FROM k)
SELECT vec_id, r, g, b, count(*) AS n FROM c GROUP BY ALL
""")
def keep_labels(spark, sf):
    """Pixels outside two labels greyed out; the result as colour counts."""
    kept = raster.keep_labels(rasters(spark, sf), [1, 2], "vec_id")
    return raster.pixel_table(kept, "vec_id")


@_r.query(f"""
WITH {_PIXELS}, m AS (SELECT * FROM px WHERE r >= 150)
SELECT e.vec_id, CAST(min(x) AS INTEGER) AS x1, CAST(min(y) AS INTEGER) AS y1, CAST(max(x) AS INTEGER) AS x2, CAST(max(y) AS INTEGER) AS y2,
       count(x) AS area, coalesce((max(x) - min(x) + 1) * (max(y) - min(y) + 1), 0) AS box_area FROM embeddings e LEFT JOIN m USING (vec_id) GROUP BY e.vec_id
""")
def bounding_boxes(spark, sf):
    return raster.bounding_boxes(rasters(spark, sf), "vec_id").drop("ok", "error")


@_r.query(f"""
WITH {_PIXELS}, m AS (SELECT vec_id, x, y FROM px WHERE r >= 150),
d AS (SELECT DISTINCT vec_id, x + dx AS x, y + dy AS y FROM m CROSS JOIN range(-1, 3) a(dx) CROSS JOIN range(-2, 2) b(dy)),
i AS (SELECT * FROM d WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7)
SELECT e.vec_id, CAST(min(x) AS INTEGER) AS x1, CAST(min(y) AS INTEGER) AS y1, CAST(max(x) AS INTEGER) AS x2, CAST(max(y) AS INTEGER) AS y2,
       count(x) AS area, coalesce((max(x) - min(x) + 1) * (max(y) - min(y) + 1), 0) AS box_area FROM embeddings e LEFT JOIN i USING (vec_id) GROUP BY e.vec_id
""")
def dilated_masks(spark, sf):
    """Masks grown 1 left, 2 right, 2 up and 1 down, then boxed."""
    grown = raster.dilated(rasters(spark, sf), left=1, right=2, up=2, down=1, id_col="vec_id")
    return raster.bounding_boxes(grown.drop("ok", "error"), "vec_id").drop("ok", "error")


@_r.query(f"""
WITH {_PIXELS}, f AS (SELECT vec_id, CAST('0x' || substr(md5('7:' || vec_id), 1, 8) AS BIGINT) < 2147483648 AS flip FROM embeddings)
SELECT vec_id, CAST(max(r) FILTER (x = 0 AND y = 0) AS BIGINT) AS first_red, CAST(max(b) FILTER (x = 7 AND y = 7) AS BIGINT) AS last_blue FROM (
  SELECT px.vec_id, CASE WHEN flip THEN 7 - x ELSE x END AS x, y, r, b FROM px JOIN f USING (vec_id)) GROUP BY vec_id
""")
def flipped_rasters(spark, sf):
    """Half of the rasters mirrored, told by two corner bytes."""
    out = raster.flipped(rasters(spark, sf), chosen_with_probability("vec_id", 0.5, 7), "vec_id")

    def byte(at: int) -> Column:
        return F.conv(F.hex(F.substring("data", at, 1)), 16, 10).cast("bigint")

    return out.select("vec_id", byte(1).alias("first_red"), byte(SIDE * SIDE * 3).alias("last_blue"))


_PAIR = f"""
WITH {_PIXELS},
ch AS MATERIALIZED (SELECT vec_id, y, x, 'r' AS c, r::DOUBLE AS v, r >= 150 AS m FROM px UNION ALL SELECT vec_id, y, x, 'g', g, r >= 150 FROM px UNION ALL SELECT vec_id, y, x, 'b', b, r >= 150 FROM px),
pt AS MATERIALIZED (SELECT t.vec_id, t.y, t.x, t.c, p.v AS p, t.v AS t, t.m, CASE WHEN t.m THEN p.v ELSE t.v END AS q
       FROM ch t JOIN ch p ON p.vec_id = t.vec_id + 1 AND p.y = t.y AND p.x = t.x AND p.c = t.c),
w AS (SELECT pt.vec_id, c, oy, ox, count(*) AS n, avg(p) AS mp, avg(q) AS mq, avg(t) AS mt, avg(p * p) AS pp, avg(q * q) AS qq, avg(t * t) AS tt, avg(p * t) AS pt_, avg(q * t) AS qt
      FROM pt CROSS JOIN range(2) a(oy) CROSS JOIN range(2) b(ox) WHERE y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY ALL),
s AS (SELECT vec_id,
  avg((2 * mp * mt + 6.5025) * (2 * 49.0 / 48 * (pt_ - mp * mt) + 58.5225) / ((mp * mp + mt * mt + 6.5025) * (49.0 / 48 * (pp - mp * mp + tt - mt * mt) + 58.5225))) AS ssim,
  avg((2 * mq * mt + 6.5025) * (2 * 49.0 / 48 * (qt - mq * mt) + 58.5225) / ((mq * mq + mt * mt + 6.5025) * (49.0 / 48 * (qq - mq * mq + tt - mt * mt) + 58.5225))) AS masked_ssim
  FROM w GROUP BY vec_id),
e AS (SELECT vec_id, avg((p - t) ** 2) AS mse, avg((p - t) ** 2) FILTER (m) AS mse_m, bool_or(m) AS any_mask FROM pt GROUP BY vec_id)
"""


@_r.query(_PAIR + """
SELECT vec_id, round(ssim, 6) AS ssim, round(10 * log10(65025.0::DOUBLE / nullif(mse, 0)), 6) AS psnr, CAST(NULL AS DOUBLE) AS lpips,
       round(CASE WHEN any_mask THEN masked_ssim END, 6) AS masked_ssim, round(10 * log10(65025.0::DOUBLE / nullif(mse_m, 0)), 6) AS masked_psnr, TRUE AS ok
FROM s JOIN e USING (vec_id)
""")
def pair_scores(spark, sf):
    """Similarity of each raster and its neighbour, over the frame and inside the mask."""
    base = rasters(spark, sf)
    pred = base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("data").alias("pred"))
    pairs = base.select("vec_id", "height", "width", F.col("data").alias("truth"), "mask").join(pred, "vec_id")
    names = ["ssim", "psnr", "lpips", "masked_ssim", "masked_psnr"]
    return rounded(evaluate.score_pairs(pairs, names, "vec_id").drop("error"), *names)
