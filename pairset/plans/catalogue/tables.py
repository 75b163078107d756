"""Readers, writers, the standard cascade and small column operators, each over a test table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.functions import columns as C
from pairset.functions import logs
from pairset.operators import raster, sample
from pairset.operators.cascade import CurationLimits, ledger, standard_stages
from pairset.operators.evaluate import registry_table
from pairset.operators.joins import category_labels, index_with_stats
from pairset.operators.split import split_train_val
from pairset.plans.catalogue.common import Registry, r6, table
from pairset.schema import present, struct_of
from pairset.session import checkpoint_root
from pairset.sources import tables as io

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def measured_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with the columns of the pair index and its statistics; every eleventh has no score."""
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.when(F.col("l_linenumber") == 7, True).when(F.col("l_linenumber") < 6, False).alias("is_duplicate"),
        (F.col("l_quantity") > 3).alias("is_hi_res"),
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_discount")).alias("garment_score"),
        (F.col("l_tax") / 25).alias("person_frac"), (F.col("l_quantity") / 100).alias("top_frac"),
        (F.col("l_discount") / 5).alias("dress_frac"), (F.col("l_tax") / 5).alias("skirt_frac"), F.lit(0.0).alias("pants_frac"),
        (F.col("l_quantity") / 50).alias("flat_frac"), (F.col("l_partkey") % 40).cast("double").alias("colorfulness"),
        (F.col("l_linenumber") % 5).alias("n_components"),
    )


@_r.query("""
WITH t AS (SELECT CASE
    WHEN l_linenumber = 7 THEN 1 WHEN NOT l_quantity > 3 THEN 2
    WHEN l_suppkey % 11 = 0 OR NOT l_discount > 0 THEN 3 WHEN NOT l_tax / 25 < 0.002 THEN 4
    WHEN l_quantity / 100 > 0.10 AND l_quantity / 100 < 0.35 AND l_discount / 5 < 0.01 AND l_tax / 5 < 0.01 THEN 5
    WHEN l_quantity / 50 > 0.9 OR l_partkey % 40 < 8 THEN 6 WHEN NOT l_linenumber % 5 <= 3 THEN 7 END AS f FROM lineitem),
s(ordinal, stage) AS (VALUES (1, 'drop is_duplicate'), (2, 'require is_hi_res'), (3, 'garment_score > 0.0'),
  (4, 'person_frac < 0.002'), (5, 'reject part render'), (6, 'reject sketch'), (7, 'n_components <= 3')),
c AS (SELECT ordinal, stage, (SELECT count(*) FROM t WHERE f = ordinal) AS removed FROM s)
SELECT ordinal, stage, removed, CAST((SELECT count(*) FROM t) - sum(removed) OVER (ORDER BY ordinal) AS BIGINT) AS remaining FROM c
""")
def standard_cascade(spark, sf):
    """All stages of the standard curation, the two optional ones included."""
    limits = CurationLimits(enable_sketch_filter=True, enable_collage_filter=True)
    return ledger(measured_lines(spark, sf), standard_stages(limits))


@_r.query("""
SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, p_brand AS source,
       CASE WHEN p_size % 10 <> 0 THEN p_retailprice END AS cloth_mp FROM part
""")
def index_round_trip(spark, sf):
    """An index written as a table and read with its schema: ids keep their zeros, NaN becomes NULL."""
    path = _path(spark, "index")
    score = F.when(F.col("p_size") % 10 == 0, float("nan")).otherwise(F.col("p_retailprice"))
    io.write_table(table(spark, sf, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("id"), F.col("p_brand").alias("source"), score.alias("cloth_mp")), path)
    return io.read_index(spark, path).select("id", "source", "cloth_mp")


@_r.query("""
SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id, o_orderstatus AS mode, o_totalprice AS seconds FROM orders
""")
def manifest_round_trip(spark, sf):
    """A keyed CSV written and read again; the id stays text."""
    path = _path(spark, "manifest")
    rows = table(spark, sf, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("id"), F.col("o_orderstatus").alias("mode"), F.col("o_totalprice").alias("seconds"))
    io.write_csv(rows, path)
    return io.read_manifest(spark, path, struct_of("id string, mode string, seconds double"))


@_r.query("""
WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY CAST('0x' || substr(md5('1337:' || c_custkey), 1, 8) AS BIGINT), c_custkey) AS rn,
                  count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN rn <= greatest(1, CAST(floor(n * 0.05) AS BIGINT)) THEN 'val' ELSE 'train' END AS part FROM k
""")
def split_round_trip(spark, sf):
    """A split written in one folder per part and read again."""
    path = _path(spark, "split")
    labelled = split_train_val(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.05, 1337)
    io.write_splits(labelled, path)
    return spark.read.parquet(path).select("c_custkey", "part")


@_r.query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
def optional_columns(spark, sf):
    """Columns carried along where the table has them, in the order asked for."""
    part = table(spark, sf, "part")
    return part.where("p_size > 10").select(present(part, ["p_partkey", "p_name", "p_colour", "p_size"]))


@_r.query("""
WITH p AS (SELECT p_partkey, p_type FROM part ORDER BY CAST('0x' || substr(md5('4242:' || p_partkey), 1, 8) AS BIGINT), p_partkey LIMIT 60)
SELECT p_partkey, p_type, round(avg(l_quantity), 6) AS hue FROM p JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL
""")
def pool_with_profile(spark, sf):
    """A drawn pool with what was measured on its members; members without a measurement leave it."""
    pool = sample.first_in_hash_order(table(spark, sf, "part").select("p_partkey", "p_type"), 60, "p_partkey", 4242)
    profile = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(r6(F.avg("l_quantity")).alias("hue"))
    return index_with_stats(pool, profile, "p_partkey", ok=None)


@_r.query("SELECT doc_id, substr(text, 1, 80) AS head FROM documents")
def truncated_text(spark, sf):
    """A title cut for display."""
    return table(spark, sf, "documents").select("doc_id", C.truncated("text", 80).alias("head"))


@_r.query("SELECT o_orderkey, 'run_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run FROM orders")
def run_names(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", logs.run_name("run", F.col("o_orderdate")).alias("run"))


@_r.query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN 'quarantine' ELSE 'scored' END AS part FROM part
""")
def aligned_pairs(spark, sf):
    """Pairs of equal size, and those of different or unknown size beside them."""
    pairs = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").alias("pred_height"), F.col("p_size").alias("pred_width"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("truth_height"), (F.col("p_size") + (F.col("p_partkey") % 7 == 0).cast("int")).alias("truth_width"))
    good, bad = raster.aligned(pairs)
    return good.select("p_partkey", F.lit("scored").alias("part")).unionByName(bad.select("p_partkey", F.lit("quarantine").alias("part")))


@_r.query("""
WITH r(cat, role, label) AS (VALUES
  ('tops', 'mask', 'shirt'), ('tops', 'mask', 'arms'), ('tops', 'mask', 'torso'), ('tops', 'keep', 'face'), ('tops', 'keep', 'legs'), ('tops', 'keep', 'hands'),
  ('bottoms', 'mask', 'trousers'), ('bottoms', 'mask', 'legs'), ('bottoms', 'keep', 'face'), ('bottoms', 'keep', 'arms'), ('bottoms', 'keep', 'feet'))
SELECT n_nationkey, role, label FROM nation JOIN r ON cat = CASE WHEN n_nationkey % 2 = 0 THEN 'tops' ELSE 'bottoms' END
""")
def category_label_roles(spark, sf):
    """What each row's category masks and what it keeps."""
    roles = raster.category_roles(spark, {"full": ["dress"], "upper": ["shirt"], "lower": ["trousers"]}, ["face"], {"tops": "upper", "bottoms": "lower"})
    nation = table(spark, sf, "nation").withColumn("cat", F.when(F.col("n_nationkey") % 2 == 0, "tops").otherwise("bottoms"))
    return category_labels(nation, roles, "cat").select("n_nationkey", "role", "label")


@_r.query("""
SELECT l_returnflag, 'ssim' AS metric, true AS higher_is_better, round(max(l_discount), 6) AS best FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'lpips', false, round(min(l_tax), 6) FROM lineitem GROUP BY 1
""")
def best_by_direction(spark, sf):
    """The best value of each metric by the direction that the registry gives it."""
    values = table(spark, sf, "lineitem").select("l_returnflag", F.inline(F.array(
        F.struct(F.lit("ssim").alias("metric"), F.col("l_discount").alias("v")), F.struct(F.lit("lpips").alias("metric"), F.col("l_tax").alias("v")))))
    known = registry_table(spark).select(F.col("name").alias("metric"), "higher_is_better")
    best = F.when(F.col("higher_is_better"), F.max("v")).otherwise(F.min("v"))
    # The registry is code, so its size is known; dealt by metric, all values of one would be sorted in one task.
    return values.join(F.broadcast(known), "metric").groupBy("l_returnflag", "metric", "higher_is_better").agg(r6(best).alias("best"))
