import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairset.operators import cascade, split
from pairset.operators.cascade import Stage
from pairset.plans.curation import curate, write_curation
from pairset.sources import versions
from tests.conftest import rows

# The ids of a frozen 24-sample subset, whose manifest is known.
FROZEN = (
    "0000427 0000525 0000841 0000925 0003039 0003836 0004152 0004332 "
    "0004333 0005233 0005557 0005581 0007889 0008104 0009798 0010951 "
    "0011193 0011410 0012112 0012418 0012467 0012479 0012829 0014046 "
).split()
FROZEN_MANIFEST = "e9697498c62a0ba5"


def published_index(spark):
    """A table that loses exactly the published number of rows at each stage."""
    n = F.col("n")
    base = spark.range(14_069).select(F.col("id").alias("n"), F.lpad(F.col("id").cast("string"), 7, "0").alias("id"))
    index = base.select(
        "id", (n < 144).alias("is_duplicate"), (n >= 144 + 666).alias("is_hi_res"),
        F.when(n < 144 + 666 + 5185, 0.0).otherwise(0.02).alias("garment_score"),
        F.when(n >= 14_069 - 227, "test").otherwise("train").alias("split"))
    at = 144 + 666 + 5185
    stats = base.select(
        "id", F.when(n < at + 3304, 0.1).otherwise(0.0).alias("person_frac"),
        F.when(n < at + 3304 + 2503, 0.2).otherwise(0.7).alias("top_frac"), F.lit(0.0).alias("dress_frac"),
        F.lit(0.0).alias("skirt_frac"), F.lit(0.0).alias("pants_frac"), F.lit(0.5).alias("flat_frac"),
        F.lit(20.0).alias("colorfulness"), F.lit(1).alias("n_components"), F.lit(True).alias("probe_ok"))
    return index, stats


def test_published_counts(spark, out):
    result = curate(*published_index(spark))
    ledger = [(r["removed"], r["remaining"]) for r in result.ledger.orderBy("ordinal").collect()]
    assert ledger == [(144, 13_925), (666, 13_259), (5_185, 8_074), (3_304, 4_770), (2_503, 2_267)]
    assert dict(rows(result.sizes, "part", "n")) == {"train": 1_938, "val": 102, "test": 227}
    assert write_curation(result, out) == f"{out}/version=0"
    out = versions.current(spark, out)
    assert spark.read.parquet(f"{out}/splits").where("part = 'val'").count() == 102
    summary = spark.read.json(f"{out}/cleaning_summary").first()
    assert (summary["input_pairs"], summary["clean_pairs"], summary["train"], summary["validation"]) == (14_069, 2_267, 1_938, 102)
    assert spark.read.option("header", True).csv(f"{out}/cleaning_stages").count() == 5


def test_a_writer_that_dies_leaves_the_version_before(spark, out):
    def write(n, fail=False):
        def run(folder):
            spark.range(n).write.mode("overwrite").parquet(f"{folder}/splits")
            if fail:
                raise RuntimeError("killed")
            spark.range(n).write.mode("overwrite").parquet(f"{folder}/ledger")

        return run

    with pytest.raises(FileNotFoundError):
        versions.current(spark, out)
    assert versions.publish(spark, out, write(3)) == 0
    with pytest.raises(RuntimeError):
        versions.publish(spark, out, write(5, fail=True))
    assert spark.read.parquet(f"{versions.current(spark, out)}/splits").count() == 3
    assert versions.publish(spark, out, write(7)) == 1
    assert [spark.read.parquet(f"{versions.current(spark, out)}/{t}").count() for t in ("splits", "ledger")] == [7, 7]


def test_optional_filters(spark):
    index, stats = published_index(spark)
    limits = cascade.CurationLimits(enable_sketch_filter=True, enable_collage_filter=True, max_flat_fraction=0.4)
    ledger = curate(index, stats, limits).ledger.orderBy("ordinal").collect()
    assert [r["removed"] for r in ledger[5:]] == [2_267, 0]


def test_unknown_values_fail_a_stage(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.5), (4, -1.0)], "id int, v double")
    df = df.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    stages = [Stage("positive", F.col("v") > 0), Stage("never", F.lit(True))]
    ledger = rows(cascade.ledger(df, stages), "ordinal", "stage", "removed", "remaining")
    assert ledger == [(1, "positive", 3, 1), (2, "never", 0, 1)]
    assert rows(cascade.survivors(df, stages), "id") == [(3,)]


def test_unknown_duplicate_flag_is_kept(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, is_duplicate boolean")
    stage = cascade.standard_stages()[0]
    assert rows(cascade.survivors(df, [stage]), "id") == [(1,), (3,)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, v double")
    assert rows(cascade.ledger(df, [Stage("a", F.col("v") > 0)]), "removed", "remaining") == [(0, 0)]


def test_failed_probes_are_left_out(spark):
    index = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "train")], "id string, split string")
    stats = spark.createDataFrame([("a", True), ("b", False), ("z", True)], "id string, probe_ok boolean")
    result = curate(index, stats, stages=[Stage("all", F.lit(True))])
    assert rows(result.clean, "id") == [("a",)]
    assert rows(result.sizes) == [("val", 1)]


def brute_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).digest()[:4], i))


@pytest.mark.parametrize("bounded", [0, 100_000])
@pytest.mark.parametrize("n", [1, 17, 499, 500, 900])
def test_hash_cut_takes_the_first_rows(spark, n, bounded):
    ids = [f"{i:05d}" for i in range(500)]
    df = spark.createDataFrame([(i,) for i in random.Random(n).sample(ids, len(ids))], "id string")
    cut = split.hash_cut(df, "id", 7, n=n, bounded_rows=bounded)
    got = {r["id"] for r in df.where(cut.contains("id", 7)).collect()}
    assert got == set(brute_order(ids, 7)[:n])
    assert cut.inside == min(n, 500) and cut.total == 500


def test_split_parts_are_disjoint_and_stable(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split"))
    first = split.split_train_val(df, fraction=0.05, pool=F.col("split") == "train")
    again = split.split_train_val(df.orderBy(F.rand(3)), fraction=0.05, pool=F.col("split") == "train")
    assert dict(rows(split.split_sizes(first))) == {"test": 100, "train": 855, "val": 45}
    assert rows(first, "id", "part") == rows(again, "id", "part")


def test_split_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([("a",)], "id string")
    assert rows(split.split_train_val(one), "part") == [("val",)]
    assert split.split_train_val(one.limit(0)).count() == 0


def test_manifest_of_the_frozen_subset(spark):
    df = spark.createDataFrame([(i,) for i in reversed(FROZEN)], "id string")
    assert tuple(split.manifest_hash(df).first()) == (24, FROZEN_MANIFEST)


def test_manifest_of_any_size(spark, monkeypatch):
    import hashlib

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = split.manifest_hash(spark.range(2_500).withColumn("id", F.lpad(F.col("id").cast("string"), 6, "0")).repartition(7)).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = hashlib.sha256(",".join(f"{i:06d}" for i in range(2_500)).encode()).hexdigest()[:16]
    assert (got.n, got.manifest) == (2_500, want)
    none = split.manifest_hash(spark.range(0)).first()
    assert (none.n, none.manifest) == (0, hashlib.sha256(b"").hexdigest()[:16])


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(1000)
    same = split.fingerprint(df.orderBy(F.desc("id"))).first()
    assert split.fingerprint(df).first() == same
    assert split.fingerprint(df.where("id != 5")).first() != same
