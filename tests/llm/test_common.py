import os
import time

from pyspark.sql import functions as F

from pairset.llm import common


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in (files.apply(i).getName() for i in range(files.size())) if x.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    setting, before = spark.conf.get(common.CLEANUP, "false"), shuffle_files(spark)
    rows = spark.range(10_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count("*").alias("n"))
    got = common.stored(rows, "counted")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert got.agg(F.count("*"), F.sum("n")).first() == (7_000, 10_000)
    assert spark.conf.get(common.CLEANUP, "false") == setting


def test_a_discarded_table_is_gone_and_others_stay(spark):
    one, two = (common.stored(spark.range(5), name, compression) for name, compression in [("one", "zstd"), ("two", None)])
    at = [x.stored_at.removeprefix("file:") for x in (one, two)]
    common.discard(one)
    assert not os.path.exists(at[0]) and os.path.exists(at[1]) and two.count() == 5
