"""The physical plans the operators are meant to have."""

import os

import pytest
from pyspark.sql import functions as F

from pairset.operators import incremental, runlog
from pairset.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def query(spark, name):
    return plan_of(catalogue.queries()[name](spark, SF))


def test_the_ledger_reads_each_table_once_and_shuffles_counts_only(spark):
    plan = query(spark, "cascade_ledger")
    assert plan.count("FileScan") == 2
    assert plan.count("Exchange SinglePartition") == 1 and "hashpartitioning" not in plan
    assert "text" not in plan


def test_survivor_filters_reach_the_scan(spark):
    plan = query(spark, "cascade_survivors")
    assert "GreaterThan(n_chars,500)" in plan and "LessThan(n_chars,12000)" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in plan


def test_a_split_does_not_shuffle(spark):
    assert "Exchange" not in query(spark, "split_train_val")


def test_axes_are_unfolded_after_the_aggregation(spark):
    plan = query(spark, "metric_by_axes")
    assert "Expand" not in plan
    below = plan[plan.index("Generate inline"):]
    assert below.count("HashAggregate(keys=[l_returnflag") == 2 and "l_linestatus" in below


def test_paired_metrics_are_aggregated_before_they_become_rows(spark):
    plan = query(spark, "paired_diff")
    assert plan.index("Generate inline") < plan.index("HashAggregate(keys=[]")


@pytest.mark.parametrize("name", ["top_k_per_group", "keep_latest", "dedupe_first"])
def test_groups_are_pruned_before_the_shuffle(spark, name):
    assert query(spark, name).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - {
    "refreshed_stats", "scored_by_model", "index_follow", "image_stats", "foreground_components", "dominant_hue",
    "canvas_label_counts", "keep_labels", "bounding_boxes", "dilated_masks", "flipped_rasters", "pair_scores",
    "overlap_suppression", "metrics_follow", "log_follow",
    # a digest over all ids in order is sequential by definition
    "manifest_hash"}))
def test_only_row_functions_leave_the_jvm(spark, name):
    plan = query(spark, name)
    assert "MapInPandas" not in plan and "Python" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_repeated_keys_merge_before_an_anti_join(spark):
    log = spark.range(100).select((F.col("id") % 2).alias("id"), F.concat(F.lit("m"), F.col("id") % 3).alias("mode"))
    work = incremental.worklist(spark.range(10), ["m", "n"])
    plan = plan_of(incremental.pending(work, log))
    assert "LeftAnti" in plan and "HashAggregate(keys=[mode" in plan


def test_the_metric_registry_is_joined_where_the_values_are(spark, out):
    at = "spark.sql.autoBroadcastJoinThreshold"
    lines = [("N", 0.02, 0.08), ("N", 0.05, 0.01), ("R", None, 0.03), (None, 0.04, 0.0)]
    spark.createDataFrame(lines, "l_returnflag string, l_discount double, l_tax double").write.parquet(f"{out}/lineitem.parquet")
    before = spark.conf.get(at)
    spark.conf.set(at, "-1")  # no side counts as small, as with a large table
    try:
        found = catalogue.queries()["best_by_direction"](spark, out)
        plan = plan_of(found)
        got = {(r["l_returnflag"], r["metric"]): (r["higher_is_better"], r["best"]) for r in found.collect()}
    finally:
        spark.conf.set(at, before)
    assert "SortMergeJoin" not in plan and "hashpartitioning(metric" not in plan and "BuildRight" in plan
    assert got == {("N", "ssim"): (True, 0.05), ("N", "lpips"): (False, 0.01), ("R", "ssim"): (True, None),
                   ("R", "lpips"): (False, 0.03), (None, "ssim"): (True, 0.04), (None, "lpips"): (False, 0.0)}


def test_log_lines_are_searched_once(spark):
    lines = spark.createDataFrame([("r", "x")], "run string, value string")
    plan = plan_of(runlog.parse_steps(lines))
    assert plan.count("regexp_extract_all") == 1 and "RLIKE" not in plan
