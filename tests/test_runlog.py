import pytest
from pyspark.sql import functions as F

from pairset.operators import runlog
from tests.conftest import rows

LINES = [
    "2026-01-01 10:00:00 - INFO - epoch 0 | step 5/450 | loss 0.0401 (avg 0.0410) | lr 1.00e-04 | 13.60s/it | eta 1h40m | vram 2.10/3.00GB | gpu 99% 70C | ram 4.1GB | gnorm 0.213",
    "\x1b[32mepoch 1 | step 10/450 | loss 0.0301 (avg 0.0390) | lr 9.5e-05 | 13.00s/it\x1b[0m | vram 2.20/3.10GB | gpu 98% 75C",
    "epoch 1 | st\x1b[1mep 15/450 | loss nan (avg 0.0380) | lr 9.0e-05 | 12.50s/it",
    "epoch 2 | step 20/450 | loss 1.2e-3 (avg 0.0200) | lr 9.0e-05 | 12.50s/it",
    "2026-01-01 10:05:00 - INFO - [validation] epoch 0 step 25 | val_loss 0.0354  val_batches 24.0000",
    "[validation] epoch 1 step 50 | val_loss nan  val_batches 24.0000",
    "something else | step over", "",
]


def lines(spark):
    return spark.createDataFrame([("r", x) for x in LINES], "run string, value string")


def test_steps(spark):
    got = runlog.parse_steps(lines(spark)).orderBy("step").collect()
    assert [tuple(r) for r in got] == [
        ("r", 0, 5, 0.0401, 0.0410, 1e-4, 13.6, 2.1, 3.0, 99.0, 70.0, 0.213),
        ("r", 1, 10, 0.0301, 0.0390, 9.5e-5, 13.0, 2.2, 3.1, 98.0, 75.0, None),
        ("r", 1, 15, None, 0.0380, 9e-5, 12.5, None, None, None, None, None),
        ("r", 2, 20, 0.0012, 0.02, 9e-5, 12.5, None, None, None, None, None),
    ]


def test_validations(spark):
    assert sorted(tuple(r) for r in runlog.parse_validations(lines(spark)).collect())[0] == ("r", 0, 25, 0.0354)
    assert runlog.parse_validations(lines(spark)).where("val_loss is null").count() == 1


def test_summary(spark):
    row = runlog.summarise(runlog.parse_steps(lines(spark)), ["run"]).first()
    assert (row["n_steps"], row["first_avg"], row["last_avg"], row["peak_vram"], row["min_temp"], row["max_temp"]) == (4, 0.041, 0.02, 3.1, 70.0, 75.0)
    assert row["reduction_pct"] == pytest.approx(100 * (1 - 0.02 / 0.041))


@pytest.mark.parametrize("block", [1_000_000, 8])
def test_micro_batches_skip_failures_and_drop_the_rest(spark, block):
    df = spark.createDataFrame([("a", i, None if i % 5 == 0 else float(i)) for i in range(30)], "run string, i int, loss double")
    got = runlog.micro_batch_means(df, ["run"], ["i"], "loss", 4, block_rows=block)
    values = [float(i) for i in range(30) if i % 5]
    assert rows(got, "step", "loss") == [(k + 1, sum(values[4 * k:4 * k + 4]) / 4) for k in range(6)]


def test_validation_mean(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 100.0), ("b", 1, None)], "run string, i int, v double")
    assert rows(runlog.validation_mean(df, ["run"], ["i"], "v", 2)) == [("a", 2.0, 2), ("b", 0.0, 0)]
    assert rows(runlog.validation_mean(df, ["run"], ["i"], "v"), "run", "val_batches") == [("a", 3), ("b", 0)]


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "best"), ("a", 2, "e2"), ("a", 3, "e3"), ("a", 4, "latest"), ("b", 1, "e1")], "run string, seq int, name string")
    assert rows(runlog.keep_last(df, ["run"], "seq", "name", 2)) == [("a", 1, "best"), ("a", 3, "e3"), ("a", 4, "latest"), ("b", 1, "e1")]
    assert runlog.keep_last(df, ["run"], "seq", "name", 0).count() == 5


def test_violations(spark):
    df = spark.createDataFrame([("a", 24, 0.5), ("b", 25, 1.5), ("c", 12, None)], "id string, side int, p double")
    rules = {"divisible": F.col("side") % 12 == 0, "probability": F.col("p").between(0, 1)}
    assert rows(runlog.violations(df, "id", rules)) == [("b", "divisible"), ("b", "probability"), ("c", "probability")]


def test_parameter_totals_of_nothing(spark):
    df = spark.createDataFrame([], "name string, numel bigint, trainable boolean")
    assert tuple(runlog.parameter_totals(df).first())[:4] == (0, 0, 0, 0.0)


def test_memory_estimate(spark):
    df = spark.createDataFrame([("a", 10**9, False), ("b", 10**8, True), ("c", 10**8, None)], "name string, numel bigint, trainable boolean")
    row = runlog.parameter_totals(df).first()
    assert (row["total"], row["trainable"], row["frozen"]) == (12 * 10**8, 10**8, 11 * 10**8)
    assert (row["frozen_weights_gb"], row["gradients_gb"], row["optimizer_state_gb"]) == (2.2, 0.4, 0.2)
    assert row["static_total_gb"] == pytest.approx(3.2)


def test_groups_that_reach_over_an_epoch(spark):
    data = [("r", i, e, float(v)) for i, (e, v) in enumerate([(0, 1), (0, 2), (0, 3), (1, 10), (1, 20), (1, 30), (1, 40)])]
    df = spark.createDataFrame(data, "run string, i int, epoch int, loss double")
    got = runlog.micro_batch_means(df, ["run"], ["i"], "loss", 2, epoch="epoch")
    assert rows(got, "step", "loss") == [(1, 1.5), (2, 10.0), (3, 25.0)]
