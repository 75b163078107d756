"""Blocked layouts against plain windows, on series far longer than a block."""

import random

import pytest
from pyspark.sql import functions as F

from pairset.operators import sequence
from tests.conftest import rows

KEYS, ORDER = ["run"], ["step"]


@pytest.fixture(scope="module")
def table(spark):
    """One run holds a third of the rows, one key is NULL, some values are missing."""
    rnd = random.Random(5)
    data = [("hot", i * 3, rnd.random() if rnd.random() > 0.1 else None) for i in range(400)]
    data += [(f"r{rnd.randrange(12)}", 10_000 + i, round(rnd.random(), 2)) for i in range(700)]
    data += [(None, i, rnd.random()) for i in range(100)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "run string, step int, v double").cache()


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:2] == y[:2]
        for p, q in zip(x[2:], y[2:]):
            assert p == q or p == pytest.approx(q, abs=1e-9)


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] or "", r[1]))


@pytest.mark.parametrize("block", [50, 128])
def test_rolling_mean(table, block):
    plain = sequence.rolling_mean(table, KEYS, ORDER, "v", 30)
    blocked = sequence.rolling_mean(table, KEYS, ORDER, "v", 30, block_rows=block)
    close(ordered(blocked.select("run", "step", "rolling_mean")), ordered(plain.select("run", "step", "rolling_mean")))


def test_rolling_mean_against_a_deque(table):
    from collections import defaultdict, deque

    windows = defaultdict(lambda: deque(maxlen=30))
    want = {}
    for r in sorted(table.collect(), key=lambda r: r["step"]):
        held = windows[r["run"]]
        if r["v"] is not None:
            held.append(r["v"])
        want[r["run"], r["step"]] = sum(held) / len(held) if held else None
    got = {(r["run"], r["step"]): r["rolling_mean"] for r in sequence.rolling_mean(table, KEYS, ORDER, "v", 30, block_rows=64).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("block_rows", [20, 7])
def test_a_frame_may_span_several_blocks(table, block_rows):
    names = ("run", "step", "rolling_mean")
    plain = sequence.rolling_mean(table, KEYS, ORDER, "v", 30).select(*names)
    blocked = sequence.rolling_mean(table, KEYS, ORDER, "v", 30, block_rows=block_rows).select(*names)
    close(ordered(blocked), ordered(plain))


@pytest.mark.parametrize("block_rows", [100, 3])
def test_rows_without_a_value_keep_the_last_mean(spark, block_rows):
    data = [("a", 1, None), ("a", 2, 2.0), ("a", 3, float("nan")), ("a", 4, 4.0), ("a", 5, None), ("a", 6, 6.0), (None, 1, 1.0), (None, 2, None)]
    df = spark.createDataFrame(data, "run string, step int, v double")
    got = sequence.rolling_mean(df, KEYS, ORDER, "v", 2, block_rows=block_rows)
    want = {("a", 1): None, ("a", 2): 2.0, ("a", 3): 2.0, ("a", 4): 3.0, ("a", 5): 3.0, ("a", 6): 5.0, (None, 1): 1.0, (None, 2): 1.0}
    assert {(r.run, r.step): r.rolling_mean for r in got.collect()} == want and got.columns == [*df.columns, "rolling_mean"]


@pytest.mark.parametrize("mode", ["min", "max"])
@pytest.mark.parametrize("block_rows", [100, 2])
def test_nan_is_never_best(spark, mode, block_rows):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([2.0, float("nan"), None, 3.0, 1.0])], "run string, step int, v double")
    got = sequence.running_best(df, KEYS, ORDER, "v", mode, block_rows=block_rows)
    assert rows(got, "step", "is_best") == [(0, True), (1, False), (2, False), (3, mode == "max"), (4, mode == "min")]


def test_step_time(table):
    at = F.col("step") * F.col("step")
    names = ("run", "step", "step_time", "mean_step_time", "eta")
    plain = sequence.step_time(table, KEYS, ORDER, at, 20_000, "step", 10).select(*names)
    blocked = sequence.step_time(table, KEYS, ORDER, at, 20_000, "step", 10, block_rows=40).select(*names)
    close(ordered(blocked), ordered(plain))


@pytest.mark.parametrize("mode", ["min", "max"])
def test_running_best(table, mode):
    names = ("run", "step", "best_before", "is_best")
    plain = sequence.running_best(table, KEYS, ORDER, "v", mode).select(*names)
    blocked = sequence.running_best(table, KEYS, ORDER, "v", mode, block_rows=37).select(*names)
    assert ordered(blocked) == ordered(plain)


def test_a_tie_is_not_a_new_best(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 1.0)], "run string, step int, v double")
    assert rows(sequence.running_best(df, KEYS, ORDER, "v"), "step", "is_best") == [(1, True), (2, False), (3, False), (4, True)]


@pytest.mark.parametrize("keys", [["run"], []])
def test_position(table, keys):
    order = ORDER if keys else ["step", "run"]
    plain = sequence.position(table, keys, order).select("run", "step", "position")
    blocked = sequence.position(table, keys, order, block_rows=33).select("run", "step", "position")
    assert ordered(blocked) == ordered(plain)


@pytest.mark.parametrize("k", [1, 25, 5000])
def test_top_k_in_a_range_layout_equals_pruned(table, k):
    order = [F.col("step").desc()]
    plain = sequence.top_k(table, KEYS, order, k, pruned_below=10_000)
    laid = sequence.top_k(table, KEYS, order, k, pruned_below=0)
    assert ordered(plain) == ordered(laid) and laid.columns == table.columns


def test_large_k_ranks_no_hot_group_in_one_task(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), F.col("id"))
    got = sequence.top_k(df, ["g"], [F.col("id").desc()], 5_000)
    assert got.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("low")).orderBy("g").collect() == [(None, 5000, 5001), ("hot", 5000, 12500)]
    assert "_part" in got._jdf.queryExecution().executedPlan().toString().split("Window [row_number()")[1].split("\n")[0]


def test_small_k_is_pruned_before_the_shuffle(table):
    plan = sequence.top_k(table, KEYS, [F.col("step")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
