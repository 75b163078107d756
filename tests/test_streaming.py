import os
import random
from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pairset.operators import runlog, sequence
from pairset.schema import struct_of
from pairset.sources.tables import read_log
from pairset.streaming.follow import follow_index, follow_log, follow_metrics
from tests.conftest import rows
from tests.test_runlog import LINES


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_a_followed_log_equals_the_batch_parse(spark, out):
    args = (spark, f"{out}/in", f"{out}/out", f"{out}/cp")
    write(f"{out}/in", "a.log", LINES[:3])
    follow_log(*args).awaitTermination()
    write(f"{out}/in", "b.log", LINES[3:])
    follow_log(*args).awaitTermination()
    follow_log(*args).awaitTermination()
    lines = read_log(spark, f"{out}/in")
    for kind, parse in (("steps", runlog.parse_steps), ("validations", runlog.parse_validations)):
        got = spark.read.parquet(f"{out}/out/{kind}").drop("batch")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, parse(lines).collect()))


def test_followed_metrics_equal_the_batch_result(spark, out):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "b", None, "hot", "hot"]), i, rnd.choice([None, float("nan")]) if rnd.random() < 0.2 else round(rnd.random(), 3)) for i in range(400)]
    df = spark.createDataFrame(data, "run string, step int, v double")
    for low in range(0, 400, 80):
        df.where(f"step >= {low} and step < {low + 80}").coalesce(1).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{out}/in")
        follow_metrics(stream, f"{out}/out", f"{out}/cp", ["run"], "step", "v", window=30).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{out}/out/rows").select("run", "step", "best_before", "is_best", F.round("rolling_mean", 9)).collect()]
    batch = sequence.rolling_mean(df, ["run"], ["step"], "v", 30)
    want = sequence.running_best(batch, ["run"], ["step"], "v").select("run", "step", "best_before", "is_best", F.round("rolling_mean", 9))
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in want.collect())


def test_a_failed_batch_is_done_again_on_the_state_before_it(spark, out):
    df = spark.createDataFrame([(r, i, float((i * 7 + r) % 23)) for i in range(60) for r in range(3)], "run int, step int, v double")
    write(out, "file", [""])
    for k, (low, high) in enumerate([(0, 20), (20, 40), (40, 60)]):
        df.where(f"step >= {low} and step < {high}").coalesce(1).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{out}/in")
        settings = dict(window=7, mode="max", idle=timedelta(days=1))
        if k == 1:
            # the sink fails when the batch has changed the state
            with pytest.raises(StreamingQueryException):
                follow_metrics(stream, f"{out}/file", f"{out}/cp", ["run"], "step", "v", **settings).awaitTermination()
        follow_metrics(stream, f"{out}/out", f"{out}/cp", ["run"], "step", "v", **settings).awaitTermination()
    got = spark.read.parquet(f"{out}/out/rows").select("run", "step", "best_before", "is_best", F.round("rolling_mean", 9))
    batch = sequence.rolling_mean(df, ["run"], ["step"], "v", 7)
    want = sequence.running_best(batch, ["run"], ["step"], "v", "max").select("run", "step", "best_before", "is_best", F.round("rolling_mean", 9))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert os.listdir(f"{out}/out") == ["rows"]


def test_new_index_rows_are_probed_once(spark, out):
    schema = struct_of("id string")

    def probe(row):
        return {"size": len(row["id"])}

    for ids in (["a", "bb"], ["ccc", "a"]):
        spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.mode("append").parquet(f"{out}/in")
        follow_index(spark, f"{out}/in", schema, f"{out}/cache", f"{out}/cp", struct_of("size bigint"), probe).awaitTermination()
    assert rows(spark.read.parquet(f"{out}/cache/rows"), "id", "size") == [("a", 1), ("bb", 2), ("ccc", 3)]
