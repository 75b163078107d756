import pytest
from pyspark.sql import functions as F

from pairset.operators import incremental as inc
from pairset.operators import joins
from pairset.operators.cache import KeyedCache
from pairset.schema import struct_of
from tests.conftest import rows

RESULT = struct_of("size bigint")


def probe(row):
    if row["id"].startswith("bad"):
        raise ValueError(f"cannot read {row['id']}")
    return {"size": len(row["id"])}


def table(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_failures_are_captured(spark):
    got = rows(inc.map_rows(table(spark, "a", "bad1"), probe, RESULT, ["id"]))
    assert got == [("a", 1, True, None), ("bad1", None, False, "ValueError: cannot read bad1")]
    good, quarantine = inc.split_outcome(inc.map_rows(table(spark, "a", "bad1"), probe, RESULT, ["id"]))
    assert rows(good, "id") == [("a",)] and rows(quarantine, "id") == [("bad1",)]


def test_a_function_is_loaded_once_per_task(spark):
    def load():
        state = {"loads": 0}
        state["loads"] += 1
        return lambda row: {"size": state["loads"]}

    got = inc.map_rows(spark.range(50).select(F.col("id").cast("string")), None, RESULT, ["id"], load=load)
    assert {r["size"] for r in got.collect()} == {1}


def test_results_leave_a_task_in_pieces(spark):
    def grown(row):
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) * 4096
        return {"data": bytes([row["id"] % 256]) * 1_000_000, "held": held}

    result = struct_of("data binary, held bigint")
    made = inc.map_rows(spark.range(400).coalesce(1), grown, result, ["id"])
    got = made.select("id", "ok", "held", F.length("data").alias("n"), F.hex(F.substring("data", 1, 1)).alias("first")).collect()
    assert sorted((r["id"], r["ok"], r["n"], r["first"]) for r in got) == [(i, True, 1_000_000, f"{i % 256:02X}") for i in range(400)]
    assert max(r["held"] for r in got) - min(r["held"] for r in got) < 150_000_000


def test_small_results_keep_their_values_across_pieces(spark):
    n = 2 * inc.PIECE_ROWS + 7
    some = spark.range(n).coalesce(1).select("id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("part"))

    def probe(row):
        if row["id"] % 1_000 == 999:
            raise ValueError("bad")
        assert row["part"] is None or type(row["part"]) is int
        return {"size": row["part"]}

    got = rows(inc.map_rows(some, probe, RESULT, ["id"]), "id", "ok")
    assert got == [(i, i % 1_000 != 999) for i in range(n)]


def test_refresh_probes_only_what_is_missing(spark, out):
    cache = f"{out}/stats"
    inc.refresh_stats(table(spark, "a", "bad1"), cache, RESULT, probe)

    def other(row):
        return {"size": 100}

    got = inc.refresh_stats(table(spark, "a", "bad1", "c"), cache, RESULT, other)
    assert rows(got, "id", "size", "probe_ok") == [("a", 1, True), ("bad1", None, False), ("c", 100, True)]
    before = spark.read.parquet(f"{cache}/rows").count()
    inc.refresh_stats(table(spark, "a", "bad1", "c"), cache, RESULT, other)
    assert spark.read.parquet(f"{cache}/rows").count() == before == 3


def test_failed_ids_are_retried_on_request(spark, out):
    cache = f"{out}/stats"
    inc.refresh_stats(table(spark, "a", "bad1"), cache, RESULT, probe)
    got = inc.refresh_stats(table(spark, "a", "bad1"), cache, RESULT, lambda row: {"size": 9}, retry_failed=True)
    assert rows(got, "id", "size", "probe_ok") == [("a", 1, True), ("bad1", 9, True)]


def test_pending_and_latest(spark):
    log = spark.createDataFrame([("a", "masked", True, 1), ("b", "plain", False, 1)], "id string, mode string, ok boolean, at int")
    work = inc.worklist(table(spark, "a", "b"), ["masked", "plain"])
    assert rows(inc.pending(work, log), "id", "mode") == [("a", "plain"), ("b", "masked")]
    assert rows(inc.pending(work, log, ok="ok"), "id", "mode") == [("a", "plain"), ("b", "masked"), ("b", "plain")]
    retried = spark.createDataFrame([("b", "plain", True, 2)], "id string, mode string, ok boolean, at int")
    merged = inc.carried_over(log, retried, ["mode", "id"], ["at"])
    assert rows(merged, "id", "mode", "ok") == [("a", "masked", True), ("b", "plain", True)]
    assert inc.pending(work, merged, ok="ok").count() == 2


def test_artefacts(spark):
    ids = table(spark, "0001", "0002")
    paths = inc.artefact_paths(ids, "cache/", 864, 576)
    assert ("0001", "parse", "cache/864x576/parse/0001.png") in rows(paths)
    listing = paths.where("not (id = '0002' and kind = 'garment')").withColumn("bytes", F.lit(10).cast("bigint"))
    assert rows(inc.complete_ids(listing)) == [("0001",)]
    assert rows(inc.complete_ids(listing, min_bytes=11)) == []
    assert rows(inc.todo(ids, listing)) == [("0002",)]
    assert inc.todo(ids, listing, force=True).count() == 2
    twice = listing.unionByName(listing)
    assert rows(inc.complete_ids(twice)) == [("0001",)]
    assert tuple(joins.completeness(ids, inc.complete_ids(listing)).first()) == (2, 1, 1)


def test_empty_selection_is_an_error(spark):
    with pytest.raises(ValueError):
        joins.require_rows(table(spark), "cache")


@pytest.mark.parametrize("block_rows", [1_000_000, 16])
def test_substitution(spark, block_rows):
    n, stride = 60, 7919
    valid = {i for i in range(n) if i % 3 == 0}
    df = spark.range(n).select("id", F.col("id").isin(*valid).alias("valid"))
    got = {r["id"]: r["used_id"] for r in inc.substitute_failed(df, ["id"], "valid", block_rows=block_rows).collect()}
    want = {i: next((j for k in range(5) if (j := (i + k * stride) % n) in valid), None) for i in range(n)}
    assert got == want


def test_defaults_from_a_lookup(spark):
    lookup = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, flag boolean")
    got = joins.with_default(table(spark, "a", "b", "c", "d"), lookup, "id", "flag", "model", "flat-lay", "kind", "unknown")
    assert rows(got) == [("a", "model"), ("b", "flat-lay"), ("c", "flat-lay"), ("d", "unknown")]


def test_first_seen(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "id string, seq int")
    assert rows(inc.first_seen(df, ["id"], [F.col("seq")])) == [("a", 1), ("b", 5)]


def test_progress_counts_an_id_once(spark):
    attempts = spark.createDataFrame([("a", False), ("a", True), ("b", False), ("b", None)], "id string, ok boolean")
    assert tuple(inc.progress(table(spark, "a", "b", "c"), attempts).first()) == (1, 1, 3)


def test_null_keys_are_done_work(spark):
    work = spark.createDataFrame([("a", "1"), (None, "2"), ("b", None)], "mode string, id string")
    log = spark.createDataFrame([(None, "2"), ("b", None)], "mode string, id string")
    assert rows(inc.pending(work, log)) == [("a", "1")]


def test_row_functions_see_none(spark, out):
    df = spark.createDataFrame([(1, None, None), (2, 7, 1.5), (3, 2**40, float("nan"))], "id int, n bigint, x double")
    seen = lambda row: {"kinds": f"{type(row['n']).__name__} {type(row['x']).__name__} {row['n']}"}
    got = inc.map_rows(df, seen, struct_of("kinds string"), ["id"])
    assert rows(got, "id", "kinds") == [(1, "NoneType NoneType None"), (2, "int float 7"), (3, f"int NoneType {2**40}")]


def test_recompute_and_latest_attempt(spark, out):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    for value in (1, 2):
        got = inc.refresh_stats(df, out + "/c", struct_of("v int"), lambda row, value=value: {"v": value}, recompute=True)
        assert rows(got, "id", "v") == [("a", value), ("b", value)]
    assert spark.read.parquet(out + "/c/rows").count() == 4


def sized(spark, path):
    return inc.stats_cache(spark, path, struct_of("id string")["id"], RESULT)


def test_a_lookup_reads_the_buckets_of_its_ids(spark, out):
    cache = sized(spark, f"{out}/c")
    ids = table(spark, *[f"id{i}" for i in range(300)])
    inc.probe_missing(ids, cache, RESULT, lambda row: {"size": 1})
    few = table(spark, "id7", "id9", "new")
    found = cache.rows(few)
    filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "bucket" in filters and " IN (" in filters and found.select(F.input_file_name()).distinct().count() <= 3
    assert {"id7", "id9"} <= {r["id"] for r in found.collect()} and found.count() < 40
    inc.probe_missing(few, cache, RESULT, lambda row: {"size": 2})
    assert rows(cache.rows().where("size = 2"), "id") == [("new",)] and cache.rows().count() == 301


def test_compaction_keeps_the_best_attempt_and_survives_a_crash(spark, out):
    path = f"{out}/c"

    def fails(row):
        raise ValueError("no")

    for fn in (fails, lambda row: {"size": 1}, lambda row: {"size": 2}):
        inc.refresh_stats(table(spark, "a", "b", None), path, RESULT, fn, recompute=True)
    before = sorted(map(tuple, inc.refresh_stats(table(spark), path, RESULT, fails).collect()), key=str)
    cache = sized(spark, path)
    assert cache.rows().count() == 9

    def dies(df):
        return df.withColumn("size", F.raise_error(F.lit("killed")).cast("bigint"))

    with pytest.raises(Exception, match="killed"):
        cache.compact(dies)
    assert sized(spark, path).version == 0 and sized(spark, path).rows().count() == 9
    # what a compaction left that died before publishing is overwritten
    cache._write(cache.rows(), 1, "overwrite")
    inc.compact_stats(cache)
    again = sized(spark, path)
    assert (again.version, again.rows().count()) == (1, 3)
    after = inc.refresh_stats(table(spark, "a", "c"), path, RESULT, lambda row: {"size": 5})
    assert sorted(map(tuple, after.collect()), key=str) == sorted([*before, ("c", 5, True, None)], key=str)


def test_the_first_number_of_buckets_holds(spark, out):
    first = KeyedCache(spark, f"{out}/c", struct_of("id string"), "id", buckets=3)
    first.append(table(spark, "a", "b", "c", "d", "e").select("id"))
    later = KeyedCache(spark, f"{out}/c", struct_of("id string"), "id", buckets=50)
    assert later.buckets == 3 and later.rows(table(spark, "d")).where("id = 'd'").count() == 1
    empty = KeyedCache(spark, f"{out}/none", struct_of("id string"))
    empty.compact(lambda rows: rows)
    assert empty.rows().count() == 0 and empty.rows(table(spark, "a")).count() == 0


def test_a_batch_is_one_call_and_a_bad_row_loses_itself(spark):
    def load():
        calls = []

        def size(rows):
            calls.append(len(rows))
            if (rows["id"] % 400 == 399).any():
                raise ValueError("bad row")
            return {"v": rows["id"] * 2, "calls": [len(calls)] * len(rows)}

        return size

    df = spark.range(1000).repartition(1)
    result = struct_of("v bigint, calls int")
    got = {r["id"]: r for r in inc.map_row_batches(df, load, result, ["id"], 1000, seconds="s").collect()}
    assert len(got) == 1000 and {i for i, r in got.items() if not r["ok"]} == {399, 799}
    assert all(r["v"] == 2 * i and r["error"] is None and r["s"] >= 0 for i, r in got.items() if r["ok"])
    assert got[399]["error"] == "ValueError: bad row" and got[399]["v"] is None
    assert max(r["calls"] for r in got.values() if r["ok"]) < 45
    good = inc.map_row_batches(df.where("id < 399"), load, result, ["id"], 1000).collect()
    assert {r["calls"] for r in good} == {1}


def test_batches_with_another_number_of_values_fail(spark):
    got = inc.map_row_batches(spark.range(5).repartition(1), lambda: lambda rows: {"v": [1] * min(len(rows), 2)}, struct_of("v int"), ["id"], 5).collect()
    assert [r["ok"] for r in got] == [True] * 5 and {r["v"] for r in got} == {1}
    none = inc.map_row_batches(spark.range(3), lambda: lambda rows: {"v": []}, struct_of("v int"), ["id"]).collect()
    assert [r["ok"] for r in none] == [False] * 3 and "1 rows gave" in none[0]["error"]
    assert inc.map_row_batches(spark.range(0), lambda: lambda rows: rows, struct_of("v int"), ["id"]).count() == 0
