import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairset.operators import sample
from tests.conftest import rows


def key(seed, i):
    return int.from_bytes(hashlib.md5(f"{seed}:{i}".encode()).digest()[:4], "big")


AXES = ["a", "b", "c"]


def population(seed, n=260):
    rnd = random.Random(seed)
    return [(f"{i:04d}", rnd.choice("xxxxyz"), rnd.choice(["p", "q", None]), rnd.random() < 0.2) for i in range(n)]


def greedy_rows(data, n, floor, seed):
    """Row by row, with the deviation of every possible next subset counted from scratch."""
    levels = {r[0]: ["null" if v is None else str(v).lower() for v in r[1:]] for r in data}
    supply = [Counter(lv[x] for lv in levels.values()) for x in range(3)]
    raw = [{lv: min(max(c / len(data), floor / n), c / n) for lv, c in axis.items()} for axis in supply]
    targets = [{lv: t / sum(axis.values()) for lv, t in axis.items()} for axis in raw]

    def deviation(ids):
        shares = [Counter(levels[i][x] for i in ids) for x in range(3)]
        return sum(abs(shares[x][lv] / len(ids) - t) for x in range(3) for lv, t in targets[x].items())

    left, picked = sorted(levels, key=lambda i: (key(seed, i), i)), []
    while left and len(picked) < n:
        tried = [deviation([*picked, i]) for i in left]
        lowest = min(tried)
        picked.append(left.pop(next(k for k, d in enumerate(tried) if d <= lowest + 1e-12)))
    return sorted(picked)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("candidates, keys_per_pass, n", [(20_000, 200_000, 25), (20_000, 60, 25), (4, 200_000, 12)])
def test_stratified_subset_equals_the_row_by_row_search(spark, seed, candidates, keys_per_pass, n):
    data = population(seed)
    df = spark.createDataFrame(data, "id string, a string, b string, c boolean").orderBy(F.rand(seed))
    got = sample.stratified_subset(df, AXES, n, floor_rows=2, seed=seed, candidates=candidates, keys_per_pass=keys_per_pass)
    assert [r["id"] for r in got.orderBy("id").collect()] == greedy_rows(data, n, 2, seed)
    assert got.columns == df.columns


def test_stratified_subset_of_a_small_table_takes_all(spark):
    df = spark.createDataFrame(population(4, 9), "id string, a string, b string, c boolean")
    assert sample.stratified_subset(df, AXES, 20).count() == 9
    assert sample.stratified_subset(df.limit(0), AXES, 20).count() == 0


def test_few_candidates_of_many_strata_give_the_same_draw(spark, monkeypatch):
    rnd = random.Random(9)
    data = [(f"{i:04d}", f"a{rnd.randrange(25)}", f"b{rnd.randrange(20)}", rnd.random() < 0.4) for i in range(900)]
    df = spark.createDataFrame(data, "id string, a string, b string, c boolean")
    passes = []
    others = sample._others
    monkeypatch.setattr(sample, "_others", lambda *args: passes.append(1) or others(*args))
    whole = rows(sample.stratified_subset(df, AXES, 60, seed=3), "id")
    assert len(passes) == 1
    assert rows(sample.stratified_subset(df, AXES, 60, seed=3, candidates=300), "id") == whole
    assert [r[0] for r in whole] == greedy_rows(data, 60, 2, 3) and len(passes) < 50


def test_targets(spark):
    df = spark.createDataFrame([("x",)] * 97 + [("y",)] * 2 + [("z",)], "a string")
    got = {r["level"]: r for r in sample.target_shares(df, ["a"], 20, 3).collect()}
    raw = {"x": 0.97, "y": 0.1, "z": 0.05}
    assert {k: r["target"] for k, r in got.items()} == pytest.approx({k: v / sum(raw.values()) for k, v in raw.items()})
    assert got["z"]["supply"] == 1


def farthest_rows(data, n, seed):
    order = sorted(data, key=lambda r: (key(seed, r[0]), r[0]))
    chosen = [max(order, key=lambda r: r[2])]

    def dist(p, q):
        d = abs(p[1] - q[1])
        return min(d, 1.0 - d) + (0.35 if p[3] != q[3] else 0.0) + (0.15 if p[4] != q[4] else 0.0)

    while len(chosen) < min(n, len(data)):
        # max() keeps the first of equal candidates, as the order demands.
        chosen.append(max((r for r in order if r not in chosen), key=lambda r: min(dist(r, c) for c in chosen)))
    return [r[0] for r in chosen]


@pytest.mark.parametrize("candidates, per_pass", [(20_000, 200), (30, 200), (1, 1), (50, 3)])
@pytest.mark.parametrize("seed, profiles", [(1, 400), (2, 7)])
def test_diverse_subset_equals_the_row_by_row_search(spark, candidates, per_pass, seed, profiles):
    rnd = random.Random(seed)
    kinds = [((rnd.randrange(18) + 0.5) / 18, rnd.choice("fgh"), rnd.choice("st")) for _ in range(profiles)]
    data = []
    for i in range(150):
        hue, family, source = rnd.choice(kinds)
        data.append((f"{i:04d}", hue, round(rnd.random(), 2), family, source))
    df = spark.createDataFrame(data, "id string, hue double, sat double, fabric_family string, source string")
    got = sample.diverse_subset(df.orderBy(F.rand(1)), 20, seed=seed, candidates=candidates, per_pass=per_pass)
    assert [r["id"] for r in got.orderBy("pick").collect()] == farthest_rows(data, 20, seed)


def test_diverse_subset_leaves_out_rows_without_a_hue(spark):
    df = spark.createDataFrame([("a", None, 0.9, "f", "s"), ("b", 0.1, 0.5, "f", "s"), ("c", 0.6, 0.4, None, "s")],
                               "id string, hue double, sat double, fabric_family string, source string")
    assert [r["id"] for r in sample.diverse_subset(df, 5).orderBy("pick").collect()] == ["b", "c"]


def test_candidate_pool(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 450, "big").otherwise("small").alias("g"))
    pool = sample.candidate_pool(df, "g", pool=60, per_group=40)
    per = {g: sorted((i for i in range(500) if (i < 450) == (g == "big")), key=lambda i: (key(4242, i), str(i)))[:40] for g in ("big", "small")}
    want = sorted((i for g in per.values() for i in g), key=lambda i: (key(4242, i), str(i)))[:60]
    assert sorted(int(r["id"]) for r in pool.collect()) == sorted(want)


def test_contact_listing_blocked(spark):
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") < 250, "hot").otherwise("cold").alias("axis"))
    plain = sample.contact_listing(df, "axis")
    assert rows(sample.contact_listing(df, "axis", block_rows=40)) == rows(plain)
    assert plain.where("axis = 'cold' and id = 257").first()["sheet_row"] == 1


def test_exclusions_keep_their_reason(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    reasons = spark.createDataFrame([("b", "swatch"), ("z", "gone")], "id string, reason string")
    assert rows(sample.without_listed(df, reasons)) == [("a",)]
    assert rows(sample.listed(df, reasons)) == [("b", "swatch")]
