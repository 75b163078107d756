import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairset.functions import columns as C
from pairset.functions.keys import chosen_with_probability, shuffle_key
from pairset.operators.quantiles import exact_quantiles
from pairset.schema import without_nan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("title, family", [
    ("Pink Tissue Silk", "sheer_flowy"), ("Kanjivaram weave", "traditional_silk"), ("Linen blend", "cotton_handloom"),
    ("Net border", "sheer_flowy"), ("Netted border", "other"), ("cabinet", "other"), ("Floral on LINEN", "cotton_handloom"),
    ("Digital Print", "printed"), ("with Zari", "embellished"), (None, "other"), ("", "other"),
])
def test_keyword_family(spark, title, family):
    assert one(spark, C.keyword_family(F.lit(title).cast("string"))) == family


# Hand-labelled shares of top, dress, skirt and pants with the expected verdict.
TRUTH = [
    (0.218, 0, 0, 0, True), (0.205, 0, 0, 0, True), (0.283, 0, 0, 0, True), (0.632, 0, 0, 0, False),
    (0.040, 0, 0.254, 0, False), (0.302, 0.067, 0.006, 0, False), (0, 0.732, 0, 0, False), (0.02, 0, 0, 0, False),
    (0.10, 0, 0, 0, False), (0.35, 0, 0, 0, False), (0.2, 0.01, 0, 0, False),
]


def test_single_part_signature(spark):
    df = spark.createDataFrame([tuple(map(float, r[:4])) + (r[4],) for r in TRUTH] + [(None, 0.0, 0.0, 0.0, False)],
                               "top double, dress double, skirt double, pants double, want boolean")
    wrong = df.where(C.single_part_signature("top", "dress", "skirt", "pants") != F.col("want"))
    assert wrong.count() == 0


def test_size_buckets_are_half_open(spark):
    df = spark.createDataFrame([(511,), (512,), (1023,), (1024,)], "s int")
    assert [r[0] for r in df.select(C.size_bucket("s")).collect()] == ["<512", "512-1024", "512-1024", ">=1024"]


def test_quantile_buckets_equal_qcut(spark):
    values = [float((i * 37) % 101) / 7 for i in range(203)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    edges = exact_quantiles(df, "v", [0.25, 0.5, 0.75])
    got = [r["b"] for r in df.select(C.bucket_by_edges("v", edges).alias("b")).collect()]
    assert got == list(pd.qcut(pd.Series(values), 4, labels=["q1", "q2", "q3", "q4"]))


def test_equal_edges_collapse_buckets(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    edges = exact_quantiles(df, "v", [0.25, 0.5, 0.75])
    assert {r[0] for r in df.select(C.bucket_by_edges("v", edges)).collect()} == {"q1", "q4"}


def test_shuffle_key_is_the_md5_prefix(spark):
    assert one(spark, shuffle_key(F.lit("0000427"), 1337)) == int.from_bytes(hashlib.md5(b"1337:0000427").digest()[:4], "big")


def test_coin_flip_share(spark):
    hits = spark.range(20_000).where(chosen_with_probability("id", 0.3, 1)).count()
    assert 5_700 < hits < 6_300
    assert spark.range(50).where(chosen_with_probability("id", 1.0, 1)).count() == 50


@pytest.mark.parametrize("size, mode, upsample, want", [
    ((1000, 1500), "fit", True, (576, 863, 0, 0, 0, 1)),  # 0.576 * 1500 is just below 864
    ((1000, 1000), "fit", True, (576, 576, 0, 144, 0, 144)),
    ((101, 300), "fit", False, (101, 300, 237, 282, 238, 282)),
    ((100, 100), "exceed", True, (864, 864, 0, 0, 0, 0)),
])
def test_fit_geometry(spark, size, mode, upsample, want):
    g = C.fit_geometry(F.lit(size[0]), F.lit(size[1]), 576, 864, mode, upsample)
    row = spark.range(1).select(*[g[k].alias(k) for k in ("new_w", "new_h", "pad_left", "pad_top", "pad_right", "pad_bottom")]).first()
    assert tuple(row) == want


def test_fit_geometry_rejects_unknown_mode():
    with pytest.raises(ValueError):
        C.fit_geometry("w", "h", 1, 1, "stretch")


@pytest.mark.parametrize("seconds, text", [(3720.9, "1h02m"), (184, "3m04s"), (5, "5s"), (-3, "0s"), (36000, "10h00m")])
def test_duration_text(spark, seconds, text):
    assert one(spark, C.duration_text(F.lit(seconds))) == text


@pytest.mark.parametrize("a, b, d", [(0.05, 0.95, 0.1), (0.2, 0.4, 0.2), (0.0, 0.5, 0.5)])
def test_circular_distance(spark, a, b, d):
    assert one(spark, C.circular_distance(F.lit(a), b)) == pytest.approx(d)


def test_bytes_round_trip(spark):
    values = F.array(*[F.lit(x) for x in (0, 1, 127, 128, 255)])
    assert one(spark, C.to_bytes(F.transform(C.rescale_bytes(values), lambda x: x + 1e-9))) == [0, 1, 127, 128, 255]


def test_codes(spark):
    assert [one(spark, C.coded(F.lit(c))) for c in ("tops", "bottoms", "one-pieces", "hats")] == [1, 2, 3, None]


def test_without_nan(spark):
    df = without_nan(spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "v double, s string"))
    assert df.where("v is null").count() == 1
    assert df.agg(F.avg("v")).first()[0] == 1.0
