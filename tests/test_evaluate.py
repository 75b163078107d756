import numpy as np
import pytest
from pyspark.sql import functions as F

from pairset.operators import evaluate, joins
from pairset.plans.evaluation import compare_runs, evaluation_subset, run_report, showcase_pool, showcase_subset
from pairset.operators.evaluate import MetricSpec
from tests.conftest import rows

NAN = float("nan")


def test_registry(spark):
    names = evaluate.available()
    assert names == sorted(names)
    assert {"ssim", "psnr", "lpips", "masked_ssim", "masked_lpips"} <= set(names)
    assert not evaluate.metric("lpips").higher_is_better
    with pytest.raises(KeyError, match="unknown metric"):
        evaluate.metric("fid")
    assert "lower is better" in evaluate.describe(["lpips"])
    assert evaluate.registry_table(spark).count() == len(names)


def test_a_new_metric_can_be_registered(spark):
    evaluate.register(MetricSpec("mean_gap", False, compute=lambda p, t, m: float(abs(p.mean() - t.mean()))))
    try:
        image = bytes(range(48))
        pairs = spark.createDataFrame([("a", 4, 4, image, bytes(48))], "id string, height int, width int, pred binary, truth binary")
        assert evaluate.score_pairs(pairs, ["mean_gap"]).first()["mean_gap"] == pytest.approx(23.5)
    finally:
        evaluate._REGISTRY.pop("mean_gap")


def runs(spark):
    a = spark.createDataFrame([("1", 1.0, 0.5), ("2", 2.0, 0.5), ("3", NAN, 0.5), ("only_a", 9.0, 9.0)],
                              "id string, psnr double, lpips double")
    b = spark.createDataFrame([("1", 2.0, 0.5), ("2", 1.5, NAN), ("3", 3.0, 0.25), ("only_b", 9.0, 9.0)],
                              "id string, psnr double, lpips double")
    return a, b


def test_paired_diff_strict(spark):
    a, b = runs(spark)
    got = {r["metric"]: r for r in compare_runs(a, b).collect()}
    p, q = got["psnr"], got["lpips"]
    assert (p["a_mean"], p["b_mean"], p["delta"], p["improved"]) == (1.5, pytest.approx(6.5 / 3), 0.25, True)
    assert (p["n_better"], p["n"], p["n_scored"]) == (1, 3, 2)
    assert (q["delta"], q["improved"], q["n_better"], q["n_scored"]) == (-0.125, True, 1, 2)


def test_paired_diff_counting_ties(spark):
    a, b = runs(spark)
    got = {r["metric"]: r for r in compare_runs(a, b, strict=False).collect()}
    # A tie and a missing value count as better where lower is better.
    assert got["lpips"]["n_better"] == 3 and got["psnr"]["n_better"] == 1
    same = {r["metric"]: r for r in compare_runs(a, a, strict=False).collect()}
    assert same["lpips"]["improved"] and not same["psnr"]["improved"]


def test_a_run_against_itself(spark):
    a, _ = runs(spark)
    for r in compare_runs(a, a).collect():
        assert r["delta"] == 0 and not r["improved"] and r["n_better"] == 0


def test_metrics_missing_from_a_run_are_left_out(spark):
    a, b = runs(spark)
    b = b.withColumn("lpips", F.lit(None).cast("double"))
    assert rows(compare_runs(a, b), "metric") == [("psnr",)]


def scores(spark):
    return spark.createDataFrame(
        [("1", "m", "s1", True, 1.0), ("2", "m", "s1", False, 3.0), ("3", "m", "s2", True, NAN), ("4", "p", "s1", True, None)],
        "id string, mode string, source string, ok boolean, psnr double")


def test_run_report(spark):
    report = run_report(scores(spark), ["psnr", "absent"])
    assert rows(report["overall"]) == [("m", 2.0, pytest.approx(np.std([1, 3], ddof=1))), ("p", None, None)]
    by_axis = {(r["mode"], r["axis"], r["level"]): (r["n"], r["psnr_mean"]) for r in report["by_axis"].collect()}
    assert by_axis == {("m", "source", "s1"): (2, 2.0), ("m", "source", "s2"): (1, None), ("p", "source", "s1"): (1, None)}
    assert tuple(report["summary"].first()) == (4, 3, 1.0)


def test_run_totals(spark):
    log = spark.createDataFrame([(True, 2.0, 1.0), (True, 4.0, 3.0), (True, 9.0, 2.0), (False, None, None), (None, 99.0, 99.0)],
                                "ok boolean, seconds double, vram double")
    row = evaluate.run_totals(log, peak="vram").first()
    assert (row["n"], row["n_ok"], row["mean_seconds"], row["median_seconds"], row["total_seconds"], row["max_seconds"], row["peak"]) == (5, 3, 5.0, 4.0, 15.0, 9.0, 3.0)


def test_rate_counts_unknown_as_no_hit(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("a", False), ("a", True)], "g string, hit boolean")
    assert rows(evaluate.rate_by_group(df, ["g"], F.col("hit"))) == [("a", 4, 2, 50.0, 0.5)]


def test_pivot(spark):
    df = spark.createDataFrame([("1", "m", 1.0), ("1", "p", 2.0), ("2", "m", 3.0)], "id string, mode string, ssim double")
    assert rows(joins.pivot_modes(df, "id", "mode", ["m", "p"], ["ssim"])) == [("1", 1.0, 2.0), ("2", 3.0, None)]


def test_scoring_a_table(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (8, 9, 3), dtype=np.uint8)
    b = rng.integers(0, 256, (8, 9, 3), dtype=np.uint8)
    mask = np.zeros((8, 9), dtype=np.uint8)
    half = mask.copy()
    half[:4] = 1
    data = [("same", a, a, half), ("other", a, b, half), ("unmasked", a, b, mask)]
    pairs = spark.createDataFrame([(n, 8, 9, x.tobytes(), y.tobytes(), m.tobytes()) for n, x, y, m in data]
                                  + [("short", 8, 9, b"12", a.tobytes(), None)],
                                  "id string, height int, width int, pred binary, truth binary, mask binary")
    got = {r["id"]: r for r in evaluate.score_pairs(pairs, ["ssim", "psnr", "masked_psnr", "masked_ssim", "pallu_presence"]).collect()}
    assert got["same"]["ssim"] == pytest.approx(1.0) and got["same"]["psnr"] is None
    mse = ((a[:4].astype(float) - b[:4]) ** 2).mean()
    assert got["other"]["masked_psnr"] == pytest.approx(10 * np.log10(255**2 / mse))
    assert got["other"]["masked_ssim"] > got["other"]["ssim"]
    assert got["unmasked"]["masked_psnr"] is None and got["unmasked"]["masked_ssim"] is None
    assert not got["short"]["ok"] and got["short"]["error"].startswith("ValueError")
    assert got["other"]["pallu_presence"] is None


def test_subsets_end_to_end(spark):
    n = F.col("n")
    index = spark.range(600).select(F.col("id").alias("n")).select(
        F.lpad(n.cast("string"), 7, "0").alias("id"), F.concat(F.lit("s"), n % 4).alias("source"),
        F.when(n % 3 == 0, "Silk saree").when(n % 3 == 1, "Linen saree").otherwise("Saree").alias("title"),
        F.when(n % 5 == 0, "test").otherwise("train").alias("split"), (n % 2 == 0).alias("is_clean"),
        F.when(n % 7 == 0, "mannequin").otherwise("model").alias("target_type"),
        (n * 37 % 600 / 600).alias("garment_score"), (500 + n).cast("int").alias("person_w"), F.lit(1200).alias("person_h"))
    chosen = evaluation_subset(index, 30)
    assert chosen.count() == 30 and chosen.where("split != 'test'").count() == 0
    assert {r["fabric_family"] for r in chosen.collect()} == {"traditional_silk", "cotton_handloom", "other"}
    train = index.where("split = 'train'")
    audited = train.limit(3).select("id", F.lit("blurred").alias("reason"))
    pool = showcase_pool(train, audited, 60)
    assert pool.where("person_w < 768 or target_type != 'model'").count() == 0
    colours = pool.select("id", (F.crc32("id") % 18 / 18).alias("hue"), (F.crc32("title") % 10 / 10).alias("sat"), F.lit(0.5).alias("val"))
    assert showcase_subset(pool, colours, 12).select("id").distinct().count() == 12
