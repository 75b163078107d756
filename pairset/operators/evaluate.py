"""Metric registry, per-group summaries and paired run comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairset.operators import pixels
from pairset.operators.incremental import BatchFn, map_row_batches, map_rows
from pairset.operators.quantiles import exact_median
from pairset.schema import as_flag, null_if_nan

Score = Callable[[np.ndarray, np.ndarray, "np.ndarray | None"], "float | None"]


@dataclass(frozen=True)
class MetricSpec:
    """A metric over (prediction, truth, mask); ``compute`` is None for a declared, unimplemented one."""

    name: str
    higher_is_better: bool = True
    is_distribution: bool = False
    caveat: str = ""
    compute: Score | None = None


_REGISTRY: dict[str, MetricSpec] = {}


def register(spec: MetricSpec) -> MetricSpec:
    _REGISTRY[spec.name] = spec
    return spec


def available() -> list[str]:
    return sorted(_REGISTRY)


def metric(name: str) -> MetricSpec:
    if name not in _REGISTRY:
        raise KeyError(f"unknown metric {name!r}; available: {available()}")
    return _REGISTRY[name]


def describe(names: Sequence[str] | None = None) -> str:
    lines = []
    for spec in map(metric, names or available()):
        lines.append(f"{spec.name}: {'higher' if spec.higher_is_better else 'lower'} is better. {spec.caveat}".rstrip())
    return "\n".join(lines)


def registry_table(spark: SparkSession) -> DataFrame:
    rows = [(s.name, s.higher_is_better, s.is_distribution, s.caveat) for s in map(metric, available())]
    return spark.createDataFrame(rows, "name string, higher_is_better boolean, is_distribution boolean, caveat string")


register(MetricSpec("ssim", True, caveat="Local structure: a garment of the wrong kind may score as high as the right one.",
                    compute=lambda p, t, m: pixels.ssim(p, t)))
register(MetricSpec("psnr", True, caveat="A mean over all pixels, most of which are not garment.",
                    compute=lambda p, t, m: pixels.psnr(p, t)))
register(MetricSpec("lpips", False, caveat="Needs a network; score it elsewhere and join the table."))
register(MetricSpec("masked_ssim", True, caveat="Needs a mask. Averages over the whole frame.",
                    compute=lambda p, t, m: pixels.composited(pixels.ssim, p, t, m)))
register(MetricSpec("masked_psnr", True, caveat="Needs a mask. Scores the masked pixels only.",
                    compute=lambda p, t, m: pixels.region_psnr(p, t, m)))
register(MetricSpec("masked_lpips", False, caveat="Needs a mask and a network."))
register(MetricSpec("saree_structure", True, caveat="Declared, not implemented."))
register(MetricSpec("pallu_presence", True, caveat="Declared, not implemented."))


def score_pairs(pairs: DataFrame, names: Sequence[str], id_col: str = "id") -> DataFrame:
    """Score ``(id, height, width, pred, truth[, mask])`` rows; a size mismatch is a captured failure.

    A metric that cannot be computed for a row is NULL, as is a declared one.
    """
    specs = [metric(n) for n in names]
    result = T.StructType([T.StructField(s.name, T.DoubleType()) for s in specs])

    def score(row: dict) -> dict:
        shape = (int(row["height"]), int(row["width"]), 3)
        pred, truth = pixels.raster(row["pred"], shape), pixels.raster(row["truth"], shape)
        mask = row.get("mask")
        mask = None if mask is None else pixels.raster(mask, shape[:2]).astype(bool)
        return {s.name: None if s.compute is None else s.compute(pred, truth, mask) for s in specs}

    return map_rows(pairs, score, result, [id_col])


def score_with(df: DataFrame, load: Callable[[], Callable[[dict], dict]], result: T.StructType, keep: Sequence[str]) -> DataFrame:
    """Run a caller's model over a table; adds ``seconds``, ``ok`` and ``error`` per row."""
    import time

    timed = T.StructType([*result.fields, T.StructField("seconds", T.DoubleType())])

    def load_timed():
        fn = load()

        def call(row: dict) -> dict:
            start = time.perf_counter()
            return {**fn(row), "seconds": time.perf_counter() - start}

        return call

    return map_rows(df, None, timed, keep, load=load_timed)


def score_batches(
    df: DataFrame, load: Callable[[], BatchFn], result: T.StructType, keep: Sequence[str], batch_rows: int = 1_000,
) -> DataFrame:
    """Run a caller's model over batches of rows; adds ``seconds``, ``ok`` and ``error`` per row.

    A model that fails on a batch is asked again for its halves, so one bad row loses one row.
    """
    return map_row_batches(df, load, result, keep, batch_rows, seconds="seconds")


# ------------------------------------------------------------------------------------ summaries
def rate_by_group(df: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    """Rows, hits, hit percentage and mean of the hit flag per group; an unknown flag is no hit."""
    flag = F.coalesce(hit, F.lit(False))
    mean = F.avg(flag.cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flag).alias("hits"),
                               (mean * 100).alias("pct"), mean.alias("mean"))


def mean_std(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each metric per group; NULL and NaN are left out."""
    out = []
    for m in metrics:
        v = null_if_nan(F.col(m).cast("double"))
        out += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*out)


def means_by_axes(df: DataFrame, mode: str, axes: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per (mode, axis level), for all axes from one aggregation of the samples.

    Samples are first summed per combination of levels; the axes are then unfolded from those sums, so the
    rows multiplied by the number of axes are combinations, not samples.
    """
    sums = []
    for m in metrics:
        v = null_if_nan(F.col(m).cast("double"))
        sums += [F.sum(v).alias(f"_s_{m}"), F.count(v).alias(f"_c_{m}")]
    cells = df.groupBy(mode, *axes).agg(F.count("*").alias("_n"), *sums)
    unfold = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes])
    carried = [c for m in metrics for c in (f"_s_{m}", f"_c_{m}")]
    long = cells.select(mode, F.inline(unfold), "_n", *carried)
    means = [F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_c_{m}")).alias(f"{m}_mean") for m in metrics]
    return long.groupBy(mode, "axis", "level").agg(F.sum("_n").alias("n"), *means)


def run_totals(log: DataFrame, seconds: str = "seconds", peak: str | None = None, ok: str = "ok") -> DataFrame:
    """Success count and mean, median, sum and maximum of the run time over successful rows."""
    good = F.when(as_flag(ok), null_if_nan(F.col(seconds).cast("double")))
    middle = exact_median(log.where(as_flag(ok)), seconds)
    extra = [] if peak is None else [F.max(F.when(as_flag(ok), F.col(peak))).alias("peak")]
    return log.agg(
        F.count("*").alias("n"), F.count_if(as_flag(ok)).alias("n_ok"), F.avg(good).alias("mean_seconds"),
        F.sum(good).alias("total_seconds"), F.max(good).alias("max_seconds"), *extra,
    ).withColumn("median_seconds", F.lit(middle).cast("double"))


def run_summary(df: DataFrame, metrics: Sequence[str], ok: str = "ok") -> DataFrame:
    """Rows, successful rows and the mean of each metric over the successful rows."""
    means = [F.avg(F.when(as_flag(ok), null_if_nan(F.col(m).cast("double")))).alias(f"{m}_mean") for m in metrics]
    return df.agg(F.count("*").alias("n"), F.count_if(as_flag(ok)).alias("n_ok"), *means)


def paired_diff(pairs: DataFrame, specs: Sequence[MetricSpec], strict: bool = True) -> DataFrame:
    """Compare the two runs of ``paired()`` metric by metric.

    Aggregation happens before the metrics become rows, so the pairs are read once. ``strict`` counts real
    improvements only. With ``strict=False`` a tie or missing value counts as better for a metric where
    lower is better. Metrics missing from one whole run are left out.
    """
    aggs, rows = [F.count("*").alias("_n")], []
    for i, s in enumerate(specs):
        a = null_if_nan(F.col(f"{s.name}_a").cast("double"))
        b = null_if_nan(F.col(f"{s.name}_b").cast("double"))
        up = F.coalesce(b > a, F.lit(False))
        if s.higher_is_better:
            better = up
        else:
            better = F.coalesce(b < a, F.lit(False)) if strict else ~up
        aggs += [F.avg(a).alias(f"_a{i}"), F.avg(b).alias(f"_b{i}"), F.avg(b - a).alias(f"_d{i}"),
                 F.count(b - a).alias(f"_s{i}"), F.count_if(better).alias(f"_w{i}")]
        d = F.col(f"_d{i}")
        if s.higher_is_better:
            improved = d > 0
        else:
            improved = d < 0 if strict else ~F.coalesce(d > 0, F.lit(False))
        rows.append(F.struct(
            F.lit(s.name).alias("metric"), F.col(f"_a{i}").alias("a_mean"), F.col(f"_b{i}").alias("b_mean"),
            d.alias("delta"), F.coalesce(improved, F.lit(False)).alias("improved"),
            F.col(f"_w{i}").alias("n_better"), F.col("_n").alias("n"), F.col(f"_s{i}").alias("n_scored"),
            F.lit(strict).alias("strict"), F.lit(s.caveat).alias("caveat")))
    out = pairs.agg(*aggs).select(F.inline(F.array(*rows)))
    return out.where(F.col("a_mean").isNotNull() & F.col("b_mean").isNotNull())
