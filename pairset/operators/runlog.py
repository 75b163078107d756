"""Run logs: text lines to typed rows, curves and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairset.functions import logs
from pairset.operators.sequence import position, top_k
from pairset.schema import null_if_nan


def parse_steps(lines: DataFrame, line: str = "value") -> DataFrame:
    """Step rows of a log; the optional parts of a line are NULL where absent.

    The step pattern is searched once per line: the match is exploded, so lines without one drop out without
    a filter that would search them again.
    """
    keep = [c for c in lines.columns if c != line]
    text = lines.select(*keep, logs.plain(line).alias("_t"))
    found = text.select(*keep, "_t", F.explode(logs.first_match(F.col("_t"), logs.STEP)).alias("_m"))
    optional = {"_v": (logs.VRAM, 2), "_g": (logs.GPU, 2), "_n": (logs.GRAD_NORM, 1)}
    matched = found.select(*keep, "_m", *[F.regexp_extract("_t", p, 0).alias(c) for c, (p, _) in optional.items()])
    split = matched.select(
        *keep, logs.groups(F.col("_m"), logs.STEP, 6).alias("_s"),
        *[logs.groups(F.col(c), p, n).alias(c) for c, (p, n) in optional.items()],
    )

    def part(array: str, i: int) -> Column:
        return F.get(array, F.lit(i))

    return split.select(
        *keep,
        logs.whole(part("_s", 0)).alias("epoch"), logs.whole(part("_s", 1)).alias("step"),
        logs.number(part("_s", 2)).alias("loss"), logs.number(part("_s", 3)).alias("avg"),
        logs.number(part("_s", 4)).alias("lr"), logs.number(part("_s", 5)).alias("sit"),
        logs.number(part("_v", 0)).alias("vram_alloc"), logs.number(part("_v", 1)).alias("vram_peak"),
        logs.number(part("_g", 0)).alias("gpu_util"), logs.number(part("_g", 1)).alias("gpu_temp"),
        logs.number(part("_n", 0)).alias("gnorm"),
    )


def parse_validations(lines: DataFrame, line: str = "value") -> DataFrame:
    """Validation rows of a log."""
    keep = [c for c in lines.columns if c != line]
    text = lines.select(*keep, logs.plain(line).alias("_t"))
    found = text.select(*keep, F.explode(logs.first_match(F.col("_t"), logs.VALIDATION)).alias("_m"))
    split = found.select(*keep, logs.groups(F.col("_m"), logs.VALIDATION, 3).alias("_s"))
    at = [F.get("_s", F.lit(i)) for i in range(3)]
    return split.select(*keep, logs.whole(at[0]).alias("epoch"), logs.whole(at[1]).alias("step"),
                        logs.number(at[2]).alias("val_loss"))


def summarise(steps: DataFrame, by: Sequence[str] = (), order: str = "step") -> DataFrame:
    """First and last running mean, their reduction, peak memory and temperature range."""
    known = F.when(F.col("avg").isNotNull(), F.col(order))
    out = steps.groupBy(*by).agg(
        F.count("*").alias("n_steps"), F.min_by("avg", known).alias("first_avg"),
        F.max_by("avg", known).alias("last_avg"), F.max("vram_peak").alias("peak_vram"),
        F.min("gpu_temp").alias("min_temp"), F.max("gpu_temp").alias("max_temp"),
    )
    return out.withColumn("reduction_pct", (1 - F.try_divide("last_avg", "first_avg")) * 100)


def micro_batch_means(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int, epoch: str | None = None, **blocks: int,
) -> DataFrame:
    """Mean of every ``size`` consecutive values of a series; an incomplete last group is left out.

    Failed micro-batches have no value and do not count towards a group. With ``epoch`` the count runs on
    over the epochs of a series but sums start anew in each: a group that reaches over from one epoch has the
    mean of what the next one adds to it.
    """
    part = F.col(epoch) if epoch is not None else F.lit(0)
    valued = df.select(*keys, *order, part.alias("_e"), null_if_nan(F.col(value).cast("double")).alias("_v")).where("_v is not null")
    placed = position(valued, keys, order, "_i", **blocks)
    group = (F.floor(F.col("_i") / size) + 1).cast("bigint")
    parts = placed.groupBy(*keys, group.alias("step"), "_e").agg(F.count("*").alias("_n"), F.avg("_v").alias("_m"), F.max("_i").alias("_at"))
    whole = parts.groupBy(*keys, "step").agg(F.sum("_n").alias("_n"), F.max_by("_m", "_at").alias("loss"))
    return whole.where(F.col("_n") == size).drop("_n")


def validation_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, max_batches: int | None = None,
) -> DataFrame:
    """Mean loss and batch count per validation, optionally over the first batches only; 0 for none."""
    rows = df
    if max_batches:
        by = [F.col(c) for c in order]
        rows = top_k(df, keys, by, max_batches)
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("val_loss"),
                                   F.count(v).alias("val_batches"))


def every_kth(df: DataFrame, k: int, step: str = "step") -> DataFrame:
    return df.where(F.col(step) % k == 0)


def with_validations(steps: DataFrame, validations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps with the validation loss measured at the same step, where there is one."""
    return steps.join(validations.select(*keys, "val_loss"), list(keys), "left")


def keep_last(
    saved: DataFrame, keys: Sequence[str], seq: str, name: str, n: int, protected: Sequence[str] = ("latest", "best"),
) -> DataFrame:
    """The newest ``n`` checkpoints of each run and the protected ones; all of them for ``n <= 0``."""
    if n <= 0:
        return saved
    newest = top_k(saved, keys, [F.col(seq).desc()], n)
    exempt = saved.where(F.col(name).isin(*protected))
    older = exempt.join(newest.select(*keys, seq), [*keys, seq], "left_anti")
    return newest.unionByName(older)


def run_counters(events: DataFrame, kind: str, at: Column, value: str, kinds: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """One counter per event kind, the time between first and last event in units of ``at``, and the peak value."""
    counters = [F.count_if(F.col(kind) == k).alias(out) for k, out in kinds.items()]
    return events.groupBy(*by).agg(*counters, (F.max(at) - F.min(at)).alias("elapsed"), F.max(value).alias("peak"))


def parameter_totals(
    params: DataFrame, numel: str = "numel", trainable: str = "trainable", base_bytes: int = 2, state_bytes: int = 1,
) -> DataFrame:
    """Total, trainable and frozen parameters, the trainable percentage and a static memory estimate in GB.

    Trainable weights and gradients are held in 4 bytes, the optimiser keeps two states of ``state_bytes``.
    """
    t = F.coalesce(F.col(trainable), F.lit(False))
    out = params.agg(F.coalesce(F.sum(numel), F.lit(0)).cast("bigint").alias("total"),
                     F.coalesce(F.sum(F.when(t, F.col(numel))), F.lit(0)).cast("bigint").alias("trainable"))
    frozen = F.col("total") - F.col("trainable")
    held = F.col("trainable")
    parts = {
        "frozen_weights_gb": frozen * base_bytes / 1e9, "trainable_params_gb": held * 4 / 1e9,
        "gradients_gb": held * 4 / 1e9, "optimizer_state_gb": held * (2 * state_bytes) / 1e9,
    }
    return out.select(
        "total", "trainable", frozen.alias("frozen"),
        F.coalesce(F.try_divide(held * 100.0, F.col("total")), F.lit(0.0)).alias("trainable_pct"),
        *[c.alias(n) for n, c in parts.items()], reduce(add, parts.values()).alias("static_total_gb"),
    )


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """One row per (row, broken rule); an unknown outcome counts as broken."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(id_col, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))
