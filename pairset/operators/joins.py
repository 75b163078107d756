"""Equi-joins of the curation and evaluation plans. No side is hinted; Spark picks by measured size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairset.schema import as_flag


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of a table, once each, for semi and anti joins.

    A key may fill a large part of a log; merged before the shuffle it costs one row per task. The join
    reuses the shuffle of this aggregation.
    """
    return df.select(*keys).distinct()


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals NULL; the keys come from the left side."""
    named = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, same, how).drop(*[f"_r_{c}" for c in keys])


def index_with_stats(index: DataFrame, stats: DataFrame, id_col: str = "id", ok: str | None = "probe_ok") -> DataFrame:
    """Index rows that have statistics, limited to successful probes where ``ok`` names the flag."""
    good = stats if ok is None else stats.where(as_flag(ok))
    return index.join(good, id_col)


def missing_ids(wanted: DataFrame, have: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of ``wanted`` whose key does not occur in ``have``."""
    return wanted.join(distinct_keys(have, keys), list(keys), "left_anti")


def complete_rows(manifest: DataFrame, complete: DataFrame, id_col: str = "id") -> DataFrame:
    """Manifest rows whose artefact set is complete."""
    return manifest.join(distinct_keys(complete, [id_col]), id_col, "left_semi")


def completeness(manifest: DataFrame, complete: DataFrame, id_col: str = "id") -> DataFrame:
    """``(n_total, n_present, n_missing)`` of a manifest against the complete ids."""
    flags = distinct_keys(complete, [id_col]).withColumn("_here", F.lit(1))
    joined = manifest.select(id_col).join(flags, id_col, "left")
    here = F.count("_here")
    return joined.agg(F.count("*").alias("n_total"), here.alias("n_present"),
                      (F.count("*") - here).alias("n_missing"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no usable rows in {what}")
    return df


def with_default(
    df: DataFrame, lookup: DataFrame, key: str, flag: str, when_true: str, when_false: str,
    out: str, fallback: str | None = None,
) -> DataFrame:
    """Add a value chosen by a looked-up flag; unknown keys get ``fallback`` or the false value."""
    known = lookup.select(key, as_flag(flag).alias("_flag"))
    chosen = F.when(F.col("_flag"), when_true).when(~F.col("_flag"), when_false)
    other = when_false if fallback is None else fallback
    return df.join(known, key, "left").withColumn(out, F.coalesce(chosen, F.lit(other))).drop("_flag")


def paired(a: DataFrame, b: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Rows scored in both runs, the metrics suffixed ``_a`` and ``_b``."""
    left = a.select(key, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(key, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return left.join(right, key)


def pivot_modes(df: DataFrame, key: str, mode: str, modes: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key with a column per (mode, metric); the modes are given, so no extra scan finds them."""
    cells = [F.max(F.when(F.col(mode) == m, F.col(v))).alias(f"{m}_{v}") for m in modes for v in metrics]
    return df.groupBy(key).agg(*cells)


def with_run_columns(base: DataFrame, runs: Mapping[str, DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """Left-join several runs' columns to ``base``; a run without the key leaves NULLs."""
    out = base
    for name, run in runs.items():
        have = [c for c in columns if c in run.columns]
        out = out.join(run.select(key, *[F.col(c).alias(f"{c}_{name}") for c in have]), key, "left")
    return out


def in_listed_order(df: DataFrame, ids: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """Rows named by an id list, with the place of their first mention."""
    places = ids.select(F.posexplode(list_col).alias("place", id_col)).groupBy(id_col).agg(
        F.min("place").alias("place"))
    return df.join(places, id_col)


def category_labels(df: DataFrame, labels: DataFrame, category: str) -> DataFrame:
    """Each row with the label names its category covers: ``labels(category, role, label)``."""
    return df.join(labels.withColumnRenamed("category", category), category)
