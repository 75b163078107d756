"""The counted filter cascade.

All stages are evaluated in one scan: each row is labelled with the first stage it fails. The survivors are
the rows without a label and the ledger is one aggregate over the label, so no stage re-reads the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairset.functions.columns import single_part_signature, sketch_signature
from pairset.schema import as_flag, holds

FAILED_AT = "_failed_at"


@dataclass(frozen=True)
class Stage:
    """A named predicate; rows for which it is not true are removed."""

    name: str
    keep: Column


@dataclass(frozen=True)
class CurationLimits:
    """Thresholds of the standard cascade. The two unvalidated filters are off by default."""

    drop_duplicates: bool = True
    require_hi_res: bool = True
    min_garment_score: float = 0.0
    max_person_fraction: float = 0.002
    reject_part_renders: bool = True
    part_top_lo: float = 0.10
    part_top_hi: float = 0.35
    enable_sketch_filter: bool = False
    max_flat_fraction: float = 0.90
    min_colorfulness: float = 8.0
    enable_collage_filter: bool = False
    max_foreground_components: int = 3


def standard_stages(limits: CurationLimits = CurationLimits()) -> list[Stage]:
    """The stages of the pair-index curation, in order of application."""
    stages: list[Stage] = []
    if limits.drop_duplicates:
        # A flag of unknown value is not a duplicate flag.
        stages.append(Stage("drop is_duplicate", ~as_flag("is_duplicate")))
    if limits.require_hi_res:
        stages.append(Stage("require is_hi_res", as_flag("is_hi_res")))
    stages.append(Stage(f"garment_score > {limits.min_garment_score}",
                        F.col("garment_score") > limits.min_garment_score))
    stages.append(Stage(f"person_frac < {limits.max_person_fraction}",
                        F.col("person_frac") < limits.max_person_fraction))
    if limits.reject_part_renders:
        stages.append(Stage("reject part render", ~single_part_signature(
            "top_frac", "dress_frac", "skirt_frac", "pants_frac", limits.part_top_lo, limits.part_top_hi)))
    if limits.enable_sketch_filter:
        stages.append(Stage("reject sketch", ~sketch_signature(
            "flat_frac", "colorfulness", limits.max_flat_fraction, limits.min_colorfulness)))
    if limits.enable_collage_filter:
        stages.append(Stage(f"n_components <= {limits.max_foreground_components}",
                            F.col("n_components") <= limits.max_foreground_components))
    return stages


def label_first_failure(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Add the 1-based ordinal of the first stage each row fails, NULL for survivors."""
    label = F.lit(None).cast("int")
    for ordinal in range(len(stages), 0, -1):
        label = F.when(~holds(stages[ordinal - 1].keep), F.lit(ordinal)).otherwise(label)
    return df.withColumn(FAILED_AT, label)


def survivors(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Rows that pass every stage, as one pushed-down conjunction."""
    kept = df
    for stage in stages:
        kept = kept.where(stage.keep)
    return kept


def ledger(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """``(ordinal, stage, removed, remaining)`` for every stage, zero-removal stages included."""
    return ledger_of_labels(label_first_failure(df, stages), stages)


def ledger_of_labels(labelled: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """The ledger of rows that ``label_first_failure`` has labelled."""
    removed = [F.count_if(F.col(FAILED_AT) == i).alias(f"r{i}") for i in range(1, len(stages) + 1)]
    counted = labelled.agg(F.count(F.lit(1)).alias("total"), *removed)
    rows, left = [], F.col("total")
    for i, stage in enumerate(stages, 1):
        left = left - F.col(f"r{i}")
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(stage.name).alias("stage"),
                             F.col(f"r{i}").alias("removed"), left.alias("remaining")))
    return counted.select(F.inline(F.array(*rows)))
