"""Evaluation subsets and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairset.functions.columns import FABRIC_RULES, Rules, bucket_by_edges, keyword_family, minimum_side, size_bucket
from pairset.operators import evaluate, joins, sample
from pairset.operators.quantiles import exact_median, exact_quantiles
from pairset.schema import present

# The axes an evaluation subset is balanced over and results are broken down by.
AXES = ("source", "is_clean", "fabric_family", "res_bucket", "gscore_q", "target_type")


def with_strata(index: DataFrame, rules: Rules = FABRIC_RULES) -> DataFrame:
    """Add keyword family, size class and score quartile to index rows."""
    edges = exact_quantiles(index, "garment_score", [0.25, 0.5, 0.75])
    side = minimum_side("person_w", "person_h")
    return index.withColumns({
        "fabric_family": keyword_family("title", rules), "min_side": side, "res_bucket": size_bucket(side),
        "gscore_q": bucket_by_edges("garment_score", edges) if edges[0] is not None else F.lit(None).cast("string"),
    })


def evaluation_subset(index: DataFrame, n: int = 120, min_per_level: int = 2, seed: int = 1337,
                      axes: Sequence[str] = AXES) -> DataFrame:
    """A reproducible draw from the ``test`` split, balanced over all axes at once."""
    population = with_strata(index.where(F.col("split") == "test"))
    return sample.stratified_subset(population, list(axes), n, "id", min_per_level, seed)


def showcase_pool(train: DataFrame, audited: DataFrame, pool: int = 400, min_side: int = 768, seed: int = 4242) -> DataFrame:
    """Candidates for a small, varied subset: not audited out, real models, top half by score, large enough."""
    kept = sample.without_listed(train, audited).where(F.col("target_type") == "model")
    middle = exact_median(kept, "garment_score")
    kept = kept.where(F.col("garment_score") >= F.lit(middle)).where(minimum_side("person_w", "person_h") >= min_side)
    return sample.candidate_pool(kept.withColumn("fabric_family", keyword_family("title")), "fabric_family", "id", seed, pool)


def showcase_subset(candidates: DataFrame, colours: DataFrame, n: int = 24, seed: int = 4242) -> DataFrame:
    """The ``n`` candidates farthest apart in colour, family and source; ``colours(id, hue, sat, val)``."""
    return sample.diverse_subset(candidates.join(colours, "id"), n, seed=seed)


def run_report(scores: DataFrame, metrics: Sequence[str], axes: Sequence[str] = AXES) -> dict[str, DataFrame]:
    """Mean and deviation by mode, means by mode and axis, and the run summary."""
    have = present(scores, metrics)
    return {
        "overall": evaluate.mean_std(scores, ["mode"], have),
        "by_axis": evaluate.means_by_axes(scores, "mode", present(scores, axes), have),
        "summary": evaluate.run_summary(scores, have),
    }


def compare_runs(a: DataFrame, b: DataFrame, strict: bool = True, key: str = "id") -> DataFrame:
    """Paired comparison on every registered metric that both runs have."""
    names = [m for m in evaluate.available() if m in a.columns and m in b.columns]
    specs = [evaluate.metric(m) for m in names]
    return evaluate.paired_diff(joins.paired(a, b, key, names), specs, strict)
