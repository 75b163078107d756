"""Curation end to end: index and statistics in, ledger, clean rows and split out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairset.operators import cascade, joins, split
from pairset.schema import holds
from pairset.session import checkpointed
from pairset.sources import tables, versions


@dataclass(frozen=True)
class Curation:
    ledger: DataFrame
    clean: DataFrame
    labelled: DataFrame
    sizes: DataFrame
    summary: DataFrame


def curate(
    index: DataFrame, stats: DataFrame, limits: cascade.CurationLimits = cascade.CurationLimits(),
    fraction: float = 0.05, seed: int = 1337, stages: Sequence[cascade.Stage] | None = None,
) -> Curation:
    """Join the statistics, apply the cascade and split the clean ``train`` rows.

    The join runs once on the columns of the predicates; its outcome, an id and a stage number per row, is
    materialised and serves the ledger, the cut and the sizes. Whole rows are joined once more, when the
    clean table is read. The validation part is drawn from clean rows of the index's own ``train`` split;
    its ``test`` split stays untouched.
    """
    stages = cascade.standard_stages(limits) if stages is None else stages
    merged = joins.index_with_stats(index, stats)
    clean = cascade.survivors(merged, stages)
    outcome = checkpointed(cascade.label_first_failure(merged, stages).select("id", "split", cascade.FAILED_AT))
    ledger = cascade.ledger_of_labels(outcome, stages)
    in_pool = holds(F.col("split") == "train")
    passed = outcome.where(F.col(cascade.FAILED_AT).isNull())
    cut = split.hash_cut(passed.where(in_pool), "id", seed, fraction=fraction)
    part = split.part_of(cut, in_pool, "id", seed)
    labelled = clean.withColumn("part", part)
    sizes = split.split_sizes(passed.withColumn("part", part))
    counts = ledger.agg(
        F.min_by(F.col("removed") + F.col("remaining"), "ordinal").alias("input_pairs"),
        F.max_by("remaining", "ordinal").alias("clean_pairs"),
        F.sort_array(F.collect_list(F.struct("ordinal", "stage", "removed", "remaining"))).alias("stages"),
    )
    parts = sizes.agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(name)
                        for p, name in (("train", "train"), ("val", "validation"), ("test", "held_out"))])
    thresholds = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in asdict(limits).items()]))
    # One row each: the ledger has one row per stage, the sizes one per part.
    summary = counts.withColumn("_one", F.lit(1)).join(parts.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return Curation(ledger, clean, labelled, sizes, summary.withColumn("thresholds", thresholds))


def write_curation(result: Curation, out: str) -> str:
    """Splits, stages and summary as one published version; returns its folder.

    Readers that go by ``versions.current`` never see splits of one curation beside the ledger of another.
    """
    spark = result.ledger.sparkSession

    def write(folder: str) -> None:
        tables.write_splits(result.labelled, f"{folder}/splits")
        tables.write_csv(result.ledger.coalesce(1).orderBy("ordinal"), f"{folder}/cleaning_stages")
        tables.write_metadata(result.summary, f"{folder}/cleaning_summary")

    versions.publish(spark, out, write)
    return versions.current(spark, out)
