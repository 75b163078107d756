"""Connected components of link tables by alternating stars, with the last round kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairset.llm.common import discard, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node of ``edges`` (``a``, ``b``).

    A round hangs every larger neighbour on the smallest one, then every node on the smallest of those below it.
    No step collects a node's neighbours: minima are aggregated and joined back, so a hub is split like any
    skewed join. Self links and NULL ends are ignored.
    """
    current = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links",
    )
    seen = None
    for _ in range(rounds):
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == seen:
            break
        seen = (state.n, state.h)
        both = current.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        lowest = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        previous, current = current, stored(large.join(low, "a").select(F.inline(hung)).where("a > b").distinct(), "links")
        discard(previous)
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
