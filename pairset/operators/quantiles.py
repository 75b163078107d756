"""Exact quantiles of a column of any length.

A single ``percentile`` aggregate keeps one counter per distinct value in one task, so it is used only for
columns of a checked length. Longer columns are searched rank by rank, all ranks in the same passes: two
values that ``percentile_approx`` puts on either side of a rank are counted exactly, and the search goes on
strictly between them. A value that many rows share settles its ranks as soon as it is one of the two.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairset.schema import null_if_nan


@dataclass
class _Search:
    """The value at a 0-based rank lies strictly between ``low`` and ``high``; None is unbounded."""

    rank: int
    low: float | None
    high: float | None
    below: int             # rows at or below ``low``
    inside: int            # rows strictly between
    value: float | None = None

    def within(self) -> Column:
        above = F.lit(True) if self.low is None else F.col("v") > self.low
        return above if self.high is None else above & (F.col("v") < self.high)


def exact_quantiles(
    df: DataFrame, value: Column | str, probs: Sequence[float],
    direct_rows: int = 1_000_000, bracket_rows: int = 100_000, accuracy: int = 10_000,
) -> list[float | None]:
    """Linearly interpolated quantiles of the non-null values, one per entry of ``probs``."""
    v = null_if_nan((F.col(value) if isinstance(value, str) else value).cast("double"))
    values = df.select(v.alias("v")).where(F.col("v").isNotNull())
    total = values.count()
    if total == 0:
        return [None for _ in probs]
    if total <= direct_rows:
        found = values.agg(F.percentile("v", [float(p) for p in probs]).alias("q")).first()["q"]
        return [float(x) for x in found]

    ranks = set()
    for p in probs:
        at = p * (total - 1)
        ranks |= {math.floor(at), min(math.floor(at) + 1, total - 1)}
    found = _values_at(values, sorted(ranks), total, bracket_rows, accuracy)
    out = []
    for p in probs:
        at = p * (total - 1)
        lower, fraction = math.floor(at), at - math.floor(at)
        a, b = found[lower], found[min(lower + 1, total - 1)]
        out.append(a if fraction == 0.0 or a == b else (1.0 - fraction) * a + fraction * b)
    return out


def _values_at(values: DataFrame, ranks: list[int], total: int, bracket_rows: int, accuracy: int) -> dict[int, float]:
    searches = [_Search(r, None, None, 0, total) for r in ranks]
    while True:
        wide = [s for s in searches if s.value is None and s.inside > bracket_rows]
        if not wide:
            break
        _narrow(values, wide, accuracy)
    for s in searches:
        if s.value is None:
            s.value = _read(values, s)
    return {s.rank: s.value for s in searches}


def _narrow(values: DataFrame, searches: list[_Search], accuracy: int) -> None:
    """One step of every search: two scans, each with a few aggregates per rank."""
    values = values.where(reduce(or_, (s.within() for s in searches)))
    pivots = []
    for i, s in enumerate(searches):
        at, slack = (s.rank - s.below) / s.inside, 2.0 / accuracy
        around = [max(at - slack, 0.0), min(at + slack, 1.0)]
        pivots.append(F.percentile_approx(F.when(s.within(), F.col("v")), around, accuracy).alias(f"p{i}"))
    found = values.agg(*pivots).first()
    counts = []
    for i, s in enumerate(searches):
        a, b = found[f"p{i}"]
        v = F.col("v")
        for name, where in (("before", s.within() & (v < a)), ("at_a", v == a), ("between", (v > a) & (v < b)), ("at_b", v == b)):
            counts.append(F.count_if(where).alias(f"{name}{i}"))
    counted = values.agg(*counts).first()
    for i, s in enumerate(searches):
        a, b = found[f"p{i}"]
        before, at_a, between, at_b = (counted[f"{n}{i}"] for n in ("before", "at_a", "between", "at_b"))
        if a == b:
            at_b = 0
        from_a = s.below + before
        after_a, from_b, after_b = from_a + at_a, from_a + at_a + between, from_a + at_a + between + at_b
        if s.rank < from_a:
            s.high, s.inside = a, before
        elif s.rank < after_a:
            s.value = a
        elif s.rank < from_b:
            s.low, s.high, s.below, s.inside = a, b, after_a, between
        elif s.rank < after_b:
            s.value = b
        else:
            s.low, s.below, s.inside = b, after_b, s.below + s.inside - after_b


def _read(values: DataFrame, s: _Search) -> float:
    """The value at the rank, from the few distinct values left and their counts."""
    distinct = values.where(s.within()).groupBy("v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = distinct.select("v", (upto + s.below).alias("upto"))
    return ranked.where(F.col("upto") > s.rank).agg(F.min("v")).first()[0]


def exact_median(df: DataFrame, value: Column | str, **limits: int) -> float | None:
    return exact_quantiles(df, value, [0.5], **limits)[0]
