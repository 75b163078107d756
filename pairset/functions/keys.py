"""Deterministic ordering keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shuffle_key(id_col: Column | str, seed: int) -> Column:
    """The first 32 bits of ``md5("seed:id")`` as a bigint: a stable pseudo-random order."""
    text = F.concat(F.lit(f"{seed}:"), _col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def chosen_with_probability(id_col: Column | str, probability: float, seed: int) -> Column:
    """A reproducible coin flip per id: true for about ``probability`` of all ids."""
    if not 0.0 <= probability <= 1.0:
        raise ValueError("probability must be within [0, 1]")
    return shuffle_key(id_col, seed) < F.lit(int(round(probability * 2**32)))
