"""Deterministic splits and manifest hashes.

A split takes the ``n`` rows with the smallest ``(shuffle_key, id)``. Sorting the pool, or collecting the
``n`` winners, would not survive a large pool, so only the cut point is searched: a histogram of the key's
upper half locates the slice that holds the n-th row, a histogram of its lower half the exact key, and one
bounded top-k the id. Membership is then a plain column predicate, without a shuffle of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairset.functions.keys import shuffle_key
from pairset.schema import struct_of
from pairset.session import map_batches

_SLICE = 1 << 16


@dataclass(frozen=True)
class Cut:
    """The last ``(key, id)`` that is still inside, with the sizes on both sides."""

    key: int | None
    id: object
    inside: int
    total: int
    id_type: T.DataType

    def contains(self, id_col: str, seed: int) -> Column:
        """Membership as one comparison of ``(key, id)``, so the key is hashed once per row."""
        if self.key is None:
            return F.lit(False)
        last = F.struct(F.lit(self.key).cast("bigint"), F.lit(self.id).cast(self.id_type))
        return F.struct(shuffle_key(id_col, seed), F.col(id_col)) <= last


def _find(counts: DataFrame, target: Column):
    """The histogram bin that holds the ``target``-th row, with the rows up to it and the total."""
    upto = F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("n").over(W.partitionBy())
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    return (
        ranked.withColumn("target", F.least(target, F.col("total")))
        .where((F.col("target") > 0) & (F.col("upto") >= F.col("target")))
        .orderBy("bin").limit(1)
    )


def hash_cut(
    df: DataFrame, id_col: str, seed: int, n: int | None = None, fraction: float | None = None,
    at_least: int = 1, bounded_rows: int = 100_000,
) -> Cut:
    """Find the cut that puts ``n`` rows, or ``max(at_least, int(total * fraction))`` rows, inside."""
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    id_type = df.schema[id_col].dataType
    keys = df.select(F.col(id_col).alias("id"), shuffle_key(id_col, seed).alias("k"))
    upper = F.floor(F.col("k") / _SLICE).cast("int")
    wanted = F.lit(n) if n is not None else F.greatest(
        F.lit(at_least), (F.col("total") * F.lit(float(fraction))).cast("bigint"))
    found = _find(keys.groupBy(upper.alias("bin")).agg(F.count("*").alias("n")), wanted).first()
    if found is None:
        return Cut(None, None, 0, 0 if n is None else df.count(), id_type)
    rest = found["target"] - (found["upto"] - found["n"])
    inside = keys.where(upper == found["bin"])
    if found["n"] > bounded_rows:
        exact = _find(inside.groupBy(F.col("k").alias("bin")).agg(F.count("*").alias("n")), F.lit(rest)).first()
        rest -= exact["upto"] - exact["n"]
        inside = inside.where(F.col("k") == exact["bin"])
    last = inside.orderBy("k", "id").limit(rest).agg(F.max(F.struct("k", "id"))).first()[0]
    return Cut(last["k"], last["id"], found["target"], found["total"], id_type)


def split_train_val(
    df: DataFrame, id_col: str = "id", fraction: float = 0.05, seed: int = 1337,
    pool: Column | None = None, held_out: str = "test",
) -> DataFrame:
    """Add ``part``: ``val`` for the cut, ``train`` for the rest of the pool, ``held_out`` outside it.

    The validation part has ``max(1, int(pool * fraction))`` rows. Rows outside the pool are never drawn.
    """
    in_pool = F.lit(True) if pool is None else F.coalesce(pool, F.lit(False))
    cut = hash_cut(df.where(in_pool), id_col, seed, fraction=fraction)
    return df.withColumn("part", part_of(cut, in_pool, id_col, seed, held_out))


def part_of(cut: Cut, in_pool: Column, id_col: str = "id", seed: int = 1337, held_out: str = "test") -> Column:
    """The part a row belongs to, for a cut that is already known."""
    return F.when(~in_pool, held_out).when(cut.contains(id_col, seed), "val").otherwise("train")


def split_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("part").agg(F.count("*").alias("n"))


def manifest_hash(selection: DataFrame, id_col: str = "id") -> DataFrame:
    """First 16 hex digits of the SHA-256 over the comma-joined sorted ids of a selection.

    The digest is sequential by definition: one task reads the ids, which Spark sorts and spills, and feeds
    them to the hash one batch at a time. ``n`` counts all rows; NULL ids are not part of the digest.
    """
    ids = selection.select(F.col(id_col).cast("string").alias("id")).repartition(1).sortWithinPartitions("id")
    empty = hashlib.sha256().hexdigest()[:16]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, n, started = hashlib.sha256(), 0, False
        for batch in batches:
            n += len(batch)
            known = batch["id"].dropna()
            if len(known):
                state.update(((b"," if started else b"") + ",".join(known).encode()))
                started = True
        yield pd.DataFrame({"n": [n], "manifest": [state.hexdigest()[:16]]})

    found = map_batches(ids, digest, struct_of("n bigint, manifest string"))
    return found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("manifest"), F.lit(empty)).alias("manifest"))


def fingerprint(df: DataFrame, id_col: str = "id") -> DataFrame:
    """An order-free fingerprint of the ids of a table of any size, by partial aggregation only."""
    head = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.bit_xor(head).alias("ids_xor"))
