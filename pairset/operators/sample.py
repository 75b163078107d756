"""Shares, targets and deterministic draws.

Everything about axes is computed from the strata table, one row per combination of axis levels, so the
samples themselves are read and aggregated once however many axes there are.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairset.functions.columns import circular_distance
from pairset.functions.keys import shuffle_key
from pairset.operators.joins import missing_ids
from pairset.operators.sequence import position, top_k
from pairset.schema import null_if_nan
from pairset.session import checkpointed

#: Scores are compared to so many parts of one, bounds on them to fewer.
_DIGITS, _BOUND = 1e11, 1e9


def with_levels(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Axes as text levels; NULL is a level of its own."""
    return df.withColumns({a: F.coalesce(F.col(a).cast("string"), F.lit("null")) for a in axes})


def strata_counts(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    return with_levels(df, axes).groupBy(*axes).agg(F.count("*").alias("n"))


def _unpivoted(strata: DataFrame, axes: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("level")) for a in axes])
    return strata.select(F.inline(pairs), "n")


def marginal_shares(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """``(axis, level, n, share)`` of every level of every axis."""
    counts = _unpivoted(strata_counts(df, axes), axes).groupBy("axis", "level").agg(F.sum("n").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("axis")))


def target_shares(df: DataFrame, axes: Sequence[str], n: int, floor_rows: int = 2) -> DataFrame:
    """Shares to aim at in a draw of ``n``: rare levels are lifted to ``floor_rows / n``, no level is asked
    for more than it has, and each axis is scaled to sum to one."""
    shares = marginal_shares(df, axes)
    lifted = F.greatest(F.col("share"), F.lit(floor_rows / n))
    aimed = F.least(lifted, F.col("n") / F.lit(float(n)))
    return shares.select(
        "axis", "level", F.col("share").alias("population_share"), F.col("n").alias("supply"),
        aimed.alias("_t"),
    ).select(
        "axis", "level", "population_share", "supply",
        (F.col("_t") / F.sum("_t").over(W.partitionBy("axis"))).alias("target"),
    )


def share_deviation(subset: DataFrame, targets: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Total absolute deviation of the subset's shares from the targets, over all axes."""
    got = marginal_shares(subset, axes).select("axis", "level", "share")
    both = targets.join(got, ["axis", "level"], "left")
    off = F.abs(F.coalesce(F.col("share"), F.lit(0.0)) - F.col("target"))
    return both.agg(F.sum(off).alias("deviation"), F.count("*").alias("n_levels"))


def subset_vs_population(subset: DataFrame, population: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Level counts and shares of a subset next to the population's shares."""
    s = marginal_shares(subset, axes).select("axis", "level", F.col("n").alias("n_subset"),
                                             F.col("share").alias("subset_share"))
    p = marginal_shares(population, axes).select("axis", "level", F.col("n").alias("n_population"),
                                                 F.col("share").alias("population_share"))
    joined = p.join(s, ["axis", "level"], "full")
    zero = {"n_subset": 0, "subset_share": 0.0, "n_population": 0, "population_share": 0.0}
    return joined.fillna(zero)


def spread_report(df: DataFrame, value: Column, distinct: Column) -> DataFrame:
    """Range of one column and number of distinct values of another."""
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"),
                  F.count_distinct(distinct).alias("n_distinct"))


def argmax_row(df: DataFrame, value: str, id_col: str) -> DataFrame:
    """The row with the largest value, the smallest id among ties."""
    return df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), F.col(id_col)).limit(1)


def candidate_pool(
    df: DataFrame, group: str, id_col: str = "id", seed: int = 4242, pool: int = 400,
    per_group: int | None = None,
) -> DataFrame:
    """The first rows of each group in hash order, ``pool`` in all, spread over the groups."""
    k = per_group if per_group is not None else max(20, pool // 5)
    keyed = df.withColumn("_k", shuffle_key(id_col, seed))
    first = top_k(keyed, [group], [F.col("_k"), F.col(id_col)], k)
    return first.orderBy("_k", id_col).limit(pool)


def first_in_hash_order(df: DataFrame, n: int, id_col: str = "id", seed: int = 1337) -> DataFrame:
    """The first ``n`` rows in the stable pseudo-random order, as a top-n without a full sort."""
    return df.orderBy(shuffle_key(id_col, seed), id_col).limit(n)


def first_in_id_order(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The head of a table, made definite by ordering on the id."""
    return df.orderBy(id_col).limit(n)


def without_listed(df: DataFrame, reasons: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is not on the audited exclusion list."""
    return missing_ids(df, reasons, [id_col])


def listed(df: DataFrame, reasons: DataFrame, id_col: str = "id") -> DataFrame:
    """The excluded rows together with the reason recorded for each."""
    return df.join(reasons.select(id_col, "reason"), id_col)


# ------------------------------------------------------------------------------ stratified draw
def stratified_subset(
    df: DataFrame, axes: Sequence[str], n: int, id_col: str = "id", floor_rows: int = 2, seed: int = 1337,
    candidates: int = 20_000, keys_per_pass: int = 200_000,
) -> DataFrame:
    """Draw ``n`` rows whose marginal shares on all axes come closest to the targets, greedily.

    Each pick adds the row that lowers the total deviation most, to eleven digits; ties go to the smallest
    ``(shuffle key, id)``. Rows of one stratum are interchangeable, so the greedy search runs over strata, of which Spark keeps the
    first ``n`` keys. A pass brings the strata drawn from so far (at most ``n``) and the ``candidates`` best others to the
    driver, with about ``keys_per_pass`` of their next keys, and goes on while a bound shows that no stratum outside can be
    better. While there are no more strata than ``candidates`` a pass only ends when a stratum's keys run out. The driver also
    holds the targets, one number per level of an axis.
    """
    keyed = with_levels(df, axes).withColumn("_k", shuffle_key(id_col, seed))
    targets = target_shares(df, axes, n, floor_rows)
    first = [F.col("_k"), F.col(id_col)]
    place = F.row_number().over(W.partitionBy(*axes).orderBy(*first)) - 1
    heads = checkpointed(top_k(keyed.select(*axes, "_k", id_col), list(axes), first, n).withColumn("_place", place))
    strata = heads.groupBy(*axes).agg(F.count("*").alias("_supply"), F.min(F.struct(F.col("_k").alias("k"), F.col(id_col).alias("id"))).alias("_head"))
    for i, a in enumerate(axes):
        goal = targets.where(F.col("axis") == a).select(F.col("level").alias(a), F.col("target").alias(f"_aim{i}"))
        strata = strata.join(goal, a)
    take = _take(checkpointed(strata), heads, axes, n, id_col, candidates, keys_per_pass)
    if not take:
        return df.limit(0)
    quota = _levels_frame(df.sparkSession, axes, take, "_take")
    # At most n strata give rows, so the quota table and the chosen ids are bounded by n.
    chosen = heads.join(F.broadcast(quota), list(axes)).where(F.col("_place") < F.col("_take")).select(id_col)
    return df.join(F.broadcast(chosen), id_col, "left_semi")


def _levels_frame(spark: SparkSession, axes: Sequence[str], values: Mapping[tuple, int], name: str) -> DataFrame:
    schema = ", ".join([*(f"`{a}` string" for a in axes), f"{name} int"])
    return spark.createDataFrame([(*levels, int(v)) for levels, v in values.items()], schema)


def _others(strata: DataFrame, axes: Sequence[str], drawn: Mapping[tuple, int], step: int, horizon: int, limit: int) -> list[Row]:
    """The best ``limit`` strata without a drawn row, by a bound on their scores over the next ``horizon`` picks.

    At pick ``t`` a level that has been drawn ``c`` times adds ``clip(2c + 1 - 2 aim t, -1, 1) / t`` to a score. The numerator
    falls with ``t`` and rises with ``c``, so its value for the last of these picks bounds all of them. The bound of one pick is
    the score itself.
    """
    spark, counts = strata.sparkSession, [{} for _ in axes]
    for levels, m in drawn.items():
        for count, level in zip(counts, levels):
            count[level] = count.get(level, 0) + m
    left = strata
    if drawn:
        # all tables of drawn strata and levels have at most n rows
        left = left.join(F.broadcast(_levels_frame(spark, axes, drawn, "_drawn")), list(axes), "left_anti")
        for i, (a, count) in enumerate(zip(axes, counts)):
            left = left.join(F.broadcast(_levels_frame(spark, [a], {(k,): v for k, v in count.items()}, f"_c{i}")), a, "left")
    bound, t = F.lit(0.0), step + horizon
    for i in range(len(axes)):
        c, aim = F.coalesce(F.col(f"_c{i}"), F.lit(0)) if drawn else F.lit(0), F.col(f"_aim{i}")
        exact = F.abs((c + 1) / t - aim) - F.abs(c / t - aim)
        bound = bound + (exact if horizon == 1 else F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * c + 1 - 2 * t * aim)))
    scaled = F.floor(bound * _DIGITS + 0.5) if horizon == 1 else F.floor(bound * _BOUND)
    return left.withColumn("_bound", scaled).orderBy("_bound", "_head").limit(limit).collect()


def _take(
    strata: DataFrame, heads: DataFrame, axes: Sequence[str], n: int, id_col: str, candidates: int, keys_per_pass: int,
) -> dict[tuple, int]:
    """How many rows each stratum gives, by the greedy search."""
    drawn: dict[tuple, int] = {}
    facts: dict[tuple, Row] = {}
    step, horizon = 0, n
    while step < n:
        others = _others(strata, axes, drawn, step, horizon, candidates)
        cut = (others[-1]["_bound"], tuple(others[-1]["_head"])) if len(others) == candidates else None
        working = {tuple(r[a] for a in axes): r for r in others}
        working |= {key: facts[key] for key, m in drawn.items() if m < facts[key]["_supply"]}
        if not working:
            break
        fetched = max(1, keys_per_pass // len(working))
        wanted = F.broadcast(_levels_frame(strata.sparkSession, axes, {key: drawn.get(key, 0) for key in working}, "_from"))
        block = heads.join(wanted, list(axes)).where(F.col("_place").between(F.col("_from"), F.col("_from") + fetched - 1))
        queues: dict[tuple, list] = {key: [] for key in working}
        for r in block.select(*axes, "_k", id_col).collect():
            queues[tuple(r[a] for a in axes)].append((r["_k"], r[id_col]))
        before = step
        for key in _picks(working, {k: sorted(q) for k, q in queues.items()}, axes, drawn, step, n, horizon, cut):
            facts[key] = working[key]
            drawn[key] = drawn.get(key, 0) + 1
            step += 1
        horizon = 1 if step == before else max(2, 2 * (step - before)) if cut else n
    return drawn


def _picks(
    working: Mapping[tuple, Row], queues: Mapping[tuple, list], axes: Sequence[str], drawn: Mapping[tuple, int], step: int, n: int,
    horizon: int, cut: tuple | None,
) -> list[tuple]:
    """The strata of the next picks, as long as no other stratum can be better and no queue has run out."""
    keys = list(working)
    index: dict[tuple, int] = {}
    aims: list[float] = []
    for key in keys:
        for i, level in enumerate(key):
            if (i, level) not in index:
                index[i, level] = len(aims)
                aims.append(working[key][f"_aim{i}"])
    aim = np.array(aims)
    level = np.array([[index[i, lv] for i, lv in enumerate(key)] for key in keys])
    counts = np.zeros(len(aims))
    for key, m in drawn.items():
        for i, lv in enumerate(key):
            if (i, lv) in index:
                counts[index[i, lv]] += m
    queue = sorted((q[0], s, 0) for s, key in enumerate(keys) if (q := queues[key]))
    chosen: list[tuple] = []
    last = min(n, step + horizon)
    while queue and step < last:
        t = step + 1
        # Adding a row changes the deviation only at its own levels.
        gain = np.abs((counts + 1) / t - aim) - np.abs(counts / t - aim)
        score = gain[level[[s for _, s, _ in queue]]].sum(axis=1)
        rounded = np.floor(score * _DIGITS + 0.5)
        best = int(rounded.argmin())
        head, s, at = queue[best]
        if cut is not None and not _certain(rounded[best], score[best] * t, head, horizon, cut, len(axes)):
            break
        queue.pop(best)
        key = keys[s]
        chosen.append(key)
        step += 1
        counts[level[s]] += 1
        if at + 1 < len(queues[key]):
            bisect.insort(queue, (queues[key][at + 1], s, at + 1))
        elif drawn.get(key, 0) + at + 1 < working[key]["_supply"]:
            break
    return chosen


def _certain(rounded: float, gain: float, head: tuple, horizon: int, cut: tuple, axes: int) -> bool:
    """Whether a pick is better than everything that is not in the working set."""
    bound, first = cut
    if horizon == 1:
        return (rounded, head) <= (bound, first)
    # no gain is below minus one per axis: there, and only there, a bound that is reached is a tie
    tied = bound == -axes * _BOUND and gain <= -axes + 1 / _BOUND and head < first
    return tied or gain * _BOUND + 1 < bound


# --------------------------------------------------------------------------------- diverse draw
# Distance added where two samples differ in family and in source.
FAMILY_WEIGHT, SOURCE_WEIGHT = 0.35, 0.15


def diverse_subset(
    df: DataFrame, n: int, id_col: str = "id", hue: str = "hue", seed_by: str = "sat",
    categories: Mapping[str, float] | None = None, seed: int = 4242, candidates: int = 20_000, per_pass: int = 200,
) -> DataFrame:
    """Greedy max-min draw: each pick is the row farthest from everything chosen so far.

    The distance is circular in ``hue`` plus a weight per differing category; the first pick has the largest
    ``seed_by``, ties go to the smallest ``(shuffle key, id)``. Rows without a hue are left out. Rows of equal
    profile are at distance zero, so the search runs over one row per distinct profile, in passes of up to ``per_pass`` exact
    picks each; the driver holds the ``candidates`` farthest profiles of a pass, however many there are.
    The result has the input rows plus ``pick``, the 1-based order of choice.
    """
    weights = dict(categories) if categories is not None else {"fabric_family": FAMILY_WEIGHT, "source": SOURCE_WEIGHT}
    names = [hue, *weights]
    measured = df.where(null_if_nan(F.col(hue).cast("double")).isNotNull())
    keyed = measured.select(id_col, seed_by, *names).withColumn("_k", shuffle_key(id_col, seed))
    first = keyed.orderBy(F.col(seed_by).desc_nulls_last(), "_k", id_col).first()
    if first is None:
        return df.limit(0).withColumn("pick", F.lit(None).cast("int"))
    profiles = checkpointed(
        keyed.groupBy(*names).agg(F.min(F.struct("_k", F.col(id_col).alias("id"))).alias("_head")))
    chosen = [first[id_col], *_farthest(profiles, first, n - 1, hue, weights, candidates, per_pass)]
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    picks = spark.createDataFrame([(x, i) for i, x in enumerate(chosen, 1)], f"{id_col} {id_type}, pick int")
    if len(chosen) < n:
        # Every profile is represented; the rest follows in hash order.
        rest = keyed.join(F.broadcast(picks), id_col, "left_anti").orderBy("_k", id_col).limit(n - len(chosen))
        place = F.row_number().over(W.orderBy("_k", id_col)) + len(chosen)
        picks = picks.unionByName(rest.select(id_col, place.alias("pick")))
    # The picks number at most n.
    return df.join(F.broadcast(picks), id_col)


def _farthest(
    profiles: DataFrame, first: Row, n: int, hue: str, weights: Mapping[str, float], candidates: int, per_pass: int,
) -> list:
    """The ids of the next ``n`` picks after ``first``, several to a pass over the profiles.

    A pass lowers every profile's distance by the picks of the pass before, and the driver gets the ``candidates`` farthest.
    Distances only fall, so whatever stays outside is never better than the last of them was: picks among the candidates are
    those of the whole table as long as they are not worse than that.
    """
    names = [hue, *weights]
    state, chosen, fresh = profiles.withColumn("_d", F.lit(float("inf"))), [], [first]
    while len(chosen) < n:
        state = checkpointed(state.withColumn("_d", F.least("_d", *[_distance(hue, weights, p) for p in fresh])))
        rows = state.where("_d > 0").orderBy(F.col("_d").desc(), "_head").limit(candidates).collect()
        if not rows:
            break
        cut = (rows[-1]["_d"], rows[-1]["_head"]) if len(rows) == candidates else (0.0, None)
        rows.sort(key=lambda r: r["_head"])
        nearest = np.array([r["_d"] for r in rows])
        around = np.array([r[hue] for r in rows], dtype=float)
        codes = {c: pd.factorize(pd.Series([r[c] for r in rows], dtype=object), use_na_sentinel=False)[0] for c in weights}
        fresh = []
        while len(chosen) < n and len(fresh) < per_pass:
            best = int(nearest.argmax())
            row, far = rows[best], nearest[best]
            if far <= 0 or far < cut[0] or (far == cut[0] and row["_head"] > cut[1]):
                break
            chosen.append(row["_head"]["id"])
            fresh.append(Row(**{c: row[c] for c in names}))
            gap = np.abs(around - around[best])
            d = np.minimum(gap, 1.0 - gap)
            for c, weight in weights.items():
                d = d + np.where(codes[c] != codes[c][best], weight, 0.0)
            nearest = np.minimum(nearest, d)
    return chosen


def _distance(hue: str, weights: Mapping[str, float], pick: Row) -> Column:
    d = circular_distance(hue, pick[hue])
    for c, weight in weights.items():
        d = d + F.when(~F.col(c).eqNullSafe(F.lit(pick[c])), F.lit(weight)).otherwise(F.lit(0.0))
    return d


def contact_listing(df: DataFrame, axis: str, id_col: str = "id", per_row: int = 6, **blocks: int) -> DataFrame:
    """Members of each level of an axis in id order, with their sheet row and column."""
    placed = position(df.select(axis, id_col), [axis], [id_col], "at", **blocks)
    return placed.select(
        axis, id_col, F.col("at").alias("position"),
        F.floor(F.col("at") / per_row).cast("bigint").alias("sheet_row"),
        (F.col("at") % per_row).alias("sheet_col"),
    )
