"""Resumable per-row work: compute what is missing, capture failures, append.

A cache or run log is only ever appended to, by Spark's own task commit, so a lost executor repeats its
rows without leaving half-written ones. Where a key has several attempts, readers keep the latest.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pairset.operators.cache import KeyedCache
from pairset.operators.joins import distinct_keys, join_null_safe, missing_ids
from pairset.schema import as_flag
from pairset.session import map_batches

RowFn = Callable[[dict], dict]
ATTEMPT = "_attempt"
# A task hands results on once it holds this many rows or bytes of them; a batch of small rows may become large images.
PIECE_ROWS, PIECE_BYTES = 1_000, 4 << 20
# The five artefacts of a sample and their file types.
ARTEFACT_KINDS = {"person": "jpg", "garment": "jpg", "person_pose": "png", "garment_pose": "png", "parse": "png"}


def plain(batch: pd.DataFrame) -> list[dict]:
    """The rows of a batch as records: NULL and NaN are None, and integers stay integers beside a NULL."""
    columns = {}
    for c in batch.columns:
        values = batch[c].tolist()
        if batch[c].dtype.kind == "f" and c in batch.attrs.get("whole", ()):
            values = [None if v != v else int(v) for v in values]
        elif batch[c].dtype.kind == "f":
            values = [None if v != v else v for v in values]
        else:
            values = [None if v is None or v is pd.NA or v is pd.NaT else v for v in values]
        columns[c] = values
    return [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)]


def map_rows(
    df: DataFrame, fn: RowFn | None, result: T.StructType, keep: Sequence[str], ok: str = "ok",
    error: str = "error", load: Callable[[], RowFn] | None = None,
) -> DataFrame:
    """Apply a Python function to each row and capture failures instead of stopping.

    ``load`` builds the function once per task, for functions that own a model. The result has the ``keep``
    columns, the function's columns (NULL on failure), ``ok`` and ``error`` as ``Type: message``. Results leave
    the task in pieces of bounded size.
    """
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, *result.fields, T.StructField(ok, T.BooleanType()),
                           T.StructField(error, T.StringType())])
    names = [f.name for f in result.fields]
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    columns = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load() if load is not None else fn
        for batch in batches:
            rows, held = [], 0
            for low in range(0, len(batch), PIECE_ROWS):
                piece = batch.iloc[low:low + PIECE_ROWS]
                piece.attrs["whole"] = whole
                for record in plain(piece):
                    out = {c: record[c] for c in keep}
                    try:
                        values = call(record)
                        out.update({n: values.get(n) for n in names})
                        out[ok], out[error] = True, None
                    except Exception as e:  # one bad row must not end the job
                        out.update({n: None for n in names})
                        out[ok], out[error] = False, f"{type(e).__name__}: {e}"
                    rows.append(out)
                    held += sum(len(v) for v in out.values() if isinstance(v, (bytes, bytearray, str)))
                    if len(rows) >= PIECE_ROWS or held >= PIECE_BYTES:
                        yield pd.DataFrame(rows, columns=columns, dtype=object)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return map_batches(df, run, schema)


BatchFn = Callable[[pd.DataFrame], "pd.DataFrame | dict[str, Sequence]"]


def map_row_batches(
    df: DataFrame, load: Callable[[], BatchFn], result: T.StructType, keep: Sequence[str], batch_rows: int = 1_000,
    ok: str = "ok", error: str = "error", seconds: str | None = None,
) -> DataFrame:
    """Apply a function to batches of up to ``batch_rows`` rows; it returns as many values per column as it got rows.

    ``load`` builds the function once per task. A batch that raises, or returns another number of values, is split in two until
    the bad rows are alone: they get ``ok`` false and ``Type: message``, and a batch of ``n`` rows with one bad row costs about
    ``2 * log2(n)`` calls more. ``seconds`` names a column for a row's share of the time of its call.
    """
    kept, names = [df.schema[c] for c in keep], [f.name for f in result.fields]
    timed = [T.StructField(seconds, T.DoubleType())] if seconds else []
    schema = T.StructType([*kept, *result.fields, *timed, T.StructField(ok, T.BooleanType()), T.StructField(error, T.StringType())])

    def outcome(rows: pd.DataFrame, values: dict, taken: float, failure: str | None) -> pd.DataFrame:
        out = {**{c: rows[c].to_numpy() for c in keep}, **values}
        if seconds:
            out[seconds] = taken / len(rows)
        return pd.DataFrame({**out, ok: failure is None, error: failure}, index=range(len(rows)), dtype=object)

    def called(call: BatchFn, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        start = time.perf_counter()
        try:
            got = call(rows)
            values = {n: pd.Series(list(got[n]), dtype=object) for n in names}
            wrong = {n: len(v) for n, v in values.items() if len(v) != len(rows)}
            if wrong:
                raise ValueError(f"{len(rows)} rows gave {wrong}")
        except Exception as e:  # one bad row must cost one row
            if len(rows) == 1:
                yield outcome(rows, {n: [None] for n in names}, time.perf_counter() - start, f"{type(e).__name__}: {e}")
                return
            for half in (rows.iloc[: len(rows) // 2], rows.iloc[len(rows) // 2:]):
                yield from called(call, half.reset_index(drop=True))
            return
        yield outcome(rows, {n: v.where(v.notna(), None) for n, v in values.items()}, time.perf_counter() - start, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load()
        for batch in batches:
            for low in range(0, len(batch), batch_rows):
                yield from called(call, batch.iloc[low:low + batch_rows].reset_index(drop=True))

    return map_batches(df, run, schema)


def usable(stats: DataFrame, ok: str, id_col: str = "id", attempt: str | None = None) -> DataFrame:
    """One row per id: a successful attempt where there is one, the latest of those."""
    latest = [F.col(attempt).desc_nulls_last()] if attempt else []
    best = W.partitionBy(id_col).orderBy(as_flag(ok).desc(), *latest)
    return stats.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def stats_cache(
    spark: SparkSession, path: str, key: T.StructField, result: T.StructType, ok: str = "probe_ok", error: str = "probe_error",
) -> KeyedCache:
    """The cache of attempts that ``refresh_stats`` keeps at ``path``."""
    schema = T.StructType([key, *result.fields, T.StructField(ok, T.BooleanType()), T.StructField(error, T.StringType()),
                           T.StructField(ATTEMPT, T.LongType())])
    return KeyedCache(spark, path, schema, key.name)


def probe_missing(
    index: DataFrame, cache: KeyedCache, result: T.StructType, fn: RowFn | None = None, retry_failed: bool = False,
    ok: str = "probe_ok", error: str = "probe_error", load: Callable[[], RowFn] | None = None, recompute: bool = False,
) -> None:
    """Probe the ids that the cache lacks and append them; only the buckets of the given ids are read."""
    todo = index
    if not recompute:
        cached = cache.rows(index)
        todo = missing_ids(index, cached.where(as_flag(ok)) if retry_failed else cached, [cache.id_col])
    cache.append(map_rows(todo, fn, result, [cache.id_col], ok, error, load).withColumn(ATTEMPT, F.lit(time.time_ns())))


def refresh_stats(
    index: DataFrame, cache_path: str, result: T.StructType, fn: RowFn | None = None, id_col: str = "id",
    retry_failed: bool = False, ok: str = "probe_ok", error: str = "probe_error",
    load: Callable[[], RowFn] | None = None, recompute: bool = False,
) -> DataFrame:
    """Probe only the ids the cache lacks, append them, and return the cache, one row per id.

    With ``retry_failed`` ids whose every attempt failed are probed again, with ``recompute`` all ids are.
    Attempts carry the time of their run, and of equally good ones the latest counts.
    """
    cache = stats_cache(index.sparkSession, cache_path, index.schema[id_col], result, ok, error)
    probe_missing(index, cache, result, fn, retry_failed, ok, error, load, recompute)
    return usable(cache.rows(), ok, id_col, ATTEMPT).drop(ATTEMPT)


def compact_stats(cache: KeyedCache, ok: str = "probe_ok") -> None:
    """Leave one attempt per id, the one that ``refresh_stats`` returns."""
    cache.compact(lambda rows: usable(rows, ok, cache.id_col, ATTEMPT))


def split_outcome(df: DataFrame, ok: str = "ok") -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rows to quarantine."""
    return df.where(as_flag(ok)), df.where(~as_flag(ok))


def worklist(samples: DataFrame, modes: Sequence[str], mode: str = "mode") -> DataFrame:
    """Every sample in every mode of a given list."""
    return samples.withColumn(mode, F.explode(F.array(*[F.lit(m) for m in modes])))


def pending(work: DataFrame, run_log: DataFrame, keys: Sequence[str] = ("mode", "id"), ok: str | None = None) -> DataFrame:
    """Work not yet in the run log; with ``ok``, failed attempts count as not done. A NULL key matches a NULL one."""
    return join_null_safe(work, distinct_keys(run_log if ok is None else run_log.where(as_flag(ok)), keys), keys, "left_anti")


def keep_latest(log: DataFrame, keys: Sequence[str], attempt: Sequence[str]) -> DataFrame:
    """The last attempt per key; the shuffle carries one row per key and task."""
    latest = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in attempt])
    return log.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn")


def carried_over(prior: DataFrame, new: DataFrame, keys: Sequence[str], attempt: Sequence[str]) -> DataFrame:
    """Earlier records and new ones as one log, the latest attempt per key."""
    return keep_latest(prior.unionByName(new, allowMissingColumns=True), keys, attempt)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """De-duplicate by key, keeping the first row in the given order."""
    first = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


# ----------------------------------------------------------------------------------- artefacts
def artefact_paths(df: DataFrame, root: str, height: int, width: int, id_col: str = "id") -> DataFrame:
    """The expected path of each artefact of each sample: ``(id, kind, path)``."""
    base = f"{root.rstrip('/')}/{height}x{width}"
    rows = [F.struct(F.lit(kind).alias("kind"),
                     F.concat(F.concat_ws("/", F.lit(base), F.lit(kind), F.col(id_col).cast("string")),
                              F.lit("." + ext)).alias("path"))
            for kind, ext in ARTEFACT_KINDS.items()]
    return df.select(id_col, F.inline(F.array(*rows)))


def complete_ids(listing: DataFrame, id_col: str = "id", min_bytes: int | None = None) -> DataFrame:
    """Ids that have all artefacts; with ``min_bytes`` smaller files count as absent."""
    if min_bytes is not None:
        listing = listing.where(F.col("bytes") >= min_bytes)
    bit = F.lit(0)
    for i, kind in enumerate(ARTEFACT_KINDS):
        bit = F.when(F.col("kind") == kind, F.lit(1 << i)).otherwise(bit)
    seen = listing.groupBy(id_col).agg(F.bit_or(bit).alias("_seen"))
    return seen.where(F.col("_seen") == (1 << len(ARTEFACT_KINDS)) - 1).select(id_col)


def todo(manifest: DataFrame, listing: DataFrame, id_col: str = "id", force: bool = False) -> DataFrame:
    """Samples whose artefacts are incomplete, or all of them with ``force``."""
    if force:
        return manifest
    return missing_ids(manifest, complete_ids(listing, id_col), [id_col])


def progress(manifest: DataFrame, attempts: DataFrame, id_col: str = "id", ok: str = "ok") -> DataFrame:
    """``(processed, failed, total)``; an id counts as processed once one of its attempts succeeded.

    The failures themselves stay a table, see ``split_outcome``.
    """
    outcome = attempts.groupBy(id_col).agg(F.bool_or(as_flag(ok)).alias("_ok"))
    joined = manifest.select(id_col).join(outcome, id_col, "left")
    return joined.agg(
        F.count_if(F.col("_ok")).alias("processed"),
        F.count_if(~F.col("_ok")).alias("failed"),
        F.count("*").alias("total"),
    )


def substitute_failed(
    df: DataFrame, order: Sequence[str], valid: str, id_col: str = "id", stride: int = 7919, attempts: int = 5,
    **blocks: int,
) -> DataFrame:
    """For each row the first valid row among positions ``i, i + stride, i + 2 * stride, ...`` mod n.

    Rows without a valid alternate keep a NULL ``used_id``; they belong to the error table.
    """
    from pairset.operators.sequence import position

    placed = position(df, [], order, "_i", **blocks)
    n = df.count()
    tries = F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))
    asked = placed.select(id_col, "_i", tries.alias("_try"))
    asked = asked.withColumn("_at", (F.col("_i") + F.col("_try") * stride) % F.lit(n))
    usable_rows = placed.where(as_flag(valid)).select(F.col("_i").alias("_at"), F.col(id_col).alias("_used"))
    hit = asked.join(usable_rows, "_at", "left")
    best = F.min(F.when(F.col("_used").isNotNull(), F.struct("_try", "_used")))
    return hit.groupBy(id_col).agg(best.alias("_b")).select(
        id_col, F.col("_b._used").alias("used_id"), (F.col("_b._try") + 1).alias("attempt"))
