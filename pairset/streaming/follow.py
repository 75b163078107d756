"""Following logs and index folders as they grow.

Each micro-batch writes to a folder named after its number and overwrites it, so a batch that is replayed
after a failure leaves the same files. State between batches is in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pairset.operators.incremental import RowFn, compact_stats, probe_missing, stats_cache
from pairset.operators.runlog import parse_steps, parse_validations
from pairset.schema import null_if_nan
from pairset.session import ship

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RUN_STATE = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("best", T.DoubleType())])


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow_log(
    spark: SparkSession, source: str, out: str, checkpoint: str, once: bool = True, max_files: int | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Parse new log lines into ``<out>/steps`` and ``<out>/validations``.

    A run is a source file; ``prepare`` may set another ``run`` column on the lines.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(source).select("value", F.col("_metadata.file_path").alias("run"))
    if prepare is not None:
        lines = prepare(lines)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        parse_steps(batch).write.mode("overwrite").parquet(f"{out}/steps/batch={number}")
        parse_validations(batch).write.mode("overwrite").parquet(f"{out}/validations/batch={number}")
        batch.unpersist()

    return _start(lines, each, checkpoint, once)


class _Metrics(StatefulProcessor):
    """Sliding mean and running best of one run: the state is its last values and its best one."""

    def __init__(self, keys: Sequence[str], order: str, value: str, window: int, lowest: bool, idle_ms: int | None) -> None:
        self.keys, self.order, self.value, self.window, self.lowest, self.idle_ms = keys, order, value, window, lowest, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", _RUN_STATE, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        # the order is made here: a micro-batch deals the rows of a run as it reads them
        new = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable", ignore_index=True)
        held, best = self.state.get() or ([], None)
        values = new["number"].to_numpy(dtype=float, na_value=np.nan)
        known = ~np.isnan(values)
        series = np.concatenate([np.array(held, dtype=float), values[known]])
        means = pd.Series(series).rolling(self.window, min_periods=1).mean().to_numpy()
        # a row without a value carries the mean before it
        means = np.concatenate([[means[len(held) - 1] if held else np.nan], means[len(held):]])
        so_far = np.cumsum(known)
        sign = 1.0 if self.lowest else -1.0
        bests = np.minimum.accumulate(np.concatenate([[np.inf if best is None else sign * best], np.where(known, sign * values, np.inf)]))
        measured = (so_far - known > 0) | (best is not None)
        is_best = known & (~measured | (sign * values < bests[:-1]))
        mean = means[so_far]
        out = pd.DataFrame({
            **{k: [v] * len(new) for k, v in zip(self.keys, key, strict=True)},
            self.order: new["at"], self.value: new["value"],
            "rolling_mean": pd.Series(mean, dtype=object).where(~np.isnan(mean), None),
            "best_before": pd.Series(sign * bests[:-1], dtype=object).where(measured, None), "is_best": is_best,
        })
        last = float(sign * bests[-1]) if best is not None or known.any() else None
        self.state.update((series[-self.window:].tolist(), last))
        yield out

    def close(self) -> None:
        pass


def follow_metrics(
    stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str], order: str, value: str,
    window: int = 100, mode: str = "min", once: bool = True, idle: timedelta | None = None,
) -> StreamingQuery:
    """Sliding mean and running best per run over a stream of values, rows in ``<out>/rows``.

    Spark's state store keeps the last ``window`` values and the best one of every run, under the query's checkpoint; with
    ``idle``, runs without new rows for so long are forgotten. Nothing else is kept between batches, and a restarted query
    goes on from the last committed batch. Rows of a run have to arrive in batches in ascending order; those of one run and
    batch must fit a task, so the source should bound its batches. NULL is a key like any other; a row without a value (NULL
    or NaN) carries the mean before it and is never best.
    """
    if mode not in ("min", "max"):
        raise ValueError(f"unknown mode {mode!r}; use min or max")
    spark = stream.sparkSession
    ship(spark)
    number = null_if_nan(F.col(value).cast("double"))
    # names of their own: rows reach the processor as named tuples, which allow no leading underscore
    named = [f"key{i}" for i in range(len(keys))]
    rows = stream.select(
        *[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(order).alias("at"),
        number.cast(stream.schema[value].dataType).alias("value"), number.alias("number"))
    schema = T.StructType([
        *[stream.schema[c] for c in (*keys, order, value)], T.StructField("rolling_mean", T.DoubleType()),
        T.StructField("best_before", T.DoubleType()), T.StructField("is_best", T.BooleanType()),
    ])
    processor = _Metrics(list(keys), order, value, window, mode == "min", int(idle.total_seconds() * 1000) if idle else None)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    # With times to live, Spark asks for empty batches for ever, which a run of what is available would wait for.
    settings = {_STORE: _ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        # a started query has its own copy of the settings
        for k, v in settings.items():
            spark.conf.set(k, v)
        marked = rows.groupBy(*named).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if idle else "None")
        return _start(marked, each, checkpoint, once)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def follow_index(
    spark: SparkSession, source: str, schema: T.StructType, cache: str, checkpoint: str, result: T.StructType,
    fn: RowFn, once: bool = True, max_files: int | None = None, id_col: str = "id", compact_every: int = 50,
) -> StreamingQuery:
    """Probe the rows of newly arrived index files; known ids are skipped, so replays add nothing.

    A batch reads the cache buckets of its own ids only, and every ``compact_every`` batches the cache is compacted.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        known = stats_cache(batch.sparkSession, cache, schema[id_col], result)
        probe_missing(batch, known, result, fn)
        if number % compact_every == compact_every - 1:
            compact_stats(known)
        batch.unpersist()

    return _start(reader.parquet(source), each, checkpoint, once)
