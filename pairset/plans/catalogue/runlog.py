"""Run logs: series operators, parsing, summaries and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.operators import runlog, sequence
from pairset.plans.catalogue.common import Registry, rounded, table
from pairset.session import checkpoint_root, spread
from pairset.sources.tables import read_log

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def series(spark: SparkSession, sf: str) -> DataFrame:
    """One run per user, events in number order."""
    return table(spark, sf, "events").select("user_id", "event_id", "value")


@_r.query("""
SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling_mean FROM events
""")
def rolling_mean_100(spark, sf):
    out = sequence.rolling_mean(series(spark, sf), ["user_id"], ["event_id"], "value", 100)
    # Means of at most 100 two-digit values are never halfway between two nine-digit numbers.
    return out.drop("value").withColumn("rolling_mean", F.round("rolling_mean", 9))


@_r.query("""
WITH d AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS dt FROM events),
m AS (SELECT *, avg(dt) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS mean FROM d)
SELECT user_id, event_id, dt AS step_time, round(mean, 3) AS mean_step_time, round(greatest(0, 2000000 - event_id) * coalesce(mean, 0), 0) AS eta FROM m
""")
def step_time_eta(spark, sf):
    """Step times in whole microseconds, so their means do not depend on summation order."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    out = sequence.step_time(events, ["user_id"], ["event_id"], at, 2_000_000, "event_id").drop("ts")
    return out.withColumns({"mean_step_time": F.round("mean_step_time", 3), "eta": F.round("eta", 0)})


_BEST = """
SELECT user_id, event_id, b AS best_before, b IS NULL OR value < b AS is_best FROM (
  SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
"""


@_r.query(_BEST)
def running_best(spark, sf):
    return sequence.running_best(series(spark, sf), ["user_id"], ["event_id"], "value").drop("value")


@_r.query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
WHERE rn <= 3 OR event_type = 'error'
""")
def keep_last_n(spark, sf):
    saved = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return runlog.keep_last(saved, ["user_id"], "event_id", "event_type", 3, ["error"])


@_r.query("""
WITH i AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE event_type <> 'error')
SELECT user_id, i // 4 + 1 AS step, round(avg(value), 6) AS loss FROM i GROUP BY user_id, i // 4 HAVING count(*) = 4
""")
def microbatch_mean(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return rounded(runlog.micro_batch_means(events, ["user_id"], ["event_id"], "value", 4), "loss")


@_r.query("""
SELECT user_id, round(avg(value), 6) AS val_loss, count(*) AS val_batches FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 24 GROUP BY user_id
""")
def validation_mean(spark, sf):
    return rounded(runlog.validation_mean(series(spark, sf), ["user_id"], ["event_id"], "value", 24), "val_loss")


@_r.query("""
SELECT e.user_id, e.event_id, e.value, v.value AS val_loss FROM events e
LEFT JOIN (SELECT user_id, event_id, value FROM events WHERE event_type = 'signup') v ON v.user_id = e.user_id AND v.event_id = e.event_id
WHERE e.event_id % 5 = 0
""")
def every_kth_step(spark, sf):
    """Every fifth step, with the validation measured at it, where there is one."""
    events = table(spark, sf, "events").select("user_id", "event_id", "value", "event_type")
    found = events.where("event_type = 'signup'").select("user_id", "event_id", F.col("value").alias("val_loss"))
    steps = runlog.every_kth(events.drop("event_type"), 5, "event_id")
    return runlog.with_validations(steps, found, ["user_id", "event_id"])


@_r.query("""
SELECT user_id, count(*) FILTER (event_type = 'error') AS oom_events, count(*) FILTER (event_type = 'view') AS skipped_batches,
       max(epoch_us(ts)) - min(epoch_us(ts)) AS elapsed, max(value) AS peak FROM events GROUP BY user_id
""")
def run_counters(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return runlog.run_counters(table(spark, sf, "events"), "event_type", at, "value",
                               {"error": "oom_events", "view": "skipped_batches"}, ["user_id"])


@_r.query("""
WITH t AS (SELECT CAST(sum(l_partkey) AS BIGINT) AS total, CAST(sum(l_partkey) FILTER (l_returnflag = 'R') AS BIGINT) AS trainable FROM lineitem)
SELECT total, trainable, total - trainable AS frozen, round(trainable * 100.0::DOUBLE / total, 6) AS trainable_pct,
       round((total - trainable) * 2 / 1e9::DOUBLE, 6) AS frozen_weights_gb, round(trainable * 4 / 1e9::DOUBLE, 6) AS trainable_params_gb,
       round(trainable * 4 / 1e9::DOUBLE, 6) AS gradients_gb, round(trainable * 2 / 1e9::DOUBLE, 6) AS optimizer_state_gb,
       round(((total - trainable) * 2 + trainable * 10) / 1e9::DOUBLE, 6) AS static_total_gb FROM t
""")
def parameter_totals(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_returnflag") == "R").alias("trainable"))
    out = runlog.parameter_totals(items, "l_partkey")
    return rounded(out, *[c for c in out.columns if c.endswith(("_pct", "_gb"))])


# ------------------------------------------------------------------------------- text log lines
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log text of the events: step lines, some coloured, some without the optional parts, some with a
    loss that is not a number, and validation lines."""
    kind, v, step = F.col("event_type"), F.col("value"), F.col("event_id").cast("int")
    loss = F.when(kind == "error", F.lit("nan")).otherwise(F.format_string("%.4f", v / 100))
    head = F.format_string(
        "2026-01-01 10:00:00 - INFO - epoch %d | step %d/450 | loss %s (avg %.4f) | lr %.2e | %.2fs/it | eta 1h40m",
        (step % 7), step, loss, v / 50, (F.lit(1.0) + step % 9) / 10000.0, v)
    extra = F.format_string(" | vram %.2f/%.2fGB | gpu %d%% %dC | ram 4.1GB | gnorm %.3f",
                            v, v * 2, step % 100, step % 60 + 30, v / 10)
    valid = F.format_string("2026-01-01 10:05:00 - INFO - [validation] epoch %d step %d | val_loss %.4f  val_batches 24.0000",
                            (step % 7), step, v / 100)
    line = (
        F.when(kind == "signup", valid)
        .when(kind == "view", head)
        .when(kind == "click", F.concat(F.lit("\u001b[32m"), head, extra, F.lit("\u001b[0m")))
        .otherwise(F.concat(head, extra))
    )
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), line.alias("value"))


# The SQL renders and reads the same text.
_LINES = r"""
WITH p AS (SELECT user_id AS run, event_type AS kind, CAST(event_id AS INTEGER) AS step, value AS v FROM events),
h AS (SELECT *, printf('epoch %d | step %d/450 | loss %s (avg %.4f) | lr %.2e | %.2fs/it | eta 1h40m', step % 7, step,
        CASE WHEN kind = 'error' THEN 'nan' ELSE printf('%.4f', v / 100) END, v / 50, (1.0::DOUBLE + step % 9) / 10000, v) AS head,
      CASE WHEN kind = 'view' THEN '' ELSE printf(' | vram %.2f/%.2fGB | gpu %d%% %dC | ram 4.1GB | gnorm %.3f', v, v * 2, step % 100, step % 60 + 30, v / 10) END AS extra,
      printf('[validation] epoch %d step %d | val_loss %.4f  val_batches 24.0000', step % 7, step, v / 100) AS valid FROM p),
lines AS (SELECT run, kind, CASE WHEN kind = 'signup' THEN valid ELSE head || extra END AS line FROM h),
steps AS (SELECT run, CAST(regexp_extract(line, 'epoch (\d+)', 1) AS INTEGER) AS epoch, CAST(regexp_extract(line, 'step (\d+)/', 1) AS INTEGER) AS step,
      CASE WHEN kind <> 'error' THEN CAST(regexp_extract(line, 'loss (\S+)', 1) AS DOUBLE) END AS loss,
      CAST(regexp_extract(line, 'avg ([^)]+)', 1) AS DOUBLE) AS avg, CAST(regexp_extract(line, 'lr (\S+)', 1) AS DOUBLE) AS lr,
      CAST(regexp_extract(line, '(\S+)s/it', 1) AS DOUBLE) AS sit,
      TRY_CAST(regexp_extract(line, 'vram ([\d.]+)/', 1) AS DOUBLE) AS vram_alloc, TRY_CAST(regexp_extract(line, 'vram [\d.]+/([\d.]+)GB', 1) AS DOUBLE) AS vram_peak,
      TRY_CAST(regexp_extract(line, 'gpu (\d+)%', 1) AS DOUBLE) AS gpu_util, TRY_CAST(regexp_extract(line, '(\d+)C', 1) AS DOUBLE) AS gpu_temp,
      TRY_CAST(regexp_extract(line, 'gnorm (\S+)', 1) AS DOUBLE) AS gnorm FROM lines WHERE kind <> 'signup')
"""


_FOLDERS: dict[tuple[str, str], str] = {}


def log_folder(spark: SparkSession, sf: str) -> str:
    """The events rendered as text log files, once per application, in the shared checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FOLDERS:
        path = f"{checkpoint_root(spark)}/logs-{uuid.uuid4().hex}"
        text = log_lines(spark, sf).select(F.concat(F.format_string("run=%d ", "run"), F.col("value")))
        spread(text).write.text(path)
        _FOLDERS[key] = path
    return _FOLDERS[key]


def with_run(lines: DataFrame) -> DataFrame:
    return lines.select(F.regexp_extract("value", r"run=(\d+) ", 1).cast("bigint").alias("run"), "value")


def read_lines(spark: SparkSession, sf: str) -> DataFrame:
    return with_run(read_log(spark, log_folder(spark, sf)))


@_r.query(_LINES + "SELECT * FROM steps")
def log_parse(spark, sf):
    return runlog.parse_steps(read_lines(spark, sf))


@_r.query(_LINES + r"""
SELECT run, CAST(regexp_extract(line, 'epoch (\d+)', 1) AS INTEGER) AS epoch, CAST(regexp_extract(line, 'step (\d+)', 1) AS INTEGER) AS step,
       CAST(regexp_extract(line, 'val_loss (\S+)', 1) AS DOUBLE) AS val_loss FROM lines WHERE kind = 'signup'
""")
def log_validations(spark, sf):
    return runlog.parse_validations(read_lines(spark, sf))


@_r.query(_LINES + """
SELECT run, count(*) AS n_steps, arg_min(avg, step) AS first_avg, arg_max(avg, step) AS last_avg, max(vram_peak) AS peak_vram,
       min(gpu_temp) AS min_temp, max(gpu_temp) AS max_temp, round(100 * (1 - arg_max(avg, step) / nullif(arg_min(avg, step), 0)), 6) AS reduction_pct
FROM steps GROUP BY run
""")
def log_summary(spark, sf):
    return rounded(runlog.summarise(runlog.parse_steps(read_lines(spark, sf)), ["run"]), "reduction_pct")


@_r.query(_LINES + "SELECT * FROM steps")
def log_follow(spark, sf):
    """The same lines read as a text stream, parsed per micro-batch."""
    from pairset.streaming.follow import follow_log

    root = f"{checkpoint_root(spark)}/follow-{uuid.uuid4().hex}"
    follow_log(spark, log_folder(spark, sf), f"{root}/out", f"{root}/checkpoint", max_files=4, prepare=with_run).awaitTermination()
    return spark.read.parquet(f"{root}/out/steps").drop("batch")


@_r.query("""
SELECT user_id, event_id, b AS best_before, b IS NULL OR value < b AS is_best, round(m, 9) AS rolling_mean FROM (
  SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
         avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m FROM events)
""")
def metrics_follow(spark, sf):
    """Sliding mean and running best over a stream that arrives in three batches."""
    from pairset.streaming.follow import follow_metrics

    root = f"{checkpoint_root(spark)}/metrics-{uuid.uuid4().hex}"
    events = series(spark, sf)
    last = events.agg(F.max("event_id")).first()[0]
    for i in range(3):
        from_, to = i * (last + 1) // 3, (i + 1) * (last + 1) // 3
        part = events.where((F.col("event_id") >= from_) & (F.col("event_id") < to))
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        follow_metrics(stream, f"{root}/out", f"{root}/checkpoint", ["user_id"], "event_id", "value").awaitTermination()
    rows = spark.read.parquet(f"{root}/out/rows").drop("batch", "value")
    return rows.withColumn("rolling_mean", F.round("rolling_mean", 9))
