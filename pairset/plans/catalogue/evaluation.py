"""Evaluation: run tables, summaries, paired comparison, pair scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.operators import evaluate, joins
from pairset.operators.raster import psnr_of_arrays
from pairset.plans.catalogue.common import Registry, r6, rounded, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


@_r.query("""
SELECT d.lang, count(*) AS n, count(*) FILTER (quality = 1) AS hits,
       round(100.0::DOUBLE * avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS pct,
       round(avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS mean
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang
""")
def rate_by_group(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(evaluate.rate_by_group(docs, ["lang"], F.col("quality") == 1), "pct", "mean")


@_r.query("""
SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std FROM events GROUP BY event_type
""")
def metric_mean_std(spark, sf):
    out = evaluate.mean_std(table(spark, sf, "events"), ["event_type"], ["value"])
    return rounded(out, "value_mean", "value_std")


@_r.query("""
SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' WHEN grouping(l_linenumber) = 0 THEN 'l_linenumber' ELSE 'ship_year' END AS axis,
       CASE WHEN grouping(l_linestatus) = 0 THEN l_linestatus WHEN grouping(l_linenumber) = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE CAST(ship_year AS VARCHAR) END AS level,
       count(*) AS n, round(avg(l_quantity), 6) AS l_quantity_mean, round(avg(l_discount), 6) AS l_discount_mean
FROM (SELECT *, year(l_shipdate) AS ship_year FROM lineitem)
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, l_linenumber), (l_returnflag, ship_year))
""")
def metric_by_axes(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    out = evaluate.means_by_axes(items, "l_returnflag", ["l_linestatus", "l_linenumber", "ship_year"],
                                 ["l_quantity", "l_discount"])
    return rounded(out, "l_quantity_mean", "l_discount_mean")


@_r.query("""
SELECT count(*) AS n, count(*) FILTER (ok) AS n_ok, round(avg(value) FILTER (ok), 6) AS mean_seconds,
       round(sum(value) FILTER (ok), 6) AS total_seconds, max(value) FILTER (ok) AS max_seconds,
       max(event_id) FILTER (ok) AS peak, round(median(value) FILTER (ok), 6) AS median_seconds
FROM (SELECT *, event_type <> 'error' AS ok FROM events)
""")
def run_totals(spark, sf):
    events = table(spark, sf, "events").withColumn("ok", F.col("event_type") != "error")
    out = evaluate.run_totals(events, "value", "event_id")
    return rounded(out, "mean_seconds", "total_seconds", "median_seconds")


@_r.query("""
SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, round(avg(value) FILTER (event_type <> 'error'), 6) AS value_mean FROM events
""")
def run_summary(spark, sf):
    events = table(spark, sf, "events").withColumn("ok", F.col("event_type") != "error")
    return rounded(evaluate.run_summary(events, ["value"]), "value_mean")


def run_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the same users: events with an even and with an odd number."""
    scored = table(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 2).alias("run")).agg(
        F.max("value").alias("psnr"), F.min("value").alias("lpips"))
    return tuple(scored.where(F.col("run") == i).drop("run") for i in (0, 1))


_PAIRS = """
WITH s AS (SELECT user_id, event_id % 2 AS run, max(value) AS psnr, min(value) AS lpips FROM events GROUP BY ALL),
j AS (SELECT a.psnr AS pa, b.psnr AS pb, a.lpips AS la, b.lpips AS lb FROM s a JOIN s b USING (user_id) WHERE a.run = 0 AND b.run = 1)
"""


@_r.query(_PAIRS + """
SELECT 'psnr' AS metric, round(avg(pa), 6) AS a_mean, round(avg(pb), 6) AS b_mean, round(avg(pb - pa), 6) AS delta, avg(pb - pa) > 0 AS improved,
       count(*) FILTER (pb > pa) AS n_better, count(*) AS n, count(pb - pa) AS n_scored FROM j
UNION ALL
SELECT 'lpips', round(avg(la), 6), round(avg(lb), 6), round(avg(lb - la), 6), avg(lb - la) < 0, count(*) FILTER (lb < la), count(*), count(lb - la) FROM j
""")
def paired_diff(spark, sf):
    a, b = run_tables(spark, sf)
    specs = [evaluate.metric("psnr"), evaluate.metric("lpips")]
    out = evaluate.paired_diff(joins.paired(a, b, "user_id", ["psnr", "lpips"]), specs)
    return rounded(out.drop("strict", "caveat"), "a_mean", "b_mean", "delta")


@_r.query(_PAIRS + """
SELECT 'psnr' AS metric, avg(pb - pa) > 0 AS improved, count(*) FILTER (pb > pa) AS n_better, count(*) AS n FROM j
UNION ALL SELECT 'lpips', NOT (avg(lb - la) > 0), count(*) FILTER (NOT coalesce(lb > la, FALSE)), count(*) FROM j
""")
def paired_diff_ties(spark, sf):
    """The comparison in which a tie counts as better where lower is better."""
    a, b = run_tables(spark, sf)
    specs = [evaluate.metric("psnr"), evaluate.metric("lpips")]
    out = evaluate.paired_diff(joins.paired(a, b, "user_id", ["psnr", "lpips"]), specs, strict=False)
    return out.select("metric", "improved", "n_better", "n")


@_r.query("""
SELECT user_id, max(value) FILTER (event_type = 'click') AS click_value, max(value) FILTER (event_type = 'purchase') AS purchase_value
FROM events GROUP BY user_id
""")
def pivot_modes(spark, sf):
    return joins.pivot_modes(table(spark, sf, "events"), "user_id", "event_type", ["click", "purchase"], ["value"])


@_r.query("""
SELECT d.doc_id, d.lang, a.quality AS quality_a, b.toxic AS toxic_b FROM documents d
LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN (SELECT * FROM labels WHERE quality = 1) b ON b.doc_id = d.doc_id
""")
def runs_with_metadata(spark, sf):
    """Metadata with the columns of two runs, either of which may lack the id."""
    labels = table(spark, sf, "labels")
    runs = {"a": labels.select("doc_id", "quality"), "b": labels.where("quality = 1").select("doc_id", "toxic")}
    return joins.with_run_columns(table(spark, sf, "documents").select("doc_id", "lang"), runs, "doc_id", ["quality", "toxic"])


@_r.query("""
SELECT o.o_orderkey, o.o_custkey, l.place FROM orders o JOIN (
  SELECT l_orderkey AS o_orderkey, CAST(min(place) AS INTEGER) AS place FROM (
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) - 1 AS place FROM lineitem)
  WHERE place < 5 GROUP BY l_orderkey) l USING (o_orderkey)
""")
def ordered_lookup(spark, sf):
    """Orders named in the suppliers' top-five lists, with their best place in any list."""
    from pairset.operators.sequence import top_k

    best = top_k(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice"), ["l_suppkey"],
                 [F.col("l_extendedprice").desc(), F.col("l_orderkey")], 5)
    # Each list holds at most five entries.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey")))
    lists = best.groupBy("l_suppkey").agg(F.transform(ranked, lambda x: x["l_orderkey"]).alias("ids"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.in_listed_order(orders, lists, "o_orderkey", "ids")


@_r.query("""
WITH p AS (SELECT a.vec_id, [greatest(0, least(255, floor((x::DOUBLE + 1) * 127.5))) for x in a.embedding] AS x,
                  [greatest(0, least(255, floor((y::DOUBLE + 1) * 127.5))) for y in b.embedding] AS y
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, list_sum([(x[i] - y[i]) * (x[i] - y[i]) for i in range(1, 65)]) / 64 AS mse FROM p)
SELECT vec_id, round(10 * log10(65025.0::DOUBLE / nullif(mse, 0)), 6) AS psnr FROM m
""")
def psnr_pairs(spark, sf):
    """PSNR of neighbouring vectors as byte rasters, by array functions."""
    from pairset.functions.columns import to_bytes

    v = table(spark, sf, "embeddings").select(
        "vec_id", to_bytes(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(other, "vec_id").select("vec_id", r6(psnr_of_arrays(F.col("v"), F.col("w"))).alias("psnr"))


@_r.query("""
SELECT doc_id, n_words, ok FROM (
  SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS n_words, TRUE AS ok FROM documents)
""")
def scored_by_model(spark, sf):
    """A caller's scorer over batches of whole texts, loaded once per task; only its value and outcome are kept."""
    from pairset.schema import struct_of

    def load():
        import re

        words = re.compile(r"[^ \t\n\r\f\v]+")
        return lambda rows: {"n_words": [len(words.findall(text)) for text in rows["text"]]}

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return evaluate.score_batches(docs, load, struct_of("n_words bigint"), ["doc_id"]).select("doc_id", "n_words", "ok")
