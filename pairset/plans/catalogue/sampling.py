"""Sampling: shares, targets, stratified and diverse draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.functions.columns import bucket_by_edges
from pairset.operators import sample
from pairset.operators.quantiles import exact_quantiles
from pairset.plans.catalogue.common import Registry, r6, rounded, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

PART_AXES = ["p_brand", "p_type", "size_class"]
DRAW = 60


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", "p_brand", "p_type", (F.col("p_size") > 25).alias("size_class"), "p_size", "p_retailprice")


_LONG = """
p AS (SELECT p_partkey, p_brand, p_type, CAST(p_size > 25 AS VARCHAR) AS size_class FROM part),
l AS (SELECT 'p_brand' AS axis, p_brand AS level, p_partkey FROM p UNION ALL SELECT 'p_type', p_type, p_partkey FROM p
      UNION ALL SELECT 'size_class', size_class, p_partkey FROM p),
m AS (SELECT axis, level, count(*) AS n, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM part) AS share FROM l GROUP BY axis, level),
g AS (SELECT *, least(greatest(share, 2 / 60.0::DOUBLE), n / 60.0::DOUBLE) AS t FROM m),
goal AS (SELECT axis, level, share AS population_share, n AS supply, t / sum(t) OVER (PARTITION BY axis) AS target FROM g)
"""

_POOL = """
k AS (SELECT p_partkey, CAST('0x' || substr(md5('4242:' || p_partkey), 1, 8) AS BIGINT) AS k, p_type FROM part),
pool AS (SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY k, p_partkey) AS rn FROM k)
         WHERE rn <= 20 ORDER BY k, p_partkey LIMIT 60)
"""


@_r.query(f"WITH {_LONG} SELECT axis, level, n, round(share, 6) AS share FROM m")
def marginal_shares(spark, sf):
    return rounded(sample.marginal_shares(parts(spark, sf), PART_AXES), "share")


@_r.query(f"WITH {_LONG} SELECT axis, level, round(population_share, 6) AS population_share, supply, round(target, 6) AS target FROM goal")
def target_shares(spark, sf):
    return rounded(sample.target_shares(parts(spark, sf), PART_AXES, DRAW), "population_share", "target")


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return sample.candidate_pool(parts(spark, sf), "p_type", "p_partkey", 4242, pool=DRAW)


@_r.query(f"""
WITH {_LONG}, {_POOL},
s AS (SELECT axis, level, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM pool) AS share FROM l JOIN pool USING (p_partkey) GROUP BY axis, level)
SELECT round(sum(abs(coalesce(s.share, 0) - goal.target)), 6) AS deviation, count(*) AS n_levels FROM goal LEFT JOIN s USING (axis, level)
""")
def share_deviation(spark, sf):
    targets = sample.target_shares(parts(spark, sf), PART_AXES, DRAW)
    return rounded(sample.share_deviation(_pool(spark, sf), targets, PART_AXES), "deviation")


@_r.query(f"""
WITH {_LONG}, {_POOL},
s AS (SELECT axis, level, count(*) AS n_subset, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM pool) AS subset_share
      FROM l JOIN pool USING (p_partkey) GROUP BY axis, level)
SELECT axis, level, m.n AS n_population, round(m.share, 6) AS population_share, coalesce(n_subset, 0) AS n_subset,
       round(coalesce(subset_share, 0), 6) AS subset_share FROM m FULL JOIN s USING (axis, level)
""")
def subset_vs_population(spark, sf):
    out = sample.subset_vs_population(_pool(spark, sf), parts(spark, sf), PART_AXES)
    return rounded(out, "population_share", "subset_share")


@_r.query("""
WITH k AS (SELECT doc_id, source, lang, CAST('0x' || substr(md5('4242:' || doc_id), 1, 8) AS BIGINT) AS k FROM documents)
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS rn FROM k)
WHERE rn <= 30 ORDER BY k, doc_id LIMIT 100
""")
def top_k_per_group(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return sample.candidate_pool(docs, "lang", "doc_id", 4242, pool=100, per_group=30).drop("_k")


@_r.query("SELECT min(p_size) AS min_value, max(p_size) AS max_value, count(DISTINCT p_brand) AS n_distinct FROM part")
def spread_report(spark, sf):
    return sample.spread_report(parts(spark, sf), F.col("p_size"), F.col("p_brand"))


@_r.query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def argmax_row(spark, sf):
    return sample.argmax_row(parts(spark, sf).select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")


@_r.query("""
SELECT p_type, p_partkey, rn AS position, rn // 6 AS sheet_row, rn % 6 AS sheet_col FROM (
  SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS rn FROM part)
""")
def contact_listing(spark, sf):
    return sample.contact_listing(parts(spark, sf), "p_type", "p_partkey")


DOC_AXES = ["source", "lang", "quality", "length_q"]


def stratified_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    docs = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    edges = exact_quantiles(docs, "n_chars", [0.25, 0.5, 0.75])
    return docs.withColumn("length_q", bucket_by_edges("n_chars", edges))


# One step of the recursion picks one stratum; the state carries the rows drawn so far per stratum.
@_r.query("""
WITH RECURSIVE e AS (SELECT quantile_cont(n_chars, 0.25) a, quantile_cont(n_chars, 0.5) b, quantile_cont(n_chars, 0.75) c FROM documents),
d AS (SELECT d.doc_id, d.source, d.lang, coalesce(CAST(l.quality AS VARCHAR), 'null') AS quality,
             CASE WHEN n_chars <= a THEN 'q1' WHEN n_chars <= b THEN 'q2' WHEN n_chars <= c THEN 'q3' ELSE 'q4' END AS length_q,
             CAST('0x' || substr(md5('1337:' || d.doc_id), 1, 8) AS BIGINT) AS k
      FROM documents d CROSS JOIN e LEFT JOIN labels l USING (doc_id)),
lv AS (SELECT source AS level, 'source' AS axis, doc_id FROM d UNION ALL SELECT lang, 'lang', doc_id FROM d
       UNION ALL SELECT quality, 'quality', doc_id FROM d UNION ALL SELECT length_q, 'length_q', doc_id FROM d),
m AS (SELECT axis, level, count(*) AS n, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM d) AS p FROM lv GROUP BY axis, level),
t AS (SELECT axis, level, least(greatest(p, 2 / 40.0::DOUBLE), n / 40.0::DOUBLE) AS v FROM m),
goal AS MATERIALIZED (SELECT axis, level, v / sum(v) OVER (PARTITION BY axis) AS target FROM t),
c AS MATERIALIZED (
  SELECT d.*, row_number() OVER (PARTITION BY source, lang, quality, length_q ORDER BY k, doc_id) AS place,
         g1.target AS t1, g2.target AS t2, g3.target AS t3, g4.target AS t4
  FROM d JOIN goal g1 ON g1.axis = 'source' AND g1.level = source JOIN goal g2 ON g2.axis = 'lang' AND g2.level = lang
  JOIN goal g3 ON g3.axis = 'quality' AND g3.level = quality JOIN goal g4 ON g4.axis = 'length_q' AND g4.level = length_q),
r AS (
  SELECT 0 AS step, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS l1, CAST([] AS VARCHAR[]) AS l2,
         CAST([] AS VARCHAR[]) AS l3, CAST([] AS VARCHAR[]) AS l4
  UNION ALL
  SELECT step + 1, list_append(ids, b.id), list_append(l1, b.a1), list_append(l2, b.a2), list_append(l3, b.a3), list_append(l4, b.a4)
  FROM (
    SELECT step, any_value(ids) AS ids, any_value(l1) AS l1, any_value(l2) AS l2, any_value(l3) AS l3, any_value(l4) AS l4,
           arg_min({'id': doc_id, 'a1': source, 'a2': lang, 'a3': quality, 'a4': length_q}, {'s': round(s, 11), 'k': k, 'i': doc_id}) AS b
    FROM (
      SELECT r.*, c.doc_id, c.source, c.lang, c.quality, c.length_q, c.k,
        abs((n1 + 1) / (step + 1.0::DOUBLE) - t1) - abs(n1 / (step + 1.0::DOUBLE) - t1) + abs((n2 + 1) / (step + 1.0::DOUBLE) - t2) - abs(n2 / (step + 1.0::DOUBLE) - t2)
        + abs((n3 + 1) / (step + 1.0::DOUBLE) - t3) - abs(n3 / (step + 1.0::DOUBLE) - t3) + abs((n4 + 1) / (step + 1.0::DOUBLE) - t4) - abs(n4 / (step + 1.0::DOUBLE) - t4) AS s
      FROM r CROSS JOIN LATERAL (
        SELECT c.*, len(list_filter(r.l1, lambda x: x = c.source)) AS n1, len(list_filter(r.l2, lambda x: x = c.lang)) AS n2,
               len(list_filter(r.l3, lambda x: x = c.quality)) AS n3, len(list_filter(r.l4, lambda x: x = c.length_q)) AS n4
        FROM c WHERE NOT list_contains(r.ids, c.doc_id)) c
      WHERE r.step < 40)
    GROUP BY step)
)
SELECT unnest(ids) AS doc_id FROM r WHERE step = 40
""")
def stratified_subset(spark, sf):
    """Forty documents balanced over source, language, quality and length quartile at once."""
    docs = stratified_documents(spark, sf)
    return sample.stratified_subset(docs, DOC_AXES, 40, "doc_id").select("doc_id")


# One step of the recursion adds the farthest row; the state carries every row's distance so far.
@_r.query("""
WITH RECURSIVE c AS MATERIALIZED (
  SELECT p_partkey, p_size / 51.0::DOUBLE AS hue, p_brand, p_type, p_retailprice AS sat,
         CAST('0x' || substr(md5('4242:' || p_partkey), 1, 8) AS BIGINT) AS k FROM part),
r AS (
  SELECT 1 AS pick, CAST([] AS BIGINT[]) AS ids,
         (SELECT arg_min(c, {'s': -sat, 'k': k, 'i': p_partkey}) FROM c) AS last,
         CAST([] AS STRUCT(hue DOUBLE, brand VARCHAR, kind VARCHAR)[]) AS seen
  UNION ALL
  SELECT pick + 1, list_append(ids, last.p_partkey), nxt, seen2 FROM (
    SELECT r.pick, any_value(r.ids) AS ids, any_value(r.last) AS last, any_value(r.seen2) AS seen2,
           arg_max(c, {'d': d, 'k': -c.k, 'i': -c.p_partkey}) AS nxt
    FROM (SELECT *, list_append(seen, {'hue': last.hue, 'brand': last.p_brand, 'kind': last.p_type}) AS seen2 FROM r WHERE pick < 24) r
    CROSS JOIN LATERAL (SELECT c.*, list_min([least(abs(c.hue - x.hue), 1.0 - abs(c.hue - x.hue))
        + CASE WHEN c.p_brand <> x.brand THEN 0.35::DOUBLE ELSE 0 END
        + CASE WHEN c.p_type <> x.kind THEN 0.15::DOUBLE ELSE 0 END for x in r.seen2]) AS d FROM c) c
    GROUP BY r.pick)
)
SELECT CAST(unnest(list_append(ids, last.p_partkey)) AS BIGINT) AS p_partkey, CAST(generate_subscripts(list_append(ids, last.p_partkey), 1) AS INTEGER) AS pick
FROM r WHERE pick = 24
""")
def diverse_subset(spark, sf):
    """Twenty-four parts as far apart as possible in size, brand and type."""
    p = parts(spark, sf).withColumn("hue", F.col("p_size") / 51.0)
    weights = {"p_brand": sample.FAMILY_WEIGHT, "p_type": sample.SOURCE_WEIGHT}
    return sample.diverse_subset(p, 24, "p_partkey", "hue", "p_retailprice", weights).select("p_partkey", "pick")
