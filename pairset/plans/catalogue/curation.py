"""Curation: statistics, cascade, split, incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.functions import columns as C
from pairset.functions.keys import chosen_with_probability
from pairset.operators import incremental, joins, split
from pairset.operators.cascade import Stage, ledger, survivors
from pairset.operators.quantiles import exact_median, exact_quantiles
from pairset.operators.runlog import violations
from pairset.operators.sample import candidate_pool, first_in_hash_order, first_in_id_order, listed, without_listed
from pairset.plans.catalogue.common import Registry, r6, rounded, table
from pairset.schema import as_flag
from pairset.session import spread

#: Modes of a worklist are settings, not data.
MAX_MODES = 100

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return joins.index_with_stats(docs, table(spark, sf, "labels"), "doc_id", ok=None)


def document_stages() -> list[Stage]:
    return [
        Stage("drop toxic", ~as_flag("toxic")),
        Stage("require quality", as_flag("quality")),
        Stage("n_chars > 500", F.col("n_chars") > 500),
        Stage("has source", F.col("source").isNotNull()),
        Stage("n_chars < 12000", F.col("n_chars") < 12000),
    ]


@_r.query("""
WITH j AS (SELECT d.doc_id, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
f AS (SELECT CASE WHEN coalesce(toxic, 0) <> 0 THEN 1 WHEN coalesce(quality, 0) = 0 THEN 2
                  WHEN n_chars IS NULL OR n_chars <= 500 THEN 3 WHEN source IS NULL THEN 4
                  WHEN n_chars IS NULL OR n_chars >= 12000 THEN 5 END AS failed FROM j),
s(ordinal, stage) AS (VALUES (1, 'drop toxic'), (2, 'require quality'), (3, 'n_chars > 500'),
                             (4, 'has source'), (5, 'n_chars < 12000')),
c AS (SELECT s.ordinal, s.stage, (SELECT count(*) FROM f WHERE f.failed = s.ordinal) AS removed FROM s)
SELECT ordinal, stage, removed,
       CAST((SELECT count(*) FROM f) - sum(removed) OVER (ORDER BY ordinal) AS BIGINT) AS remaining FROM c
""")
def cascade_ledger(spark, sf):
    return ledger(labelled_documents(spark, sf), document_stages())


@_r.query("""
SELECT d.doc_id, d.source, d.lang, d.n_chars FROM documents d JOIN labels l USING (doc_id)
WHERE toxic = 0 AND quality = 1 AND n_chars > 500 AND source IS NOT NULL AND n_chars < 12000
""")
def cascade_survivors(spark, sf):
    kept = survivors(labelled_documents(spark, sf), document_stages())
    return kept.select("doc_id", "source", "lang", "n_chars")


@_r.query("""
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def missing_stats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return joins.missing_ids(docs, table(spark, sf, "labels"), ["doc_id"])


@_r.query("""
SELECT doc_id, quality, toxic, CAST(NULL AS BIGINT) AS n_lines FROM labels
UNION ALL
SELECT doc_id, NULL, NULL, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def stats_union(spark, sf):
    """Cached statistics and newly computed ones as one table."""
    docs, cached = table(spark, sf, "documents"), table(spark, sf, "labels")
    new = joins.missing_ids(docs.select("doc_id", "text"), cached, ["doc_id"]).select(
        "doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"))
    return cached.unionByName(new, allowMissingColumns=True)


@_r.query("""
SELECT doc_id, CASE WHEN length(text) >= 100 THEN CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) END AS n_lines,
       length(text) >= 100 AS probe_ok FROM documents
""")
def refreshed_stats(spark, sf):
    """Incremental statistics in two runs: the second probes only what the first did not."""
    import uuid

    from pairset.schema import struct_of
    from pairset.session import checkpoint_root

    def probe(row):
        if len(row["text"]) < 100:
            raise ValueError("too short")
        return {"n_lines": row["text"].count("\n") + 1}

    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = f"{checkpoint_root(spark)}/stats-{uuid.uuid4().hex}"
    first = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    incremental.refresh_stats(first, cache, struct_of("n_lines bigint"), probe, id_col="doc_id")
    stats = incremental.refresh_stats(docs, cache, struct_of("n_lines bigint"), probe, id_col="doc_id")
    return stats.select("doc_id", "n_lines", "probe_ok")


@_r.query("""
SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0)
""")
def complete_only(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return joins.complete_rows(docs, table(spark, sf, "labels").where("toxic = 0"), "doc_id")


@_r.query("""
SELECT count(*) AS n_total, count(l.doc_id) AS n_present, count(*) - count(l.doc_id) AS n_missing
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def completeness_counts(spark, sf):
    return joins.completeness(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


_SPLIT_SQL = """
WITH k AS (SELECT doc_id, lang, CAST('0x' || substr(md5('1337:' || doc_id), 1, 8) AS BIGINT) AS k FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY k, doc_id) AS rn, count(*) OVER () AS n FROM k WHERE lang <> 'de'),
s AS (SELECT k.doc_id, CASE WHEN r.rn IS NULL THEN 'test'
                            WHEN r.rn <= greatest(1, CAST(floor(r.n * 0.05) AS BIGINT)) THEN 'val' ELSE 'train' END AS part
      FROM k LEFT JOIN r USING (doc_id))
"""


@_r.query(_SPLIT_SQL + "SELECT doc_id, part FROM s")
def split_train_val(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return split.split_train_val(docs, "doc_id", 0.05, 1337, pool=F.col("lang") != "de").select("doc_id", "part")


@_r.query(_SPLIT_SQL + "SELECT part, count(*) AS n FROM s GROUP BY part")
def split_sizes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return split.split_sizes(split.split_train_val(docs, "doc_id", 0.05, 1337, pool=F.col("lang") != "de"))


@_r.query("""
WITH k AS (SELECT doc_id, source, CAST('0x' || substr(md5('4242:' || doc_id), 1, 8) AS BIGINT) AS k FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS rn FROM k),
p AS (SELECT doc_id FROM g WHERE rn <= 20 ORDER BY k, doc_id LIMIT 100)
SELECT count(*) AS n, substr(sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR))), 1, 16) AS manifest
FROM p
""")
def manifest_hash(spark, sf):
    """Manifest of a drawn pool of 100 documents."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return split.manifest_hash(candidate_pool(docs, "source", "doc_id", 4242, pool=100), "doc_id")


@_r.query("""
SELECT count(*) AS n, bit_xor(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)) AS ids_xor FROM documents
""")
def manifest_fingerprint(spark, sf):
    return split.fingerprint(table(spark, sf, "documents"), "doc_id")


PART_RULES = (("fastener", ("bolt", " ring ", "anvil")), ("moving", ("gear", "widget")), ("small", ("small",)))


@_r.query("""
SELECT p_partkey, CASE WHEN regexp_matches(t, 'bolt| ring |anvil') THEN 'fastener'
                       WHEN regexp_matches(t, 'gear|widget') THEN 'moving'
                       WHEN regexp_matches(t, 'small') THEN 'small' ELSE 'other' END AS family
FROM (SELECT p_partkey, ' ' || lower(p_name) || ' ' AS t FROM part)
""")
def keyword_family(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.keyword_family("p_name", PART_RULES).alias("family"))


@_r.query("""
WITH t AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents)
SELECT doc_id, CASE
  WHEN regexp_matches(t, 'georgette|chiffon|organza| net |tissue|crepe|satin') THEN 'sheer_flowy'
  WHEN regexp_matches(t, 'banarasi|kanjivaram|kanchipuram|paithani|patola|tussar|silk') THEN 'traditional_silk'
  WHEN regexp_matches(t, 'cotton|linen|khadi|chanderi|jamdani|handloom|ikat|kalamkari|maheshwari|muslin|bhagalpuri') THEN 'cotton_handloom'
  WHEN regexp_matches(t, 'print|floral|bandhani|lehriya|dyed|block') THEN 'printed'
  WHEN regexp_matches(t, 'embroider|sequin|zardosi|gota|velvet|zari|mirror') THEN 'embellished'
  ELSE 'other' END AS family FROM t
""")
def fabric_family(spark, sf):
    """The standard keyword families over whole document texts."""
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return texts.select("doc_id", C.keyword_family("text").alias("family"))


@_r.query("""
WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.5) b, quantile_cont(p_retailprice, 0.75) c FROM part)
SELECT p_partkey, CASE WHEN p_retailprice <= a THEN 'q1' WHEN p_retailprice <= b THEN 'q2'
                       WHEN p_retailprice <= c THEN 'q3' ELSE 'q4' END AS bucket FROM part, e
""")
def quantile_bucket(spark, sf):
    part = table(spark, sf, "part")
    edges = exact_quantiles(part, "p_retailprice", [0.25, 0.5, 0.75])
    return part.select("p_partkey", C.bucket_by_edges("p_retailprice", edges).alias("bucket"))


@_r.query("""
SELECT p_partkey, least(p_size * 40, 1200) AS min_side,
       CASE WHEN least(p_size * 40, 1200) < 512 THEN '<512' WHEN least(p_size * 40, 1200) < 1024 THEN '512-1024'
            ELSE '>=1024' END AS bucket FROM part
""")
def size_bucket(spark, sf):
    side = C.minimum_side(F.col("p_size") * 40, F.lit(1200))
    return table(spark, sf, "part").select("p_partkey", side.alias("min_side"), C.size_bucket(side).alias("bucket"))


@_r.query("""
SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= (SELECT median(p_retailprice) FROM part)
""")
def threshold_median(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return part.where(F.col("p_retailprice") >= exact_median(part, "p_retailprice"))


@_r.query("""
SELECT doc_id, lang FROM documents ORDER BY CAST('0x' || substr(md5('1337:' || doc_id), 1, 8) AS BIGINT), doc_id LIMIT 50
""")
def first_by_hash(spark, sf):
    return first_in_hash_order(table(spark, sf, "documents").select("doc_id", "lang"), 50, "doc_id")


@_r.query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def first_by_id(spark, sf):
    return first_in_id_order(table(spark, sf, "documents").select("doc_id", "lang"), 50, "doc_id")


@_r.query("""
SELECT p_partkey, p_brand, p_size FROM part WHERE p_type = 'ECONOMY' AND least(p_size * 40, 1200) >= 768 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
""")
def range_filters(spark, sf):
    side = C.minimum_side(F.col("p_size") * 40, F.lit(1200))
    kept = table(spark, sf, "part").where((F.col("p_type") == "ECONOMY") & (side >= 768) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
    return kept.select("p_partkey", "p_brand", "p_size")


@_r.query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS value_mean, max(CAST(props->>'k' AS INTEGER)) AS max_k FROM events GROUP BY event_type
""")
def run_metadata(spark, sf):
    """Per-mode summaries written as JSON documents and read back with their schema."""
    import uuid

    from pairset.schema import coerced, struct_of
    from pairset.session import checkpoint_root
    from pairset.sources.tables import read_metadata, write_metadata

    events = table(spark, sf, "events")
    k = coerced(events.select(F.get_json_object("props", "$.k").alias("k"), "event_type", F.col("value").cast("string").alias("value")),
                struct_of("k int, event_type string, value double"))
    summary = k.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("value_mean"), F.max("k").alias("max_k"))
    path = f"{checkpoint_root(spark)}/metadata-{uuid.uuid4().hex}"
    write_metadata(summary, path)
    return rounded(read_metadata(spark, path, summary.schema, multi_line=False), "value_mean")


@_r.query("SELECT doc_id, length(text) AS n_text FROM documents")
def index_follow(spark, sf):
    """Index rows arriving in two batches of files, English ones first; each probes the ids that are new."""
    import uuid

    from pairset.schema import struct_of
    from pairset.session import checkpoint_root
    from pairset.streaming.follow import follow_index

    root = f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang")
    docs = rows.drop("lang")
    for arriving in (rows.where("lang = 'en'").drop("lang"), docs):
        arriving.write.mode("append").parquet(f"{root}/in")
        follow_index(spark, f"{root}/in", docs.schema, f"{root}/cache", f"{root}/checkpoint", struct_of("n_text bigint"),
                     lambda row: {"n_text": len(row["text"])}, id_col="doc_id").awaitTermination()
    cache = incremental.stats_cache(spark, f"{root}/cache", docs.schema["doc_id"], struct_of("n_text bigint"))
    return cache.rows().select("doc_id", "n_text")


@_r.query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclude_audited(spark, sf):
    reasons = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("reason"))
    return without_listed(table(spark, sf, "documents").select("doc_id", "lang"), reasons, "doc_id")


@_r.query("SELECT d.doc_id, d.lang, 'toxic' AS reason FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def audited_reasons(spark, sf):
    reasons = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("reason"))
    return listed(table(spark, sf, "documents").select("doc_id", "lang"), reasons, "doc_id")


@_r.query("""
SELECT l_orderkey, l_linenumber, l_tax < 0.01 AND l_discount < 0.01 AND l_quantity / 100 > 0.10 AND l_quantity / 100 < 0.35 AS flagged
FROM lineitem
""")
def part_signature(spark, sf):
    flagged = C.single_part_signature(F.col("l_quantity") / 100, "l_tax", "l_discount", F.lit(0.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", flagged.alias("flagged"))


@_r.query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE NOT (l_quantity > 45 OR l_discount < 0.02)
""")
def sketch_filter(spark, sf):
    sketch = C.sketch_signature("l_quantity", "l_discount", 45, 0.02)
    return table(spark, sf, "lineitem").where(~sketch).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@_r.query("""
SELECT p_partkey, 'divisible by 12' AS rule FROM part WHERE NOT (p_size % 12 = 0)
UNION ALL SELECT p_partkey, 'probability' FROM part WHERE NOT (p_retailprice / 950 BETWEEN 0 AND 1)
UNION ALL SELECT p_partkey, 'at least one' FROM part WHERE NOT (p_size >= 1)
""")
def constraint_violations(spark, sf):
    rules = {
        "divisible by 12": F.col("p_size") % 12 == 0,
        "probability": (F.col("p_retailprice") / 950).between(0, 1),
        "at least one": F.col("p_size") >= 1,
    }
    return violations(table(spark, sf, "part"), "p_partkey", rules)


@_r.query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS code FROM orders")
def category_codes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.coded("o_orderstatus", {"F": 1, "O": 2, "P": 3}).alias("code"))


@_r.query("""
SELECT n_nationkey, n_name, c.label AS label, c.role AS role FROM nation JOIN
  (SELECT r_regionkey AS region, r_name AS label, 'name' AS role FROM region
   UNION ALL SELECT r_regionkey, lower(r_name), 'lower' FROM region) c ON n_regionkey = c.region
""")
def category_label_sets(spark, sf):
    """A category lookup with several labels per category, joined to the rows of the category."""
    region = table(spark, sf, "region")
    labels = region.select(F.col("r_regionkey").alias("category"), F.lit("name").alias("role"), F.col("r_name").alias("label")).unionByName(
        region.select(F.col("r_regionkey").alias("category"), F.lit("lower").alias("role"), F.lower("r_name").alias("label")))
    joined = joins.category_labels(table(spark, sf, "nation"), labels, "n_regionkey")
    return joined.select("n_nationkey", "n_name", "label", "role")


@_r.query("""
WITH g AS (SELECT p_partkey, p_size * 30 AS w, CAST(floor(p_retailprice) AS INTEGER) AS h FROM part),
s AS (SELECT *, least(least(576.0::DOUBLE / w, 864.0::DOUBLE / h), 1.0) AS scale FROM g),
n AS (SELECT *, CAST(trunc(scale * w) AS INTEGER) AS new_w, CAST(trunc(scale * h) AS INTEGER) AS new_h FROM s)
SELECT p_partkey, round(scale, 6) AS scale, new_w, new_h, greatest(576 - new_w, 0) // 2 AS pad_left,
       greatest(864 - new_h, 0) // 2 AS pad_top, greatest(576 - new_w, 0) - greatest(576 - new_w, 0) // 2 AS pad_right,
       greatest(864 - new_h, 0) - greatest(864 - new_h, 0) // 2 AS pad_bottom FROM n
""")
def fit_geometry(spark, sf):
    sized = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 30).alias("w"), F.floor("p_retailprice").cast("int").alias("h"))
    return rounded(sized.withColumns(C.fit_geometry("w", "h", 576, 864, "fit", False)).drop("w", "h"), "scale")


@_r.query("""
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'model' ELSE 'flat-lay' END AS photo_type FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def lookup_default(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return joins.with_default(docs, table(spark, sf, "labels"), "doc_id", "toxic", "model", "flat-lay", "photo_type")


@_r.query("""
SELECT u.user_id, t.event_type AS mode FROM (SELECT DISTINCT user_id FROM events) u
CROSS JOIN (SELECT DISTINCT event_type FROM events) t
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type AND e.value > 100)
""")
def worklist_pending(spark, sf):
    """Every user in every mode, less the pairs that have a successful run."""
    events = table(spark, sf, "events").select("user_id", F.col("event_type").alias("mode"), (F.col("value") > 100).alias("ok"))
    modes = [r.mode for r in events.select("mode").distinct().orderBy("mode").limit(MAX_MODES + 1).collect()]
    if len(modes) > MAX_MODES:
        raise ValueError("too many modes for a worklist of every user in every mode")
    work = incremental.worklist(events.select("user_id").distinct(), modes)
    return incremental.pending(work, events, ["mode", "user_id"], ok="ok")


@_r.query("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def keep_latest(spark, sf):
    """Carry earlier records, add new ones, keep the latest per key."""
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    prior, new = events.where("value < 50"), events.where("not value < 50")
    return incremental.carried_over(prior, new, ["user_id", "event_type"], ["event_id"])


_KINDS = """
(SELECT doc_id, k.kind, 'cache/864x576/' || k.kind || '/' || doc_id || '.' || k.ext AS path FROM documents
 CROSS JOIN (VALUES ('person', 'jpg'), ('garment', 'jpg'), ('person_pose', 'png'), ('garment_pose', 'png'), ('parse', 'png')) k(kind, ext))
"""


@_r.query(f"SELECT doc_id, kind, path FROM {_KINDS}")
def artefact_paths(spark, sf):
    return incremental.artefact_paths(table(spark, sf, "documents"), "cache", 864, 576, "doc_id")


@_r.query("SELECT doc_id, lang FROM documents WHERE n_chars < 1000 OR lang = 'fr'")
def artefact_todo(spark, sf):
    """Short documents have no parse artefact yet and French ones no person pose."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    paths = incremental.artefact_paths(docs, "cache", 864, 576, "doc_id")
    absent = ((F.col("kind") == "parse") & (F.col("n_chars") < 1000)) | ((F.col("kind") == "person_pose") & (F.col("lang") == "fr"))
    listing = paths.join(docs, "doc_id").where(~absent).select("doc_id", "kind", "path")
    return incremental.todo(docs.select("doc_id", "lang"), listing, "doc_id")


@_r.query("""
SELECT count(*) FILTER (toxic = 0) AS processed, count(*) FILTER (toxic = 1) AS failed, count(*) AS total
FROM documents LEFT JOIN labels USING (doc_id)
""")
def progress_counts(spark, sf):
    attempts = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 0).alias("ok"))
    return incremental.progress(table(spark, sf, "documents"), attempts, "doc_id")


@_r.query("""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1
""")
def dedupe_first(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return incremental.first_seen(rows, ["conv_id"], [F.col("turn")])


@_r.query("SELECT p_partkey, round(least(abs(p_size / 50.0 - 0.9), 1 - abs(p_size / 50.0 - 0.9)), 6)::DOUBLE AS distance FROM part")
def circular_distance(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(C.circular_distance(F.col("p_size") / 50.0, 0.9)).alias("distance"))


@_r.query("""
WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm'
  WHEN s >= 60 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS duration FROM t
""")
def duration_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.duration_text("o_totalprice").alias("duration"))


@_r.query("""
SELECT lang, printf('%.1f%%', 100.0 * count(*) / (SELECT count(*) FROM documents)) AS share FROM documents GROUP BY lang
""")
def share_text(spark, sf):
    from pairset.operators.sample import marginal_shares

    shares = marginal_shares(table(spark, sf, "documents"), ["lang"])
    return shares.select(F.col("level").alias("lang"), C.percent_text("share").alias("share"))


@_r.query("""
SELECT doc_id, CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) < 1288490189 AS flip FROM documents
""")
def flip_rows(spark, sf):
    """The rows a mirror augmentation with probability 0.3 applies to."""
    return table(spark, sf, "documents").select("doc_id", chosen_with_probability("doc_id", 0.3, 7).alias("flip"))


@_r.query("""
WITH p AS (SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) - 1 AS i, l.doc_id IS NOT NULL AS valid,
                  count(*) OVER () AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
t AS (SELECT doc_id, (i + a * 7919) % n AS at, a FROM p CROSS JOIN range(5) r(a)),
h AS (SELECT t.doc_id, t.a, p.doc_id AS used FROM t JOIN p ON p.i = t.at AND p.valid)
SELECT p.doc_id, arg_min(h.used, h.a) AS used_id, CAST(min(h.a) + 1 AS INTEGER) AS attempt FROM p LEFT JOIN h USING (doc_id) GROUP BY p.doc_id
""")
def substitute_failed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    flags = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("valid"))
    return incremental.substitute_failed(docs.join(flags, "doc_id", "left"), ["doc_id"], "valid", "doc_id")


@_r.query("""
SELECT vec_id, round(sum(b / 127.5 - 1), 6) AS total, count(*) AS n FROM (
  SELECT vec_id, unnest([greatest(0, least(255, floor((x::DOUBLE + 1) * 127.5))) for x in embedding]) AS b FROM embeddings) GROUP BY vec_id
""")
def rescaled_vectors(spark, sf):
    """Vectors to bytes and back to [-1, 1]."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    back = C.rescale_bytes(C.to_bytes(v))
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(F.aggregate(back, F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size(back).cast("bigint").alias("n"))
