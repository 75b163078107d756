"""Named queries of the subpackage over the test tables, with SQL where SQL can express them.

Each applies its operator to the whole table and derives digest columns from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairset.llm import (
    bpe, decontaminate, embedding_dedup, licenses, line_dedup, ngram_join, pii, prefix_trie, secret_scan, token_shards, toxicity,
    url_filters, vector_codes,
)
from pairset.llm.common import scratch, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(spark: SparkSession):
    return bpe.share(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", token_shards.byte_tokens(F.col("text")).alias("tokens"))
    shards = token_shards.write(rows, scratch(spark, "shards"))
    if shards.segments is None:
        return spark.createDataFrame([], "slot long, sequence long, shard int, offset long, n_tokens long, sha256 string, whole boolean, doc_ids array<long>")
    return token_shards.described(spark, shards).select(
        "slot", "sequence", "shard", "offset", "n_tokens", "sha256", "whole", F.col("segments.doc_id").alias("doc_ids"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id", F.col("candidates").alias("n_candidates"), F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(spans, ",").alias("spans"), F.array_max(F.col("secrets.score")).alias("top_score"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary(spark)))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.where("verified").drop("verified").distinct()


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "text")
    return line_dedup.without_recurring(docs).select(
        "doc_id", "n_lines", F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.filtered(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "filter.host", "filter.path", "filter.rule", "filter.verdict")


QUERIES = {f.__name__: f for f in (
    op1_token_shards, op2_secrets, op3_embedding_dedup, op4_bpe, op5_ngram_join, op6_toxicity, op7_decontaminate, op8_licenses,
    op9_line_dedup, op10_pii, op11_vector_codes, op12_prefix_trie, op13_url_filters,
)}
ORACLES: dict[str, str] = {
    "op11_vector_codes": vector_codes.sql(),
    "op12_prefix_trie": prefix_trie.sql(),
    "op13_url_filters": url_filters.sql(url_filters.rules()),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
