"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import (
    decontamination, filter_audit, jaccard, kneser_ney, minhash, mixing, oracles, secret_scan, sharding, spelling, substring, topk,
    toxicity, url_trust,
)
from panelwright.llm.common import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("items")


@query
def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf, "documents"))


@query
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"))


@query
def op10_url_trust(spark: SparkSession, sf: str) -> DataFrame:
    return url_trust.judge(table(spark, sf, "pages"))


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf, "documents")).drop("n_links", "rid")


@query
def op6_ngram_jaccard_links(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf, "documents")).drop("rid")


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.rate(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_kneser_ney_quality(spark: SparkSession, sf: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op7_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


@query
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


@query
def op12_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query
def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


SQL |= {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op3_decontamination": oracles.DECONTAMINATION,
    "op6_ngram_jaccard_join": oracles.JACCARD_JOIN,
    "op7_exact_top_k": oracles.TOP_K,
    "op11_spelling_variants": oracles.SPELLING,
    "op12_minhash_dedup": oracles.MINHASH_DEDUP,
    "op13_filter_audit": oracles.FILTER_AUDIT,
}
