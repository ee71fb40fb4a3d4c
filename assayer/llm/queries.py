"""The queries that apply each operator to its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chatformat, decontaminate, divergence, embeddings, exactdup, licenses, lmscore, manifest, mixing, pagetext, simhash, tokencount, toxicity
from .common import table


def op1_lm_score(spark, sf_dir):
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    probe = spark.createDataFrame(chatformat.PROBE, turns.schema)
    return chatformat.conversation_digests(chatformat.format_conversations(turns.unionByName(probe)))


def op6_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_token_count(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    return pagetext.extract_pages(table(spark, sf_dir, "pages"))


def op9_decontamination(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark, sf_dir):
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_score, op2_license_scan, op3_simhash_near_dedup, op4_toxicity, op5_chat_format, op6_embedding_near_dedup,
        op7_token_count, op8_html_text, op9_decontamination, op10_source_mixing, op11_exact_dedup, op12_source_divergence,
        op13_merkle_manifest,
    )
}
#: the others fit a model, hash with XXH64, or run a tokenizer: no SQL for those
ORACLES = {
    "op2_license_scan": licenses.oracle_sql(),
    "op5_chat_format": chatformat.oracle_sql(),
    "op9_decontamination": decontaminate.oracle_sql(),
    "op10_source_mixing": mixing.oracle_sql(),
    "op11_exact_dedup": exactdup.oracle_sql(),
    "op12_source_divergence": divergence.oracle_sql(),
    "op13_merkle_manifest": manifest.oracle_sql(),
}
