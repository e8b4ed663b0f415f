"""The operators bound to the given tables, one query each, and the SQL of the results that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from laneflow.llm import ann, conversations, divergence, language, licences, mixing, neardup, oracle, packing, pivots, quality, rules, secret_scan, sharding
from laneflow.llm.base import held_out, table


def op1_compression_quality(spark, folder):
    documents = table(spark, folder, "documents")
    model = quality.learn(documents, table(spark, folder, "labels"))
    return quality.classify(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op2_sampled_shards(spark, folder):
    return sharding.shard(table(spark, folder, "documents"))


def op3_markov_secrets(spark, folder):
    documents = table(spark, folder, "documents")
    found = secret_scan.scan(documents.select("doc_id", "text"), secret_scan.learn(documents))
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.RANDOM)
    return found.select(
        "doc_id",
        *[secret_scan.of_kind(F.col("spans"), k).alias(f"n_{k}") for k in (*secret_scan.KINDS, secret_scan.RANDOM)],
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


def op4_multi_index_hashing(spark, folder):
    return ann.search(table(spark, folder, "embeddings"))


def op5_tensored_minhash(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"), words=4)


def op6_bin_slack_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_licence_digests(spark, folder):
    return licences.scan(
        table(spark, folder, "documents"),
        licences.texts_of(spark, licences.LICENCES),
        licences.texts_of(spark, licences.NOTICES),
    )


def op8_risk_controlled_rules(spark, folder):
    return rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("stratum")


def op9_source_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


def op10_language(spark, folder):
    documents = table(spark, folder, "documents")
    found = language.identify(documents, language.learn(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark, folder):
    return divergence.divergence(table(spark, folder, "documents"))


def op12_pivot_elimination(spark, folder):
    return pivots.search(table(spark, folder, "embeddings"))


def op13_conversation_repair(spark, folder):
    return conversations.audit_damaged(table(spark, folder, "conversations"))


QUERIES = {
    "op1_compression_quality": op1_compression_quality,
    "op2_sampled_shards": op2_sampled_shards,
    "op3_markov_secrets": op3_markov_secrets,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_tensored_minhash": op5_tensored_minhash,
    "op6_bin_slack_packing": op6_bin_slack_packing,
    "op7_licence_digests": op7_licence_digests,
    "op8_risk_controlled_rules": op8_risk_controlled_rules,
    "op9_source_mix": op9_source_mix,
    "op10_language": op10_language,
    "op11_source_divergence": op11_source_divergence,
    "op12_pivot_elimination": op12_pivot_elimination,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op7_licence_digests": licences.oracle_sql(),
    "op11_source_divergence": oracle.SOURCE_DIVERGENCE,
    "op12_pivot_elimination": oracle.INNER_PRODUCTS,
    "op13_conversation_repair": oracle.CONVERSATION_AUDIT,
}
