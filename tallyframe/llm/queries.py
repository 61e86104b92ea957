"""The queries of the corpus operators, by name: (function of session and folder, checking SQL)."""

import corpus_pipeline
from tallyframe.llm import (
    embedding_dedup, language_id, minhash_dedup, mixing, packing, quality_rules, secret_scan, sharding, spelling, suffix_dedup,
    toxicity, vector_codes, vector_forest,
)
from tallyframe.llm.common import table


def op1_quality_rules(spark, folder):
    return quality_rules.quality_table(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_mixing(spark, folder):
    return mixing.mix_table(table(spark, folder, "documents"))


def op3_language_id(spark, folder):
    return language_id.identify(table(spark, folder, "documents"))


def op4_embedding_dedup(spark, folder):
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op5_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


def op6_minhash_dedup(spark, folder):
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"))


def op7_toxicity(spark, folder):
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_sharding(spark, folder):
    return sharding.shard(table(spark, folder, "documents"))


def op9_secret_scan(spark, folder):
    return secret_scan.scan(table(spark, folder, "documents"))


def op10_suffix_dedup(spark, folder):
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op11_vector_codes(spark, folder):
    return vector_codes.compress(table(spark, folder, "embeddings"))


def op12_vector_forest(spark, folder):
    return vector_forest.nearest_of_every(table(spark, folder, "embeddings"))


def op13_spelling_variants(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, None),
    "op2_mixing": (op2_mixing, None),
    "op3_language_id": (op3_language_id, None),
    "op4_embedding_dedup": (op4_embedding_dedup, None),
    "op5_packing": (op5_packing, None),
    "op6_minhash_dedup": (op6_minhash_dedup, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_sharding": (op8_sharding, None),
    "op9_secret_scan": (op9_secret_scan, None),
    "op10_suffix_dedup": (op10_suffix_dedup, None),
    "op11_vector_codes": (op11_vector_codes, None),
    "op12_vector_forest": (op12_vector_forest, None),
    "op13_spelling_variants": (op13_spelling_variants, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
