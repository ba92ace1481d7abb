"""Registered queries of the training-data operators: each applies one
operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtstats.llm import (
    bwt_dedup, conv_trie, decontam, embed_dedup, hard_negatives, langid, lattice_lm, mixing, quality_rules, secret_scan,
    simhash, suffix_tree, toxicity,
)
from courtstats.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_sainte_lague_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op4_sainte_lague_mix"] = mixing.oracle()


@query
def op5_randomness_secrets(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("found")


ORACLES["op5_randomness_secrets"] = secret_scan.oracle()


@query
def op8_simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_int8_embedding_groups(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op9_int8_embedding_groups"] = embed_dedup.ORACLE


@query
def op3_centroid_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op1_segment_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_seeded_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_lattice_lm(spark, sf_dir):
    return lattice_lm.score(table(spark, sf_dir, "documents"))


@query
def op2_bwt_substring_dedup(spark, sf_dir):
    return bwt_dedup.dedup(table(spark, sf_dir, "documents"))


ORACLES["op2_bwt_substring_dedup"] = bwt_dedup.ORACLE


@query
def op6_suffix_tree_dedup(spark, sf_dir):
    return suffix_tree.dedup(table(spark, sf_dir, "documents"))


ORACLES["op6_suffix_tree_dedup"] = suffix_tree.ORACLE


@query
def op11_risk_controlled_quality(spark, sf_dir):
    d = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


ORACLES["op11_risk_controlled_quality"] = quality_rules.oracle()


@query
def op12_conversation_trie(spark, sf_dir):
    return conv_trie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_conversation_trie"] = conv_trie.ORACLE


@query
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLES["op13_hard_negatives"] = hard_negatives.ORACLE
