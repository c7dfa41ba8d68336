"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import chat, decontaminate, divergence, langid, linededup, minhash, mixing, oracles, quality, substrings, suffixes, tokencount, vectorcodes, warc
from .runtime import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(_table(spark, sf_dir, "labels"))
    return mixing.mix(_table(spark, sf_dir, "documents"), weights).drop("text_md5")


def op2_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(_table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_repeated_lines(_table(spark, sf_dir, "documents")).drop("text_hash", "kept_text")


def op4_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(chat.PLANTED_ID).cast("long"), "id", role, F.lit(chat.PLANTED_TEXT))
    nodes = stored(chat.as_chain(rows.union(planted)), "nodes")
    return chat.digests(chat.formatted(chat.chosen_paths(nodes)))


def reply_tree_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best branches of every conversation, read as a tree of scored replies."""
    nodes = stored(chat.as_tree(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "nodes")
    turn = F.struct("depth", F.concat("role", F.lit(":"), F.length("text")).alias("turn"))
    rows = chat.chosen_paths(nodes, best=2).groupBy("conv_id", "place", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", "place", "leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["turn"]), " ").alias("turns"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents")).drop("text_hash")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(_table(spark, sf_dir, "documents"), length=35).drop("kept_text")


def op9_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80).drop("text_hash")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(_table(spark, sf_dir, "documents"), length=100).drop("kept_bytes")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.coded(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_distribution_quality": op2_distribution_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_reply_trees": op4_chat_reply_trees,
    "reply_tree_branches": reply_tree_branches,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_minhash_near_duplicates": op9_minhash_near_duplicates,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op2_distribution_quality": oracles.OP2,
    "op3_line_dedup": oracles.OP3,
    "op4_chat_reply_trees": chat.ORACLE,
    "reply_tree_branches": chat.TREE_ORACLE,
    "op5_warc_round_trip": warc.ORACLE,
    "op8_repeated_passages": oracles.OP8,
    "op9_minhash_near_duplicates": oracles.OP9,
    "op1_mix_sources": mixing.ORACLE,
    "op11_suffix_dedup": suffixes.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_vector_codes": vectorcodes.ORACLE,
}
