"""Registered queries of this subpackage: thin digests of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from endcap.llm import (
    bpe,
    filter_audit,
    jaccard_join,
    mixing,
    multi_index,
    packing,
    prefix_trie,
    quality,
    secret_scan,
    sharding,
    substring_dedup,
    toxicity,
    vptree,
)
from endcap.llm.oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sum_of_squares_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def op2_bounded_ring(spark: SparkSession, d: str) -> DataFrame:
    rows = sharding.document_sizes(table(spark, d, "documents"))
    out = sharding.ring_shards(rows, "doc_id", 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                      "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_level_wise_doubling(spark: SparkSession, d: str) -> DataFrame:
    out = substring_dedup.removed(table(spark, d, "documents"), 13, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_chosen_path_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.joined(table(spark, d, "documents")).drop("text_hash")


def op5_fourier_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(table(spark, d, "documents"), table(spark, d, "labels"))


def op6_vantage_point_search(spark: SparkSession, d: str) -> DataFrame:
    return vptree.nearest(table(spark, d, "embeddings"))


def op7_inverted_multi_index(spark: SparkSession, d: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, d, "embeddings"))


def op8_boosted_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_novelty_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.scan(table(spark, d, "documents")).drop("found")


def op10_pivotal_mixing(spark: SparkSession, d: str) -> DataFrame:
    out = mixing.mixed(table(spark, d, "documents"))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"))


def op11_segment_tree_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"), with_ids=False)


def op12_double_array_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.prefix_nodes(prefix_trie.rebuilt(table(spark, d, "conversations")))


def op13_lehmer_rank_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES = {f.__name__: f for f in (op1_sum_of_squares_packing, op2_bounded_ring,
                                   op3_level_wise_doubling, op4_chosen_path_join, op5_fourier_quality, op6_vantage_point_search,
                                   op7_inverted_multi_index, op8_boosted_toxicity,
                                   op9_novelty_secrets, op10_pivotal_mixing, op11_segment_tree_bpe,
                                   op12_double_array_trie, op13_lehmer_rank_audit)}
