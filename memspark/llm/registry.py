"""The registered queries of this subpackage, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from memspark.llm import alignment, langid, mixing, neighbours, packing, pieces, quality, repeats, sketch, token_files, toxicity, variants
from memspark.llm.simhash import near_duplicates
from memspark.session import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_pairs(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "quality_ok")


def op10_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_pair_bitmap_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_trie_frontier_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_adaptive_dimension_scan": op2_adaptive_dimension_scan,
        "op3_toxicity": op3_toxicity,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_bottom_k_sketch": op5_bottom_k_sketch,
        "op6_language_id": op6_language_id,
        "op7_subset_sum_mixing": op7_subset_sum_mixing,
        "op8_token_id_files": op8_token_id_files,
        "op9_weak_label_quality": op9_weak_label_quality,
        "op10_prefix_free_parsing": op10_prefix_free_parsing,
        "op11_pair_bitmap_alignment": op11_pair_bitmap_alignment,
        "op12_trie_frontier_variants": op12_trie_frontier_variants,
        "op13_best_fit_packing": op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {}
