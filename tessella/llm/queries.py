"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.suffixes import suffix_dedup

    return suffix_dedup(_documents(spark, sf_dir))


def op2_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.substrings import substring_dedup

    return substring_dedup(_documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.language import fold
    from tessella.llm.lm import lm_scores

    part = fold(F.col("doc_id"), 7)
    scores = lm_scores(_documents(spark, sf_dir), part != 2, part == 3)
    return scores.withColumn("held_out", fold(F.col("doc_id"), 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.bpe import digests

    return digests(_documents(spark, sf_dir), tokenizer_path())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.language import fold, identify, learn

    docs = _documents(spark, sf_dir)
    profiles = learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs, profiles).withColumn("held_out", fold(F.col("doc_id"), 4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.pii import find_pii

    return find_pii(_documents(spark, sf_dir))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.quality import quality_rules

    return quality_rules(_documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.repair import damaged, repaired

    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "dropped")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.warc import page_records

    return page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.align import aligned

    return aligned(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_minhash_lsh_forest": op2_minhash_lsh_forest,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_bpe": op5_bpe,
    "op6_language_id": op6_language_id,
    "op7_pii": op7_pii,
    "op8_ann": op8_ann,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_warc": op12_warc,
    "op13_alignment": op13_alignment,
}
