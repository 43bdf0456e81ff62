"""Registered queries of the subpackage: each ``opN_<name>`` applies its
operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from statline.llm import (
    byte_bpe,
    cotraining,
    decision_list,
    decontaminate,
    fm_index,
    minhash_dedup,
    oracle,
    packed_ids,
    page_text,
    sharding,
    suffix_dedup,
    target_resampling,
    toxicity,
    whitening,
)
from statline.llm.batches import for_texts
from statline.session import scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return for_texts(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.scored(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op2_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "packed_ids")
    packed_ids.write(_documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return packed_ids.documents(spark, folder)


def op4_fm_index_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digests(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_documents(spark, sf_dir),
                            public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.groups(_documents(spark, sf_dir), size=3, percent=85, bands=40, rows=7)


def op8_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.judged(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op9_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), scratch_path(spark, "slot_map"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.digests(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"),
                                     percent=25, seed=7)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"), components=4)


def op13_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_factorization_machine,
        op2_packed_token_ids,
        op3_cotraining_quality,
        op4_fm_index_substring_dedup,
        op5_byte_bpe,
        op6_benchmark_decontamination,
        op7_circulant_minhash,
        op8_decision_list_quality,
        op9_virtual_slot_sharding,
        op10_suffix_array_dedup,
        op11_importance_resampling,
        op12_embedding_whitening,
        op13_site_template_text,
    )}


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express on whole tables.  The others rest on
    a tokenizer, a trained model or Spark's own hash, or (bytes) are too slow
    in SQL, and are tested against brute force or held-out labels."""
    return {
        "op4_fm_index_substring_dedup": oracle.WORD_REPEATS,
        "op6_benchmark_decontamination": oracle.LEAKS,
        "op7_circulant_minhash": oracle.NEAR_COPIES,
        "op11_importance_resampling": oracle.RESAMPLING,
        "op13_site_template_text": oracle.MAIN_TEXT,
    }
