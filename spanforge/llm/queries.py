"""Queries of the training-data operators, as the driver registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import bpe, chat_format, decontaminate, licenses, line_dedup, minhash_dedup, quality_fm, quality_rules, url_filter, wavelet
from spanforge.llm.common import read_table

END_ID = 2


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the files stay where they are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_fm.score_documents(docs, quality_fm.fit(docs, read_table(spark, sf_dir, "labels")))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.perspectives(read_table(spark, sf_dir, "conversations"))


def op3_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_boilerplate(read_table(spark, sf_dir, "documents"), report=True)
    return found.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID)
    return wavelet.read_documents(shards, END_ID).withColumnRenamed("n_symbol", "n_end_ids")


def op7_signature_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), link=85)


def op8_adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(read_table(spark, sf_dir, "documents"))


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from spanforge.llm import sql

    return dict(sql.ORACLES)
