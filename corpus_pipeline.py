"""The corpus pipeline: five operators in order, each on what the one before kept.

``run`` writes every stage as Parquet in the shared folder and reads it again as the next
one's documents, so a lost executor never costs more than a stage's tasks. The tables
of all stages but the last but one are deleted at the end; the last stage reads that one.

Defined results: an empty table gives an empty result. A null or empty text is a document
like others for the classifier, holds no lines, is a near duplicate of nothing, holds no
benchmark item and has no ids. Rows with a null doc_id are compared with nothing in near
dedup and stay. Rows that repeat a text under one id are copies: one stays; unlike texts
under one id are documents of their own. Extra columns, whatever their names, are carried to
the last stage, which returns its own four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import bpe, decontaminate, line_dedup, minhash_dedup, quality_fm
from spanforge.llm.common import cleared, published, read_table
from spanforge.llm.queries import tokenizer_path

#: Per cent of shared 5-word shingles from which documents are near duplicates.
NEAR_LINK = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows and keep the documents predicted 1."""
    return quality_fm.keep_good(docs, quality_fm.fit(docs, read_table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrite texts without their source's boilerplate lines; a text of nothing else becomes empty."""
    return line_dedup.drop_boilerplate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (similarity 0.8; the 0.85 is op 7's)."""
    return minhash_dedup.without_copies(docs, NEAR_LINK)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return bpe.digest_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]

#: The classifier and the tokenizer have no SQL form: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with cleared(spark):
        for name, stage in STAGES[:-2]:
            docs = published(stage(spark, docs, sf_dir), f"pipeline-{name}")
        docs = published(STAGES[-2][1](spark, docs, sf_dir), f"pipeline-{STAGES[-2][0]}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
