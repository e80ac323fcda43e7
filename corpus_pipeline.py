"""A training-data pipeline over ``documents``: five stages, each one operator.

Each stage's result is written as Parquet in the shared folder and reread as the next
stage's documents; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe_matrix, decontaminate, exact_dedup, jaccard_join, quality
from gleaner.llm.labelled import held_out
from gleaner.llm.queries import tokenizer_path
from gleaner.llm.session import prepare, unused, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this stage's rows, accepts."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels, ~held_out("doc_id", 5, 0))
    score = unused(docs, "_quality")
    return quality.score_texts(docs, model, score=score).where(F.col(score) >= 0.3).drop(score)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate component."""
    return jaccard_join.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of ids and of the decoded bytes."""
    from public_tokenizers import PATTERN

    prepare(spark)
    return bpe_matrix.encode_texts(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN).drop("text")


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
