"""Audit of memory lines against facts: anchors, verdicts, evidence, fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.gates import DECISIVE, line_keyword
from gleaner.operators.retrieval import oldest_equal


def anchors(lines: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that are word for word (after normalising) an active fact, oldest first."""
    return oldest_equal(lines, facts, "text", keys)


def unanchored(lines: DataFrame, anchored: DataFrame, line_key: list[str]) -> DataFrame:
    return lines.join(anchored.select(*line_key).distinct(), line_key, "left_anti")


def line_verdicts(lines: DataFrame, anchored: DataFrame, line_key: list[str]) -> DataFrame:
    """Judged lines with anchored ones decided; adds decisive and keyword.

    lines: ..., disposition, confidence, supported, contradicted.
    """
    known = anchored.select(*line_key, F.col("fact_id").alias("anchor_fact_id")).distinct()
    joined = lines.join(known, line_key, "left")
    hit = F.col("anchor_fact_id").isNotNull()
    fixed = lambda name, value: F.when(hit, F.lit(value)).otherwise(F.col(name))
    return joined.withColumns(
        {
            "disposition": fixed("disposition", "keep"),
            "confidence": fixed("confidence", 1.0),
            "supported": fixed("supported", 1.0),
            "contradicted": fixed("contradicted", 0.0),
            "decisive": hit | (F.col("confidence") >= DECISIVE),
            "keyword": line_keyword(hit, F.col("confidence"), F.col("disposition")),
        }
    )


def evidence_pool(facts: DataFrame, statements: DataFrame, n_facts: int = 30, n_statements: int = 40) -> DataFrame:
    """The newest active facts and statements, told oldest first; rows are bounded.

    Top-k of each side is taken per partition before anything is merged.
    """
    new_facts = facts.where("status = 'active'").orderBy(F.desc("fact_id")).limit(n_facts)
    new_said = statements.orderBy(F.desc("seq")).limit(n_statements)
    return new_facts.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("place"), F.col("claim").alias("text")).unionByName(
        new_said.select(F.lit("statement").alias("kind"), F.col("seq").alias("place"), "text")
    )


def confusion(truth: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    return truth.join(predicted, on).groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def accuracy(truth: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    return truth.join(predicted, on).agg(
        F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy")
    )


def anchor_fidelity(planted: DataFrame, anchored: DataFrame, on: list[str]) -> DataFrame:
    """Recall of verbatim lines and share of false anchors among the rest."""
    joined = planted.join(anchored.select(*on).distinct().withColumn("_hit", F.lit(1.0)), on, "left").fillna(0.0, ["_hit"])
    return joined.agg(
        F.avg(F.when(F.col("verbatim"), F.col("_hit"))).alias("recall"),
        F.avg(F.when(~F.col("verbatim"), F.col("_hit"))).alias("false_anchors"),
    )
