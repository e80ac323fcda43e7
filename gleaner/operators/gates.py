"""Decision rules over judged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import fact_confidence

DURABLE_USER, DURABLE_OTHER, NEAR_MISS = 0.7, 0.8, 0.5
SIGNIFICANT, PAIRING = 1.0, 2.0
SAME, CONTRADICTS, SUPERSEDES = 0.8, 0.6, 0.8
DECISIVE = 0.8
KEYWORDS = ("KEEP", "STALE", "WRONG", "UNSUPPORTED", "REVIEW", "MATCHED")


def phase_a(judged: DataFrame) -> DataFrame:
    """Keep or drop a candidate: durable for its role, and significant."""
    gate = F.when(F.col("role") == "user", DURABLE_USER).otherwise(DURABLE_OTHER)
    reason = F.when(F.col("durable") < gate, "low_durable").when(F.col("significance") < SIGNIFICANT, "low_significance")
    return judged.withColumns(
        {
            "drop_reason": reason,
            "kept": reason.isNull(),
            "near_miss": (F.col("durable") >= NEAR_MISS) & (F.col("durable") < gate),
            "confidence": fact_confidence(F.col("durable")),
        }
    )


def phase_a_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count_if("kept").alias("kept"),
        F.count_if(F.col("drop_reason") == "low_durable").alias("dropped_durable"),
        F.count_if(F.col("drop_reason") == "low_significance").alias("dropped_significance"),
        F.count_if("near_miss").alias("near_misses"),
    )


def pair_action(same: Column, contradicts: Column, verdict: Column, confidence: Column) -> Column:
    return (
        F.when(same >= SAME, "duplicate")
        .when(
            contradicts >= CONTRADICTS,
            F.when((verdict == "new_overrides") & (confidence >= SUPERSEDES), "supersede").otherwise("ask"),
        )
        .otherwise("none")
    )


def best_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Each candidate's action: its strongest pair, ties to the oldest fact.

    duplicate before supersede before ask before add; a partial aggregate by action.
    """
    best = lambda action, score: F.max_by(
        F.when(F.col("action") == action, F.col("fact_id")), F.when(F.col("action") == action, F.struct(F.col(score), -F.col("fact_id")))
    )
    folded = pairs.groupBy(*by).agg(
        best("duplicate", "same_claim").alias("duplicate_of"),
        best("supersede", "verdict_confidence").alias("supersedes"),
        F.count_if(F.col("action") == "ask").alias("asks"),
    )
    return folded.withColumn(
        "action",
        F.when(F.col("duplicate_of").isNotNull(), "duplicate")
        .when(F.col("supersedes").isNotNull(), "supersede")
        .when(F.col("asks") > 0, "ask")
        .otherwise("add"),
    ).withColumn("winner", F.coalesce("duplicate_of", "supersedes"))


def conflict_edges(pairs: DataFrame, best: DataFrame, by: list[str]) -> DataFrame:
    """Over-gate contradictions that did not win: evidence edges, each once."""
    joined = pairs.where(F.col("contradicts") >= CONTRADICTS).join(best.select(*by, "winner", F.col("action").alias("taken")), by)
    lost = joined.where(F.col("winner").isNull() | (F.col("winner") != F.col("fact_id")))
    return lost.select(*by, F.col("fact_id").alias("related_id"), F.lit("contradicts").alias("relation")).distinct()


def line_keyword(anchored: Column, confidence: Column, disposition: Column) -> Column:
    return F.when(anchored, "MATCHED").when(confidence < DECISIVE, "REVIEW").otherwise(F.upper(disposition))


def keyword_counts(spark, verdicts: DataFrame) -> DataFrame:
    """Counts over all keywords, zero where there is none."""
    names = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    counts = verdicts.groupBy("keyword").agg(F.count("*").alias("n"))
    return names.join(counts, "keyword", "left").select("keyword", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
