"""A bounded sample of labelled rows, for fitting on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that a sample may have in all.
SAMPLE_BYTES = 24 << 20
#: A text of more than one such part of the bound is left out, and no other for its sake.
TEXT_PART = 16


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key, as text, has this remainder."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    positives: int,
    negatives: int,
    max_bytes: int = SAMPLE_BYTES,
) -> tuple[list[str], np.ndarray, float]:
    """(texts, 0/1 labels, share of 1 among all usable labelled rows).

    At most ``positives`` and ``negatives`` rows of either label, those with the
    least hash of doc_id, as far as ``max_bytes`` of text go; the same rows at every
    run.  A single text of more than a ``TEXT_PART``-th of ``max_bytes`` is left out
    before that total is taken.  Rows without a doc_id or label are left out, repeated doc_ids count
    once, with the least of their texts.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.min(F.col(label).cast("int")).alias("_y"))
    )
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    hashed = rows.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string")))
    least = lambda y, n: hashed.where(F.col("_y") == y).orderBy("_h", "doc_id").limit(n)
    # at most positives + negatives rows: small enough to broadcast, whatever the input
    chosen = least(1, positives).unionByName(least(0, negatives))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.where(F.octet_length("text") * TEXT_PART <= max_bytes)
    # rows that repeat a doc_id give one text, so the window has a bounded number of rows
    texts = texts.groupBy("doc_id", "_y", "_h").agg(F.min("text").alias("text"))
    running = Window.orderBy("_h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    texts = texts.withColumn("_b", F.sum(F.octet_length("text")).over(running)).where(F.col("_b") <= max_bytes)
    found = texts.select("text", "_y").toPandas()
    return found["text"].tolist(), found["_y"].to_numpy(np.int64), (counts.get(1, 0) / total if total else 0.5)


def fit_logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: tuple[float, float] = (2.0, 0.0), strength: float = 1e-2) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), by Newton steps with a weak pull to ``prior``."""
    theta = np.array(prior, float)
    X = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ theta, -30, 30)))
        g = X.T @ (weight * (p - y)) + strength * (theta - prior)
        h = (X * (weight * p * (1 - p))[:, None]).T @ X + strength * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])
