"""The memory file that Spark writes against the renderer of single rows."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lifecycle
from gleaner.plans import memory_sink, report

FACTS = (
    "project string, fact_id bigint, claim string, category string, significance double, confidence double, status string, "
    "support_count int, created_at string, last_supported_at string, verified_at string, sessions bigint"
)
ASKS = "project string, fact_id bigint, claim string, confidence double, partner_id bigint, partner_claim string"
NOW = "2026-03-01T00:00:00Z"


def rows(n):
    rng = random.Random(3)
    kinds = ["tooling", "pitfall", "preference", "house rule", "none"]
    halves = [0.0, 1.0, 0.005, 0.015, 0.125, 0.375, 0.625, 0.875, 0.995, 0.285]
    stamp = lambda: f"2026-0{rng.randint(1, 2)}-{rng.randint(10, 28)}T03:04:05Z"
    return [
        ("p", i, f"claim\r\n{i}\nsays \"so\"", rng.choice(kinds), rng.choice([0.5, 1.5, 2.5, rng.random() * 3]), halves[i] if i < len(halves) else rng.random(),
         rng.choice(["active", "active", "ask"]), rng.randint(1, 3), stamp(), rng.choice([None, stamp()]), rng.choice([None, stamp()]), rng.choice([None, 1, 4]))
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [0, 300])
def test_file_equals_the_renderer(spark, tmp_path, n):
    facts = spark.createDataFrame(rows(n), FACTS)
    asks = spark.createDataFrame([("p", 7, "a " * 150, 0.5, 3, "b\t c"), ("p", 9, "x", 0.5, None, None)], ASKS)
    ordered = lifecycle.memory_order(facts).collect()
    for held in (asks, asks.limit(0)):
        target = tmp_path / f"MEMORY-{held.count()}.md"
        memory_sink.write_file(memory_sink.memory_file_lines(facts, held, NOW), str(target))
        assert target.read_bytes().decode() == report.render_memory(ordered, held.orderBy("fact_id").collect(), NOW)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["MEMORY-0.md", "MEMORY-2.md"]
    lines = memory_sink.memory_file_lines(facts, asks)
    memory_sink.write_file(lines, str(target))
    assert "stale" not in target.read_text()
    target.write_text("mine")
    with pytest.raises(report.SentinelError):
        memory_sink.write_file(lines, str(target))
    assert target.read_text() == "mine"
    memory_sink.write_file(lines, str(target), force=True)
    assert target.read_text().startswith(report.SENTINEL)


def test_hundredths(spark):
    rng = random.Random(5)
    values = [rng.random() for _ in range(2000)] + [k / 1000 for k in range(1001)] + [k / 8 for k in range(9)]
    frame = spark.createDataFrame([(v,) for v in values], "x double").select("x", memory_sink.hundredths(F.col("x")).alias("s"))
    assert all(r.s == f"{r.x:.2f}" for r in frame.collect())
