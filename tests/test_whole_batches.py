"""Groups that fit into one batch are numbered where they lie, and answers are parsed once."""

import random

import pytest

from gleaner.functions import text as tx
from gleaner.operators import batching, judges, questions, retrieval


def frame(spark, groups):
    return spark.createDataFrame([(g, i, c) for g, sizes in groups.items() for i, c in enumerate(sizes)], "g string, o long, c long")


def placed(packed):
    return sorted((r.g, r.o, r.batch_no, r.position) for r in packed.collect())


def greedy(groups, most):
    out = []
    for g, sizes in groups.items():
        batch, used, position = 0, 0, 0
        for i, c in enumerate(sizes):
            if used + c + 1 > most and position:
                batch, used, position = batch + 1, 0, 0
            out.append((g, i, batch, position))
            used, position = used + c + 1, position + 1
    return sorted(out)


def test_no_task_for_each_small_group(spark, monkeypatch):
    monkeypatch.setattr(batching, "_places", lambda *a, **k: pytest.fail("a group of one batch was cut into nodes"))
    groups = {f"g{k}": [3] * k for k in range(1, 11)}  # the last has 40 characters, all there is room for
    assert placed(batching.pack(frame(spark, groups), ["g"], "o", "c", budget=10)) == greedy(groups, 40)


def test_small_and_large_groups(spark):
    r = random.Random(2)
    groups = {f"g{k}": [r.randint(0, 30) for _ in range(n)] for k, n in enumerate((1, 2, 300, 3, 40))}
    assert placed(batching.pack(frame(spark, groups), ["g"], "o", "c", budget=10)) == greedy(groups, 40)


def test_answers_are_not_parsed_in_filters(spark):
    lines = spark.createDataFrame([("a", 0, "one line")], "subject string, position int, text string")
    asked = questions.checked(judges.ColumnJudge().ask(questions.line_questions(lines)), questions.PHASE_C)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "parse_json" in line for line in plan.splitlines())
    assert asked.where("value IS NOT NULL OR choice IS NOT NULL").count() == 3


def test_equal_claims_by_a_digest_that_is_there(spark):
    rows = spark.createDataFrame([(3, "A  b"), (1, "c"), (2, "a B ")], "fact_id long, claim string")
    hashed = rows.select("fact_id", tx.claim_hash(rows.claim).alias("_norm"))
    found = retrieval.oldest_equal(hashed.withColumnRenamed("fact_id", "own"), hashed, "text", [])
    assert sorted((r.own, r.fact_id) for r in found.collect()) == [(1, 1), (2, 2), (3, 2)]
