import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import judges
from gleaner.operators import questions as q
from gleaner.sources import status_log


def test_questions_and_receipts(spark):
    rows = q.candidate_questions(spark.createDataFrame([("e", 0), ("f", 1)], "event_id string, position int")).collect()
    assert [r.question_id for r in rows] == ["c0_durable", "c0_category", "c0_significance", "c1_durable", "c1_category", "c1_significance"]
    pair = q.pair_questions(spark.createDataFrame([(2, 3)], "i int, j int")).collect()
    assert [r.question_id for r in pair] == ["p2_3_same_claim", "p2_3_contradicts", "p2_3_verdict"]
    asked = spark.createDataFrame([("e", "e", "t", 0)], "subject_id string, subject string, text string, position int")
    given = lambda text: {"durable": F.lit(0.9), "category": F.lit("tooling"), "significance": F.lit(1.5)}
    answered = q.checked(judges.ColumnJudge(given).ask(q.candidate_questions(asked)), q.PHASE_A)
    out = {r.question_id: r for r in q.receipts(answered, "candidate", 7, "now").collect()}
    assert {k: r.type for k, r in out.items()} == {"durable": "noul", "category": "choice", "significance": "score"}
    assert out["durable"].answer_json == '{"type":"noul","noul":0.9}'
    row = q.by_subject(answered, ["position"], q.PHASE_A).first()
    assert (row.durable, row.category, row.significance, row.category_confidence) == (0.9, "tooling", 1.5, 0.8)
    body = json.loads(q.wire(q.candidate_questions(asked), ["subject"]).first().body)
    assert sorted(body["questions"]) == ["c0_category", "c0_durable", "c0_significance"] and body["questions"]["c0_durable"]["type"] == "noul"


def test_distributions(spark):
    row = spark.range(1).select(
        q.weighted_score(q.peaked_levels(4, 1)).alias("score"), q.peaked(("a", "b", "c", "d"), "b").alias("p")
    ).first()
    assert row.score == pytest.approx(1.2)
    assert row.p["b"] == 0.7 and sum(row.p.values()) == pytest.approx(1)


def test_status_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert status_log.append_log(spark, path, event="ingest", ts="t1")
    assert spark.read.text(path).count() == 1
    assert not status_log.append_log(spark, "nosuchscheme://x/y", event="ingest")
    lines = [(1, '{"event":"ingest","ts":"t1"}'), (2, "broken"), (3, '{"event":"ingest","ts":"t2"}'), (4, '{"event":"audit","error":"boom"}'), (5, "[1]")]
    row = status_log.last_events(spark.createDataFrame(lines, "ord int, line string")).first()
    assert (row.last_ingest, row.last_error) == ("t2", "boom")
    assert status_log.first_object([None, "x", "[1]", '{"a": 1}', '{"b": 2}']) == {"a": 1}


def test_public_names():
    import gleaner

    assert all(getattr(gleaner, name) is not None for name in gleaner.__all__)
    with pytest.raises(AttributeError):
        gleaner.nothing_of_that_name
