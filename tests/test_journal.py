"""What a judge reads, whole requests, and what stays of a run that fails."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import judges, questions
from gleaner.plans.engine import Engine
from gleaner.plans.scratch import Scratch

NOW = "2026-01-01T00:00:00Z"


def test_states_of_batches(spark):
    packed = spark.createDataFrame([("p", 0, 1, "e2", "user", 'b "q"', ""), ("p", 0, 0, "e1", "user", "a\né", "before"), ("p", 1, 0, "e3", "assistant", "c", "")], "project string, batch_no int, position int, event_id string, role string, text string, context string")
    by = ["project", "batch_no"]
    states = {r.batch_no: json.loads(r.state) for r in questions.candidate_states(packed, by, '{"name":"p"}').collect()}
    assert [c["id"] for c in states[0]["candidates"]] == ["e1", "e2"] and states[0]["candidates"][0] == {"context": "before", "id": "e1", "role": "user", "text": "a\né"}
    assert states[1]["project"] == {"name": "p"}
    pairs = spark.createDataFrame([(0, 0, "e1", "x", 0, 7, "seven"), (0, 0, "e1", "x", 1, 8, "eight"), (0, 1, "e2", "y", 0, 7, "seven")], "batch_no int, i int, event_id string, claim string, j int, fact_id bigint, known string")
    state = json.loads(questions.pair_states(pairs, ["batch_no"]).first().state)
    assert [f["id"] for f in state["facts"]] == [7, 8] and [c["id"] for c in state["candidates"]] == ["e1", "e2"]
    lines = spark.createDataFrame([(0, 0, 4, "S", "t"), (0, 1, 9, None, "u")], "batch_no int, position int, number int, section string, text string")
    state = json.loads(questions.line_states(lines, ["batch_no"], [{"id": 1, "text": "f"}], []).first().state)
    assert state["facts"] == [{"id": 1, "text": "f"}] and [x["number"] for x in state["lines"]] == [4, 9] and state["statements"] == []


class Echo(judges.RequestJudge):
    """Answers every batch from its body; some responses are broken."""

    def __init__(self, broken=()):
        super().__init__(("batch_no",))
        self.broken = broken

    def respond(self, requests):
        one = lambda q: F.concat(F.lit('"'), q, F.lit('":'), F.when(q.endswith("_category"), F.lit(CHOICE)).when(q.endswith("_significance"), F.lit(SCORE)).otherwise(F.lit('{"type":"noul","noul":0.25}')))
        body = F.concat(F.lit('{"answers":{'), F.array_join(F.transform("question_ids", one), ","), F.lit('},"usage":{"input_tokens":3,"output_tokens":4}}'))
        return requests.withColumn("response", F.when(F.col("batch_no").isin(*self.broken), "{").otherwise(body))


CHOICE = json.dumps({"type": "choice", "choice": "tooling", "probabilities": {c: 1 / 6 for c in ("preference", "tooling", "architecture", "pitfall", "convention", "none")}, "confidence": 0.5})
SCORE = json.dumps({"type": "score", "score": 1.0, "probabilities": {"0": 0.0, "1": 1.0, "2": 0.0, "3": 0.0}, "confidence": 0.5})


def subjects(spark, n=6):
    rows = [(i // 2, i % 2, f"t{i}", f"s{i}") for i in range(n)]
    frame = spark.createDataFrame(rows, "batch_no int, position int, text string, subject_id string")
    return questions.candidate_questions(frame.withColumns({"subject": F.col("subject_id"), "entry": F.col("text")}))


def test_requests_are_answered_by_id(spark):
    asked = subjects(spark)
    rows = Echo().ask(asked).collect()
    assert len(rows) == 18 and all(r.error is None and json.loads(r.answer)["type"] == r.type for r in rows)
    rows = Echo((1,)).ask(asked).collect()
    assert {r.error for r in rows if r.batch_no == 1} == {"json"} and sum(r.answer is not None for r in rows) == 12
    body = questions.requests(asked, asked.select("batch_no").distinct().withColumn("state", F.lit('{"x":1}')), ["batch_no"]).where("batch_no = 0").first()
    parsed = json.loads(body.body)
    assert parsed["state"] == {"x": 1} and sorted(parsed["questions"]) == body.question_ids and len(body.question_ids) == 6


def test_what_was_answered_is_not_asked_again(spark):
    put, kept, seen = Scratch(spark).put, [], []

    class Counting(judges.ColumnJudge):
        def ask(self, asked, states=None):
            seen.append(asked.count())
            return super().ask(asked, states)

    known = lambda: spark.createDataFrame([(r["key"], r.answer) for f in kept for r in f.collect()], "key string, answer string")
    asked = subjects(spark)
    with pytest.raises(judges.JudgeError, match="6 questions"):
        judges.JournalJudge(judges.FaultyJudge(Counting(), {2: "Timeout"}), known(), kept.append, put).ask(asked)
    assert seen == [18] and kept[0].count() == 12
    rows = judges.JournalJudge(Counting(), known(), kept.append, put).ask(asked)
    assert seen == [18, 6] and rows.count() == 18 and rows.where("answer IS NULL").isEmpty()
    judges.JournalJudge(Counting(), known(), kept.append, put).ask(asked)
    assert seen == [18, 6, 0] and len(kept) == 2


def test_a_failed_run_keeps_its_receipts(spark, tmp_path):
    lines = [{"type": "user", "sessionId": "s", "message": {"role": "user", "content": f"we always build part {w} with make"}} for w in "abcdefgh"]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    engine = Engine(spark, f"{tmp_path}/store", "p", grading=True)
    engine.ingest([str(path)], "claude", NOW)
    with pytest.raises(judges.JudgeError):
        engine.distill(NOW, judges.FaultyJudge(judges.normal_judge(), {2: "Timeout"}), budget=600)
    kept = engine.store.table("judgments")
    batches = engine.store.table("answers").count()
    assert kept.count() == batches > 0 and batches % 3 == 0 and batches < 24
    assert engine.status()["pending"] == 8 and engine.status()["last_run"]["error"] == "JudgeError"
    stats = engine.distill(NOW, judges.normal_judge(), budget=600)
    assert stats["candidates_graded"] == 8 and engine.store.table("answers").where("subject_kind = 'candidate'").count() == 24
    assert engine.status()["pending"] == 0
