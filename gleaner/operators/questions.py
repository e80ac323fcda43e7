"""Typed questions about candidates, pairs and lines, a row for each.

Question ids name the subject's position in its batch: ``c0_durable``,
``p0_1_verdict``, ``l3_disposition``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import CATEGORIES, LEVELS
from gleaner.operators.judges import DISPOSITIONS, PAIR_VERDICTS, answer_errors

#: (name, type, prompt, criteria) by phase.
PHASE_A = (
    ("durable", "noul", "Will this still hold in later sessions?", ()),
    ("category", "choice", "What kind of fact is it?", CATEGORIES),
    ("significance", "score", "How much would losing it cost?", LEVELS),
)
PHASE_B = (
    ("same_claim", "noul", "Do both say the same thing?", ()),
    ("contradicts", "noul", "Can both not be true at once?", ()),
    ("verdict", "choice", "Which of the two holds now?", PAIR_VERDICTS),
)
PHASE_C = (
    ("supported", "noul", "Does the evidence support the line?", ()),
    ("contradicted", "noul", "Does the evidence contradict the line?", ()),
    ("disposition", "choice", "What should become of the line?", DISPOSITIONS),
)


def ask(subjects: DataFrame, prefix: Column, phase) -> DataFrame:
    """Three question rows for each subject: question_id, name, type, prompt, criteria."""
    asked = F.array(
        *[
            F.struct(
                F.concat(prefix, F.lit(f"_{name}")).alias("question_id"),
                F.lit(name).alias("name"),
                F.lit(kind).alias("type"),
                F.lit(prompt).alias("prompt"),
                F.array(*map(F.lit, criteria)).cast("array<string>").alias("criteria"),
            )
            for name, kind, prompt, criteria in phase
        ]
    )
    return subjects.select("*", F.explode(asked).alias("_q")).select(*subjects.columns, "_q.*")


def candidate_questions(batched: DataFrame) -> DataFrame:
    return ask(batched, F.concat(F.lit("c"), F.col("position").cast("string")), PHASE_A)


def pair_questions(batched: DataFrame) -> DataFrame:
    return ask(batched, F.concat(F.lit("p"), F.col("i").cast("string"), F.lit("_"), F.col("j").cast("string")), PHASE_B)


def line_questions(batched: DataFrame) -> DataFrame:
    return ask(batched, F.concat(F.lit("l"), F.col("position").cast("string")), PHASE_C)


def peaked(options: tuple[str, ...], target: str, peak: float = 0.7) -> Column:
    """A distribution with ``peak`` on one option and the rest spread evenly."""
    rest = (1 - peak) / max(1, len(options) - 1)
    return F.create_map(*[x for o in options for x in (F.lit(o), F.lit(peak if o == target else rest))])


def peaked_levels(count: int, at: int) -> Column:
    """Levels with 0.6 at one, 0.3 shared by its neighbours, 0.1 by the others."""
    near = [i for i in (at - 1, at + 1) if 0 <= i < count]
    far = [i for i in range(count) if i != at and i not in near]
    weight = {at: 0.6} | {i: 0.3 / len(near) for i in near} | {i: 0.1 / len(far) for i in far}
    total = sum(weight.values())
    return F.create_map(*[x for i in range(count) for x in (F.lit(str(i)), F.lit(weight[i] / total))])


def weighted_score(probabilities: Column) -> Column:
    """Probability-weighted level of a map of level to probability."""
    return F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda a, e: a + e["key"].cast("double") * e["value"])


def question_chars(phase, places: int = 8) -> int:
    """Characters of a subject's three questions in a request, at most, with ``places`` for its position."""
    wire = [{"type": kind, "prompt": prompt, "criteria": list(criteria)} for _, kind, prompt, criteria in phase]
    return sum(len(name) + places + 6 + len(json.dumps(w, sort_keys=True, separators=(",", ":"))) for (name, *_), w in zip(phase, wire))


def wire(asked: DataFrame, by: list[str]) -> DataFrame:
    """The request body's ``questions`` member of each batch, as JSON in the order of the ids."""
    form = F.struct(
        F.col("question_id").alias("id"),
        F.to_json(F.struct(F.col("criteria"), F.col("prompt"), F.col("type"))).alias("body"),
    )
    rows = asked.groupBy(*by).agg(F.array_sort(F.collect_list(form)).alias("q"))
    member = lambda q: F.concat(F.lit('"'), q["id"], F.lit('":'), q["body"])
    return rows.select(*by, F.concat(F.lit('{"questions":{'), F.array_join(F.transform("q", member), ","), F.lit("}}")).alias("body"))


def _in_place(place: str, **members: str) -> Column:
    """A batch's entries in the order of ``place``, each once; a batch is bounded by its budget."""
    entry = F.struct(*[F.col(c).alias(name) for name, c in members.items()]).alias("entry")
    return F.transform(F.array_sort(F.collect_set(F.struct(place, entry))), lambda x: x["entry"])


def _state(context: str, **members: Column) -> Column:
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts, F.lit(f'"project":{context}')), F.lit("}")).alias("state")


def candidate_states(packed: DataFrame, by: list[str], context: str = "{}") -> DataFrame:
    """(by, state): what a judge reads of a batch of candidates (position, event_id, role, text, context)."""
    told = _in_place("position", context="context", id="event_id", role="role", text="text")
    return packed.groupBy(*by).agg(told.alias("c")).select(*by, _state(context, candidates=F.to_json("c")))


def pair_states(pairs: DataFrame, by: list[str], context: str = "{}") -> DataFrame:
    """The same of a batch of pairs (i, event_id, claim, j, fact_id, known); a fact stands there once, whoever asks for it."""
    told = pairs.groupBy(*by).agg(_in_place("i", id="event_id", text="claim").alias("c"), _in_place("j", id="fact_id", text="known").alias("f"))
    return told.select(*by, _state(context, candidates=F.to_json("c"), facts=F.to_json("f")))


def line_states(packed: DataFrame, by: list[str], facts: list[dict], statements: list[dict], context: str = "{}") -> DataFrame:
    """The same of a batch of memory lines (position, number, section, text), with the evidence that all batches share."""
    told = packed.groupBy(*by).agg(_in_place("position", number="number", section="section", text="text").alias("l"))
    known = {name: F.lit(json.dumps(rows, separators=(",", ":"))) for name, rows in (("facts", facts), ("statements", statements))}
    return told.select(*by, _state(context, **known, lines=F.to_json("l")))


def requests(asked: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """(by, body, question_ids): the request of each batch, its state and its questions."""
    ids = asked.groupBy(*by).agg(F.array_sort(F.collect_list("question_id")).alias("question_ids"))
    rows = wire(asked, by).withColumnRenamed("body", "_q").join(states, by).join(ids, by)
    inner = F.expr("substring(_q, 2, length(_q) - 2)")
    return rows.select(*by, F.concat(F.lit("{"), inner, F.lit(',"state":'), "state", F.lit("}")).alias("body"), "question_ids")


def problem(answer: Column) -> Column:
    """Why the JSON answer of a question row is not acceptable, or null."""
    out = F.lit(None).cast("string")
    for name, kind, _, criteria in (*PHASE_A, *PHASE_B, *PHASE_C):
        out = F.when(F.col("name") == name, answer_errors(answer, kind, criteria)).otherwise(out)
    return F.when(answer.isNull(), "json").otherwise(out)


_READ = "struct<value:double,choice:string,sure:double>"


def checked(answered: DataFrame, phase) -> DataFrame:
    """Answers parsed and validated: ``value`` (number), ``choice`` and ``sure``; a bad one is an error."""
    parsed = F.try_parse_json("answer")
    problem = F.lit(None).cast("string")
    for name, kind, _, criteria in phase:
        problem = F.when(F.col("name") == name, answer_errors(F.col("_a"), kind, criteria)).otherwise(problem)
    rows = answered.withColumn("_a", parsed).withColumn("_p", F.when(F.col("_a").isNull(), "json").otherwise(problem))
    said = F.concat(F.lit("bad answer to "), F.col("question_id"), F.lit(": "), F.col("_p"))
    number = F.coalesce(F.try_variant_get("_a", "$.noul", "double"), F.try_variant_get("_a", "$.score", "double"))
    read = F.struct(number.alias("value"), F.try_variant_get("_a", "$.choice", "string").alias("choice"), F.try_variant_get("_a", "$.confidence", "double").alias("sure"))
    # not a filter: pushed below, it would make and parse the answer anew for each of its parts
    read = F.when(F.col("_p").isNull(), read).otherwise(F.raise_error(said).cast(_READ))
    return rows.withColumn("_r", read).select(*answered.columns, "_r.value", "_r.choice", "_r.sure")


def by_subject(found: DataFrame, by: list[str], phase) -> DataFrame:
    """A row for each subject, its answers as columns named by question; choices also have ``<name>_confidence``."""
    cells = []
    for name, kind, *_ in phase:
        own = F.col("name") == name
        cells.append(F.max(F.when(own, F.col("choice" if kind == "choice" else "value"))).alias(name))
        if kind == "choice":
            cells.append(F.max(F.when(own, F.col("sure"))).alias(f"{name}_confidence"))
    return found.groupBy(*by).agg(*cells)


def receipts(answered: DataFrame, kind: str, run_id: int, now: str) -> DataFrame:
    """A receipt for each answer, as it was given: subject_id, name, type and answer of the rows."""
    return answered.select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(kind).alias("subject_kind"), "subject_id", F.col("name").alias("question_id"),
        "type", F.col("answer").alias("answer_json"), F.lit(now).alias("created_at"),
    )
