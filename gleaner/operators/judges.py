"""Judges: what answers typed questions, and deterministic stand-ins for a scoring service.

A judge gets question rows (see gleaner.operators.questions) and adds the column
``answer``, a JSON object.  ColumnJudge makes answers from Column expressions:
``hash_answers`` spreads them over the whole range, so that every gate has rows on both
sides; the constant ones mirror the normal and adversarial offline doubles.  A remote
judge would override ``ask`` with a mapInPandas over the rows of a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import CATEGORIES

PAIR_VERDICTS = ("new_overrides", "old_stands", "unclear")
DISPOSITIONS = ("keep", "stale", "wrong", "unsupported")
#: Probability of the chosen option.
PEAK = 0.7


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(options: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(u * len(options)) + 1).cast("int"))


def hash_answers(text: Column) -> dict[str, Column]:
    """Answers about a candidate."""
    return {
        "durable": unit_hash(F.concat(text, F.lit("d"))),
        "significance": 3 * unit_hash(F.concat(text, F.lit("s"))),
        "category": pick(CATEGORIES, unit_hash(F.concat(text, F.lit("c")))),
    }


def normal_answers() -> dict[str, Column]:
    return {"durable": F.lit(0.9), "significance": F.lit(1.2), "category": F.lit("convention")}


def adversarial_answers() -> dict[str, Column]:
    return {"durable": F.lit(0.5), "significance": F.lit(1.5), "category": F.lit(CATEGORIES[0])}


def normal_pair_answers() -> dict[str, Column]:
    return {"same_claim": F.lit(0.9), "contradicts": F.lit(0.08), "verdict": F.lit("new_overrides"), "verdict_confidence": F.lit(0.8)}


def normal_line_answers() -> dict[str, Column]:
    return {"supported": F.lit(0.9), "contradicted": F.lit(0.08), "disposition": F.lit("keep"), "confidence": F.lit(0.8)}


def adversarial_pair_answers() -> dict[str, Column]:
    return {"same_claim": F.lit(0.5), "contradicts": F.lit(0.5), "verdict": F.lit(PAIR_VERDICTS[0]), "verdict_confidence": F.lit(0.0)}


def adversarial_line_answers() -> dict[str, Column]:
    return {"supported": F.lit(0.5), "contradicted": F.lit(0.5), "disposition": F.lit(DISPOSITIONS[0]), "confidence": F.lit(0.0)}


def hash_pair_answers(text: Column) -> dict[str, Column]:
    """Answers about a pair of claims."""
    return {
        "same_claim": unit_hash(F.concat(text, F.lit("m"))),
        "contradicts": unit_hash(F.concat(text, F.lit("x"))),
        "verdict": pick(PAIR_VERDICTS, unit_hash(F.concat(text, F.lit("v")))),
        "verdict_confidence": unit_hash(F.concat(text, F.lit("f"))),
    }


def hash_line_answers(text: Column) -> dict[str, Column]:
    """Answers about a line of a memory file."""
    return {
        "supported": unit_hash(F.concat(text, F.lit("u"))),
        "contradicted": unit_hash(F.concat(text, F.lit("t"))),
        "disposition": pick(DISPOSITIONS, unit_hash(F.concat(text, F.lit("p")))),
        "confidence": unit_hash(F.concat(text, F.lit("q"))),
    }


def scripted(subjects: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """Answers looked up by key; a subject without one is a protocol error."""
    joined = subjects.join(answers.withColumn("_given", F.lit(True)), on, "left")
    missing = F.when(F.col("_given").isNull(), F.raise_error(F.lit("a question has no scripted answer")).cast("boolean"))
    return joined.where(F.coalesce(missing, F.lit(True))).drop("_given")


def answer_json(kind: Column, value: Column, confidence: Column, criteria: Column) -> Column:
    """The JSON answer of a question: noul and score values as numbers, a choice by name."""
    at = F.col("_level").cast("double")
    chosen = F.transform(criteria, lambda o: F.when(o == value, PEAK).otherwise((1 - PEAK) / F.greatest(F.size(criteria) - 1, F.lit(1))))
    near = F.transform(criteria, lambda o, i: F.greatest(F.lit(0.0), 1 - F.abs(at - i)))
    levels = F.transform(criteria, lambda o, i: i.cast("string"))
    noul = F.to_json(F.struct(kind.alias("type"), at.alias("noul")))
    choice = F.to_json(
        F.struct(kind.alias("type"), value.alias("choice"), F.map_from_arrays(criteria, chosen).alias("probabilities"), confidence.alias("confidence"))
    )
    score = F.to_json(
        F.struct(
            kind.alias("type"), at.alias("score"), F.map_from_arrays(levels, criteria).alias("legend"),
            F.map_from_arrays(levels, near).alias("probabilities"), confidence.alias("confidence"),
        )
    )
    return F.when(kind == "noul", noul).when(kind == "choice", choice).otherwise(score)


class JudgeError(Exception):
    """Some questions got no acceptable answer; what was answered is kept."""


class Judge:
    """Answers question rows: adds ``answer``, a JSON object for each.

    ``states`` has what is to be read of each batch (its keys and ``state``, JSON).  A judge may
    also add ``error``, the name of what went wrong where there is no answer, instead of
    failing as a whole.
    """

    def ask(self, questions: DataFrame, states: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError


class RequestJudge(Judge):
    """A judge of whole requests: ``respond`` gets a row a batch (its keys, body, question_ids) and adds ``response``.

    Responses are checked, and their answers dealt to the questions by id; a batch whose response is
    not acceptable has errors in place of answers.
    """

    def __init__(self, by: tuple[str, ...] = ("project", "batch_no")):
        self.by = by

    def respond(self, requests: DataFrame) -> DataFrame:
        raise NotImplementedError

    def ask(self, questions: DataFrame, states: DataFrame | None = None) -> DataFrame:
        from gleaner.operators.questions import requests

        by = [c for c in self.by if c in questions.columns]
        if states is None:
            states = questions.select(*by).distinct().withColumn("state", F.lit("{}"))
        answered = self.respond(requests(questions, states, by))
        wrong = envelope_errors(F.col("response"), F.col("question_ids"))
        given = F.try_variant_get(F.try_parse_json("response"), "$.answers", "map<string,variant>")
        rows = answered.select(*by, wrong.alias("_wrong"), given.alias("_given"))
        joined = questions.join(rows, by, "left")
        answer = F.to_json(F.try_element_at("_given", F.col("question_id")))
        error = F.when(F.col("_given").isNull() & F.col("_wrong").isNull(), "no response").otherwise(F.col("_wrong"))
        return joined.withColumns({"answer": F.when(error.isNull(), answer), "error": error}).drop("_wrong", "_given")


class FaultyJudge(Judge):
    """Another judge, but for the batches of some numbers, which have an error of this name."""

    def __init__(self, judge: Judge, faults: dict[int, str], batch: str = "batch_no"):
        self.judge, self.faults, self.batch = judge, faults, batch

    def ask(self, questions: DataFrame, states: DataFrame | None = None) -> DataFrame:
        error = F.lit(None).cast("string")
        for number, name in self.faults.items():
            error = F.when(F.col(self.batch) == number, F.lit(name)).otherwise(error)
        rows = self.judge.ask(questions, states).withColumn("error", error)
        return rows.withColumn("answer", F.when(F.col("error").isNull(), F.col("answer")))


class JournalJudge(Judge):
    """Another judge, asked only what the journal has no answer to.

    ``known`` are journal rows (key, answer); ``keep`` appends the rows of new answers to it.  A
    question is known by what it is and by its subject's ``entry``, so a failed run, a lost executor
    or a changed batch never asks it twice.  Bad answers are not kept.  When some questions have
    an error or a bad answer, the others are kept first, and then JudgeError is raised.
    """

    def __init__(self, judge: Judge, known: DataFrame, keep, put):
        self.judge, self.known, self.keep, self.put = judge, known, keep, put

    def ask(self, questions: DataFrame, states: DataFrame | None = None) -> DataFrame:
        from gleaner.operators.questions import problem

        key = F.sha2(F.concat_ws("\u001f", F.coalesce("entry", "text"), "name", "prompt", F.array_join("criteria", ",")), 256)
        keyed = self.put(questions.withColumn("key", key))
        known = self.known.groupBy("key").agg(F.min("answer").alias("answer"))
        todo = keyed.join(known.select("key"), "key", "left_anti")
        asked = self.judge.ask(todo, states)
        asked = asked if "error" in asked.columns else asked.withColumn("error", F.lit(None).cast("string"))
        fault = F.coalesce("error", problem(F.try_parse_json("answer")))
        asked = self.put(asked.withColumn("error", fault))
        fine = asked.where("error IS NULL")
        if not fine.isEmpty():
            self.keep(fine)
        worst = asked.where("error IS NOT NULL").agg(F.count("*").alias("n"), F.min_by("error", "question_id").alias("e"), F.min("question_id").alias("q")).first()
        if worst["n"]:
            raise JudgeError(f"{worst['n']} questions without an answer, such as {worst['q']}: {worst['e']}")
        return keyed.join(known, "key").unionByName(fine.select(*keyed.columns, "answer")).drop("key")


class ColumnJudge(Judge):
    """Answers by Column expressions of the subject's text (candidates, lines) or name (pairs)."""

    def __init__(self, candidate=hash_answers, pair=hash_pair_answers, line=hash_line_answers):
        self.candidate, self.pair, self.line = candidate, pair, line

    def ask(self, questions: DataFrame, states: DataFrame | None = None) -> DataFrame:
        given = {**self.candidate(F.col("text")), **self.pair(F.col("subject")), **self.line(F.col("text"))}
        value = F.lit(None).cast("string")
        for name in ("category", "verdict", "disposition"):
            value = F.when(F.col("name") == name, given[name]).otherwise(value)
        number = F.lit(None).cast("double")
        for name in ("durable", "significance", "same_claim", "contradicts", "supported", "contradicted"):
            number = F.when(F.col("name") == name, given[name]).otherwise(number)
        sure = F.when(F.col("name") == "verdict", given["verdict_confidence"]).when(F.col("name") == "disposition", given["confidence"])
        rows = questions.withColumns({"_value": value, "_level": number, "_sure": sure.otherwise(F.lit(0.8))})
        answer = answer_json(F.col("type"), F.col("_value"), F.col("_sure"), F.col("criteria"))
        return rows.withColumn("answer", answer).drop("_value", "_level", "_sure")


def normal_judge() -> ColumnJudge:
    return ColumnJudge(lambda text: normal_answers(), lambda name: normal_pair_answers(), lambda text: normal_line_answers())


def adversarial_judge() -> ColumnJudge:
    return ColumnJudge(lambda text: adversarial_answers(), lambda name: adversarial_pair_answers(), lambda text: adversarial_line_answers())


def planted_judge(rules: list[tuple[str, str]], default: str = "keep") -> ColumnJudge:
    """Lines by the first rule whose text they contain; all else as the normal judge."""
    line = lambda text: normal_line_answers() | {"disposition": planted(text, rules, default), "confidence": F.lit(0.9)}
    return ColumnJudge(lambda text: normal_answers(), lambda name: normal_pair_answers(), line)


class ScriptedJudge(Judge):
    """Answers from a table (question_id, answer); one without an answer is a protocol error."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def ask(self, questions: DataFrame, states: DataFrame | None = None) -> DataFrame:
        return scripted(questions, self.answers.select("question_id", "answer"), ["question_id"])


class CappedJudge(Judge):
    """Another judge, until ``most`` requests (distinct ``batch`` keys) have been made in all."""

    def __init__(self, judge: Judge, most: int, batch: tuple[str, ...] = ("batch_no",)):
        self.judge, self.most, self.batch, self.used = judge, most, batch, 0

    def ask(self, questions: DataFrame, states: DataFrame | None = None) -> DataFrame:
        keys = [c for c in ("project", *self.batch) if c in questions.columns]
        self.used += questions.select(*keys).distinct().count()
        if self.used > self.most:
            raise RuntimeError(f"{self.used} requests are over the cap of {self.most}")
        return self.judge.ask(questions, states)


class IdealJudge(Judge):
    """Answers lines with their planted disposition (text, disposition), and all else as the normal judge."""

    def __init__(self, truth: DataFrame):
        self.truth = truth

    def ask(self, questions: DataFrame, states: DataFrame | None = None) -> DataFrame:
        known = self.truth.select("text", F.col("disposition").alias("_planted")).dropDuplicates(["text"])
        line = lambda text: normal_line_answers() | {"disposition": F.coalesce("_planted", F.lit("keep")), "confidence": F.lit(0.95)}
        own = ColumnJudge(lambda text: normal_answers(), lambda name: normal_pair_answers(), line)
        return own.ask(questions.join(known, "text", "left")).drop("_planted")


def planted(line: Column, rules: list[tuple[str, str]], default: str = "keep") -> Column:
    """Disposition by the first rule whose text the line contains."""
    out = F.lit(default)
    for needle, disposition in reversed(rules):
        out = F.when(F.contains(F.lower(line), F.lit(needle.lower())), F.lit(disposition)).otherwise(out)
    return out


def level_count(answer: Column) -> Column:
    """Levels of a score: one more than the highest key of its legend, or else of its probabilities."""
    legend = F.map_keys(F.try_variant_get(answer, "$.legend", "map<string,string>"))
    keys = F.coalesce(F.when(F.size(legend) > 0, legend), F.map_keys(F.try_variant_get(answer, "$.probabilities", "map<string,double>")))
    return F.array_max(F.transform(keys, lambda k: k.try_cast("int"))) + 1


def envelope_errors(response: Column, question_ids: Column) -> Column:
    """Why a response (JSON text) is not acceptable, or null.

    It has an object of answers with one for every id, whole numbers of tokens used, and
    the name of the model, if it is given.
    """
    record = F.try_parse_json(response)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(record, path, "variant")), F.lit("VOID"))
    answers = F.try_variant_get(record, "$.answers", "map<string,variant>")
    missing = F.size(F.array_except(question_ids, F.map_keys(answers))) > 0
    whole = lambda path: kind(path) == "BIGINT"
    return (
        F.when(record.isNull() | ~F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False)), "json")
        .when(~kind("$.answers").startswith("OBJECT"), "answers")
        .when(F.coalesce(missing, F.lit(True)), "unanswered")
        .when(~(whole("$.usage.input_tokens") & whole("$.usage.output_tokens")), "usage")
        .when(~kind("$.model").isin("STRING", "VOID"), "model")
    )


def answer_errors(answer: Column, kind: str, options: tuple[str, ...] = ()) -> Column:
    """Why a VARIANT answer of this kind is not acceptable, or null.

    Types must match, numbers lie in range, probabilities cover the options and sum
    to 1 within 0.01.
    """
    number = lambda path, top: F.try_variant_get(answer, path, "double").between(0.0, top) & F.schema_of_variant(
        F.try_variant_get(answer, path, "variant")
    ).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")
    wrong_kind = ~F.coalesce(F.try_variant_get(answer, "$.type", "string") == kind, F.lit(False))
    out = F.when(wrong_kind, "type")
    if kind == "noul":
        return out.when(~F.coalesce(number("$.noul", 1.0), F.lit(False)), "noul")
    probabilities = F.try_variant_get(answer, "$.probabilities", "map<string,double>")
    total = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, x: a + x)
    in_range = F.forall(F.map_values(probabilities), lambda p: p.between(0.0, 1.0))
    bad = ~F.coalesce((F.abs(total - 1) <= 0.01) & in_range, F.lit(False))
    if kind == "choice":
        names = F.array(*map(F.lit, options))
        chosen = F.array_contains(names, F.try_variant_get(answer, "$.choice", "string"))
        same = F.array_sort(F.map_keys(probabilities)) == F.array_sort(names)
        return (
            out.when(~F.coalesce(chosen, F.lit(False)), "choice")
            .when(bad, "probabilities")
            .when(~F.coalesce(same, F.lit(False)), "options")
            .when(~F.coalesce(number("$.confidence", 1.0), F.lit(False)), "confidence")
        )
    levels = len(options)
    count = F.size(probabilities) == levels
    return (
        out.when(~F.coalesce(number("$.score", float(levels - 1)), F.lit(False)), "score")
        .when(bad, "probabilities")
        .when(~F.coalesce(count, F.lit(False)), "levels")
        .when(~F.coalesce(number("$.confidence", 1.0), F.lit(False)), "confidence")
    )
