"""The engine: ingest, distill, audit, resolve, status, recall and search over a store."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.redaction import redaction_count
from gleaner.operators import audit as au
from gleaner.operators import batching, gates, judges, lifecycle, questions, retrieval, search_index
from gleaner.operators.events import dedupe_events
from gleaner.plans import distill as ds
from gleaner.plans import memory_sink, report
from gleaner.plans.scratch import Scratch
from gleaner.plans.store import Store
from gleaner.sources import memory_file, status_log, transcripts
from gleaner.streaming.ingest import in_order_of_arrival, statements_to_events

SEARCH_LIMIT = 25


class GradingNotEnabledError(Exception):
    """Distill and audit need the project's consent: Engine.init(enable_grading=True) or Engine(grading=True)."""


class Engine:
    def __init__(self, spark: SparkSession, root: str, project: str, grading: bool = False, read_only: bool = False, log: str | None = None):
        self.spark, self.project, self.grading, self.log = spark, project, grading, log
        self.store = Store(spark, root, read_only)

    # -- the store -----------------------------------------------------------------

    def init(self, enable_grading: bool = False, now: str = "") -> int:
        """Make the store or bring an older one up to date; with ``enable_grading`` note the project's consent."""
        version = self.store.migrate() or self.store.publish()
        if enable_grading and not self._consent():
            row = self.spark.createDataFrame([(self.project, now)], "project string, enabled_at string")
            version = self.store.publish(append={"markers": row}, project=self.project)
        return version

    def _consent(self) -> bool:
        return not self._mine("markers").isEmpty()

    def _mine(self, name: str) -> DataFrame:
        return self.store.table(name).where(F.col("project") == self.project)

    def _index(self) -> search_index.Index:
        """The kept search index of this project; a store from before it had one is indexed on the spot."""
        index = search_index.Index(*map(self._mine, search_index.SCHEMAS))
        if index.docs.isEmpty():
            return search_index.build(self._mine("facts").where("indexed"))
        return index

    def _index_changes(self, facts: DataFrame) -> dict[str, DataFrame]:
        """Rows that keep the index in step with the next snapshot of this project's facts."""
        index = search_index.Index(*map(self._mine, search_index.SCHEMAS))
        return search_index.changes(index, facts, self.store.version() + 1)

    def compact(self) -> None:
        """One folder a table, one segment of the index; what no version reads any more is deleted."""
        for name in ("events", "grades", "sources", "runs", "judgments"):
            if not self.store.table(name).isEmpty():
                self.store.compact(name)
        postings, docs = search_index.segment(self._mine("facts").where("indexed"), self.store.version() + 1)
        gone = self.spark.createDataFrame([], search_index.GONE)
        self.store.publish(replace={"postings": postings, "index_docs": docs, "index_gone": gone}, project=self.project)
        self.store.vacuum()

    def _need_grading(self) -> None:
        if not self.grading and not self._consent():
            raise GradingNotEnabledError(self.project)

    def _open_run(self, kind: str, now: str) -> int:
        """A run row without an end; what ends it is logged under the same id."""
        run_id = (self.store.table("runs").agg(F.max("id")).first()[0] or 0) + 1
        self._log_run(run_id, kind, now, None, None, None)
        return run_id

    def _log_run(self, run_id: int, kind: str, started: str, finished: str | None, stats: dict | None, error: str | None, **tables) -> None:
        row = (run_id, self.project, kind, started, finished, json.dumps(stats, sort_keys=True) if stats is not None else None, error)
        runs = self.spark.createDataFrame([row], self.store.schemas["runs"])
        append = {"runs": runs, **tables.get("append", {})}
        self.store.publish(append=append, replace=tables.get("replace", {}), project=self.project)

    def _receipt_ids(self, rows: DataFrame, run_id: int) -> DataFrame:
        """Ids that no other run's receipts have."""
        return rows.withColumn("id", F.lit(run_id << 40).cast("bigint") + F.monotonically_increasing_id().bitwiseAND((1 << 40) - 1))

    # -- ingest --------------------------------------------------------------------

    def _parsed(self, lines: DataFrame, dialect: str) -> DataFrame:
        return transcripts.PARSERS[dialect](lines)

    def ingest(self, paths: list[str], dialect: str | None = None, now: str = "") -> dict[str, int]:
        """Append the transcripts' statements that the log does not have, in the order they came.

        Without a dialect each file's is found from its path or first line.
        """
        by_dialect = {dialect: paths} if dialect else transcripts.dialects_of(self.spark, paths)
        counts = {"inserted": 0, "ignored": 0, "skipped_lines": 0}
        for kind, own in by_dialect.items():
            for k, n in self._ingest(own, kind, now).items():
                counts[k] += n
        if self.log:
            status_log.append_log(self.spark, self.log, event="ingest", ts=now, **counts)
        return counts

    def _ingest(self, paths: list[str], dialect: str, now: str) -> dict[str, int]:
        parsed = transcripts.parse_lines(transcripts.read_lines(self.spark, *paths)).cache()
        found = self._parsed(parsed, dialect).cache()
        try:
            log = self._mine("events")
            last = log.agg(F.max("seq")).first()[0] or 0
            ordered = in_order_of_arrival(found, transcripts.arrivals(self.spark, paths), last + 1)
            rows = statements_to_events(ordered, self.project, now)
            new = dedupe_events(rows, log).select(*rows.columns)
            before, total = self.store.version(), found.count()
            version = self.store.publish(append={"events": new}, project=self.project)
            added = set(self.store._folders("events", version)) - set(self.store._folders("events", before) if before else ())
            inserted = self.spark.read.schema(self.store.schemas["events"]).parquet(*added).count()
            skipped = parsed.where(~F.col("ok")).count()
            return {"inserted": inserted, "ignored": total - inserted, "skipped_lines": skipped}
        finally:
            parsed.unpersist(), found.unpersist()

    def scan(self, roots: list[str], name: str) -> DataFrame:
        return transcripts.discover(self.spark, roots, name)

    def verify(self, paths: list[str], dialect: str) -> DataFrame:
        """Statements, secrets and lengths by file and role, without writing anything."""
        lines = transcripts.parse_lines(transcripts.read_lines(self.spark, *paths))
        found = self._parsed(lines, dialect).withColumns({"secrets": redaction_count(F.col("text")), "chars": F.length("text")})
        return found.groupBy("path", "role").agg(
            F.count("*").alias("statements"), F.sum("secrets").alias("secrets"), F.min("chars").alias("least_chars"), F.max("chars").alias("most_chars")
        )

    # -- distill -------------------------------------------------------------------

    def distill(self, now: str, judge: judges.Judge | None = None, cap: int | None = 50, budget: int = batching.BUDGET, context: dict | None = None) -> dict:
        """Grade pending events into facts and publish the next snapshot at once.

        A run with nothing to grade and no open ask writes nothing.  The run is open in
        the log from its start; it is closed with its counts, or with the error's name, in
        which case the events stay pending.  Answers are kept in a journal as they come: those of a
        failed run have their receipts, and the next run does not ask for them again.  ``context``
        is what every request tells of the project (its name without it).
        """
        self._need_grading()
        if cap is not None and cap <= 0:
            raise ValueError("cap must be positive or None")
        said, facts, links = self._mine("events"), self._mine("facts"), self._mine("links")
        statements = said.select("project", "session_id", "seq", "role", "text", "graded_at")
        scratch = Scratch(self.spark)
        work = ds.pending_work(statements, scratch.put, cap if cap is not None else 1 << 40)
        if work[1].where("selected").isEmpty() and facts.where("status = 'ask'").isEmpty():
            return {"events_graded": 0}
        run_id = self._open_run("distill", now)
        try:
            told = json.dumps(context or {"name": self.project}, sort_keys=True, separators=(",", ":"))
            asking = self._journaled(judge or judges.normal_judge(), run_id, now, scratch.put)
            run = ds.plan_run(work, facts, links, asking, now, scratch.put, budget, told, self._mine("sources"))
            stats = ds.run_stats(run).first().asDict()
            expiry = run.expired.select(
                F.lit(run_id).cast("bigint").alias("run_id"), F.lit("fact").alias("subject_kind"), F.col("fact_id").cast("string").alias("subject_id"),
                F.lit("expiry").alias("question_id"), F.lit("choice").alias("type"), F.lit(self._chosen("retired")).alias("answer_json"), F.lit(now).alias("created_at"),
            )
            receipts = expiry.unionByName(questions.receipts(run.candidate_answers, "candidate", run_id, now))
            receipts = receipts.unionByName(questions.receipts(run.pair_answers, "pair", run_id, now))
            stamps = run.queue.where("selected").select("project", "id", F.lit(now).alias("graded_at"))
            kept = scratch.put(run.facts)
            self._log_run(
                run_id, "distill", now, now, stats, None,
                append={"judgments": self._receipt_ids(receipts, run_id), "grades": stamps, "sources": run.sources, **self._index_changes(kept)}, replace={"facts": kept, "links": run.links},
            )
            return stats
        except BaseException as error:
            self._log_run(run_id, "distill", now, now, None, type(error).__name__, append={"judgments": self._kept_receipts(run_id)})
            raise
        finally:
            scratch.drop()

    def _journaled(self, judge: judges.Judge, run_id: int, now: str, put) -> judges.JournalJudge:
        """The judge behind this project's journal of answers."""

        def keep(rows: DataFrame) -> None:
            kind = F.when(F.col("name").isin([q[0] for q in questions.PHASE_A]), "candidate").when(F.col("name").isin([q[0] for q in questions.PHASE_B]), "pair").otherwise("line")
            subject = F.when(kind == "pair", F.concat_ws(":", "event_id", F.col("fact_id").cast("string"))) if "fact_id" in rows.columns else F.lit(None)
            named = F.coalesce(subject, F.col("subject_id") if "subject_id" in rows.columns else F.lit(None))
            found = rows.select(
                F.lit(self.project).alias("project"), F.lit(run_id).cast("bigint").alias("run_id"), "key", kind.alias("subject_kind"), named.alias("subject_id"),
                F.col("name").alias("question_id"), "type", "answer", F.lit(now).alias("created_at"),
            )
            self.store.publish(append={"answers": found}, project=self.project)

        return judges.JournalJudge(judge, self._mine("answers").select("key", "answer"), keep, put)

    def _kept_receipts(self, run_id: int) -> DataFrame:
        """Receipts of the answers that came before a run failed."""
        rows = self._mine("answers").where(F.col("run_id") == run_id)
        return self._receipt_ids(rows.withColumnRenamed("answer", "answer_json").drop("project", "key"), run_id)

    def drain(self, now: str, judge: judges.Judge | None = None, cap: int = 50) -> list[dict]:
        """Capped runs until nothing is left that one would take; the counts of each."""
        runs = []
        while not runs or (runs[-1]["events_graded"] and runs[-1].get("events_deferred")):
            runs.append(self.distill(now, judge, cap))
        return runs

    @staticmethod
    def _chosen(choice: str) -> str:
        return json.dumps({"type": "choice", "choice": choice, "probabilities": {choice: 1.0}, "confidence": 1.0})

    # -- audit ---------------------------------------------------------------------

    def audit(self, text: str, judge: judges.Judge | None = None, now: str = "", budget: int = batching.BUDGET) -> "report.AuditReport":
        """Verdicts of a memory file's lines, with a run and receipts; a file without lines writes nothing.

        Lines that are a stored fact word for word are settled; the others are judged in
        batches, each with the same evidence: the newest facts and statements.
        """
        self._need_grading()
        lines = memory_file.memory_lines(self.spark.createDataFrame([("memory", text)], "path string, text string")).cache()
        total = lines.count()
        if not total:
            return report.AuditReport([], {k: 0 for k in gates.KEYWORDS})
        run_id, scratch = self._open_run("audit", now), Scratch(self.spark)
        try:
            facts = self._mine("facts").where("status = 'active'")
            anchored = au.anchors(lines, facts, []).cache()
            rest = au.unanchored(lines, anchored, ["number"])
            pool = au.evidence_pool(facts, self._mine("events")).orderBy("kind", "place").collect()  # seventy rows at most, oldest first
            pool = pool if anchored.count() < total else []
            evidence = sum(len(json.dumps(dict(zip(("id", "text"), (r["place"], r["text"]))))) + 1 for r in pool)
            chars = batching.entry_chars(number=F.col("number").cast("string"), section=F.col("section"), text=F.col("text"))
            sized = rest.withColumns({"all": F.lit(0), "chars": chars + questions.question_chars(questions.PHASE_C)})
            packed = batching.pack(sized, ["all"], "number", "chars", evidence, budget, scratch.put)
            subjects = packed.select(
                "batch_no", "position", "number", "chars", "text", F.concat(F.lit("line:"), F.col("number").cast("string")).alias("subject_id")
            ).withColumn("subject", F.col("subject_id"))
            ask = self._journaled(judge or judges.ColumnJudge(line=lambda t: judges.normal_line_answers()), run_id, now, scratch.put)
            own = lambda kind: [{"id": r["place"], "text": r["text"]} for r in pool if r["kind"] == kind]
            told = json.dumps({"name": self.project}, separators=(",", ":"))
            states = questions.line_states(packed, ["batch_no"], own("fact"), own("statement"), told)
            # what is known of a line depends on the evidence, too
            proof = hashlib.sha256(json.dumps([own("fact"), own("statement")]).encode()).hexdigest()
            subjects = subjects.withColumn("entry", F.concat_ws("|", F.lit(proof), "number", "text"))
            asked = questions.checked(ask.ask(questions.line_questions(subjects), states), questions.PHASE_C).cache()
            answers = questions.by_subject(asked, ["batch_no", "position", "number"], questions.PHASE_C)
            judged = lines.join(answers.withColumnRenamed("disposition_confidence", "confidence"), "number", "left")
            verdicts = au.line_verdicts(judged, anchored, ["number"]).orderBy("number").collect()  # a row a line of one file
            spent = batching.spend(asked, ["batch_no"], "chars", evidence).first()
            counts = {k: sum(v["keyword"] == k for v in verdicts) for k in gates.KEYWORDS}
            stats = {"api_calls": spent["api_calls"], "usage": spent["usage"], "lines_audited": total}
            stats |= {f"lines_{k.lower()}": n for k, n in counts.items()}
            receipts = self._receipt_ids(questions.receipts(asked, "line", run_id, now), run_id)
            self._log_run(run_id, "audit", now, now, stats, None, append={"judgments": receipts})
            n_facts = sum(r["kind"] == "fact" for r in pool)
            return report.AuditReport(verdicts, counts, run_id, spent["api_calls"], spent["usage"], n_facts, len(pool) - n_facts)
        except BaseException as error:
            self._log_run(run_id, "audit", now, now, None, type(error).__name__, append={"judgments": self._kept_receipts(run_id)})
            raise
        finally:
            lines.unpersist()
            scratch.drop()

    # -- decisions -----------------------------------------------------------------

    def resolve(self, fact_id: int, choice: str, now: str) -> None:
        """Settle an open ask of this project, with a run and a receipt."""
        facts, links = self._mine("facts"), self._mine("links")
        partners = [r["partner_id"] for r in lifecycle.contradicts_partners(facts, links).where(F.col("fact_id") == fact_id).orderBy("seq").collect()]
        facts, links = lifecycle.resolve(facts, links, fact_id, choice, now, self.project)
        run_id = self._open_run("resolve", now)
        receipt = [(run_id, "fact", str(fact_id), "resolution", "choice", self._chosen(choice), now)]
        names = "run_id bigint, subject_kind string, subject_id string, question_id string, type string, answer_json string, created_at string"
        receipts = self._receipt_ids(self.spark.createDataFrame(receipt, names), run_id)
        stats = {"resolution": choice, "fact_id": fact_id, "partner_ids": partners}
        scratch = Scratch(self.spark)
        try:
            facts = scratch.put(facts)
            append = {"judgments": receipts, **self._index_changes(facts)}
            self._log_run(run_id, "resolve", now, now, stats, None, append=append, replace={"facts": facts, "links": links})
        finally:
            scratch.drop()

    # -- reading -------------------------------------------------------------------

    def status(self) -> dict:
        counts = lifecycle.status_counts(self._mine("events")).first()
        facts = {r["status"]: r["n"] for r in lifecycle.fact_status_counts(self._mine("facts")).collect()}
        last = lifecycle.last_run(self._mine("runs").select("project", "id", "kind", "started_at", "stats", "error"), ["project"]).first()
        out = {
            "events": counts["events"] if counts else 0,
            "pending": counts["pending"] if counts else 0,
            "facts": facts,
            "last_run": last.asDict() if last else None,
        }
        if self.log:
            out |= status_log.read_log(self.spark, self.log).first().asDict()
        return out

    def recall(self, limit: int = 12) -> DataFrame:
        return lifecycle.recall_topk(self._mine("facts"), limit)

    def search(self, query: str, limit: int = 5) -> DataFrame:
        """At most ``limit`` (1 to 25) facts like the query, most alike first, by the kept index."""
        limit = max(1, min(SEARCH_LIMIT, limit))
        asked = self.spark.createDataFrame([(self.project, 0, query)], "project string, query_id int, query string")
        facts = self._mine("facts")
        top = search_index.topk(asked, self._index(), max(10, 2 * limit))
        found = retrieval.retrieve_similar(asked, facts, keep=limit, top=top)
        return found.join(facts, "fact_id").orderBy("place")

    def fact(self, fact_id: int) -> DataFrame:
        return self._mine("facts").where(F.col("fact_id") == fact_id)

    def memory(self) -> tuple[DataFrame, DataFrame]:
        """Facts in the memory file's order, and open asks."""
        facts = self._mine("facts")
        return lifecycle.memory_order(facts), lifecycle.open_asks(facts, self._mine("links")).orderBy("fact_id")

    def _memory_lines(self, now: str | None) -> DataFrame:
        facts = self._mine("facts")
        sessions = lifecycle.sessions_by_fact(self._mine("facts"), self._mine("sources"), self._mine("events"))
        told = facts.join(sessions, ["project", "fact_id"], "left")
        return memory_sink.memory_file_lines(told, lifecycle.open_asks(facts, self._mine("links")), now)

    def memory_text(self, now: str | None = None) -> str:
        """The memory file as a string; write_memory() is for files that the driver should not hold."""
        lines = self._memory_lines(now).orderBy(*memory_sink.ORDER).select("line")
        return "".join(r["line"] + "\n" for r in lines.toLocalIterator())

    def write_memory(self, path: str, now: str | None = None, force: bool = False) -> None:
        """Write the memory file from Spark; a file that this engine did not make is kept unless forced."""
        memory_sink.write_file(self._memory_lines(now), path, force)
