"""Versioned tables in Parquet: folders that are only ever added, and a log that names them.

A write puts each frame into a folder of its own and then logs them all under the next
version; the log rows are the last write.  ``append`` adds a folder to a table; ``replace``
makes it the only one of a table and project.  Readers take what is logged up to a
version, so a run that fails half-way leaves nothing to see, and one transcript or one
resolved ask costs what it writes, not the whole store.  One writer a store.

Grading stamps are a table of their own, joined to the events on reading; a run is
logged when it opens and again when it closes, and reads as its last row.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators import search_index

SCHEMA_VERSION = 4

EVENTS = "project string, id string, source string, session_id string, seq bigint, ts string, role string, text string, created_at string, graded_at string"
GRADES = "project string, id string, graded_at string"
FACTS = (
    "project string, fact_id bigint, claim string, category string, context string, significance double, confidence double, "
    "status string, support_count int, ask_seen_count int, created_at string, updated_at string, "
    "last_supported_at string, verified_at string, indexed boolean"
)
#: The events that say a fact, an edge a row; only ever added to.
SOURCES = "project string, fact_id bigint, event_id string"
LINKS = "project string, fact_id bigint, related_id bigint, relation string, seq bigint"
RUNS = "id bigint, project string, kind string, started_at string, finished_at string, stats string, error string"
JUDGMENTS = "id bigint, run_id bigint, subject_kind string, subject_id string, question_id string, type string, answer_json string, created_at string"
#: Answers as they came, by the key of their question, whatever became of the run.
ANSWERS = "project string, run_id bigint, key string, subject_kind string, subject_id string, question_id string, type string, answer string, created_at string"
MARKERS = "project string, enabled_at string"
SCHEMAS = {"events": EVENTS, "grades": GRADES, "facts": FACTS, "sources": SOURCES, "links": LINKS, "runs": RUNS, "judgments": JUDGMENTS, "answers": ANSWERS, "markers": MARKERS, **search_index.SCHEMAS}
_LOG = "version bigint, schema_version int, name string, project string, folder string, replaces boolean"


class SchemaVersionError(Exception):
    """The store has a schema that this code cannot use."""


def default_home() -> str:
    """Where stores are kept; GLEANER_HOME overrides it."""
    return os.environ.get("GLEANER_HOME") or os.path.join(os.path.expanduser("~"), ".gleaner")


def slug_of(project_dir: str) -> str:
    """Twelve hex digits that name a project's folder (the same as functions.text.project_slug)."""
    return hashlib.sha1(os.path.realpath(project_dir).encode()).hexdigest()[:12]


def store_path(project_dir: str, home: str | None = None) -> str:
    return f"{home or default_home()}/projects/{slug_of(project_dir)}"


class Store:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.schemas = SCHEMAS
        if read_only:
            log = self._log()
            if log is None:
                raise FileNotFoundError(f"no store at {root}")
            found = log.agg(F.max("schema_version")).first()[0]
            if found != SCHEMA_VERSION:
                raise SchemaVersionError(f"store has schema {found}, this code reads {SCHEMA_VERSION}")

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.root}/log")
        except AnalysisException:
            return None

    def _newest(self) -> tuple[int, int]:
        """The newest version and its schema; an empty store is at version 0 of this schema."""
        log = self._log()
        row = log.agg(F.max("version").alias("v"), F.max("schema_version").alias("s")).first() if log is not None else None
        if row is None or row["v"] is None:
            return 0, SCHEMA_VERSION
        if row["s"] > SCHEMA_VERSION:
            raise SchemaVersionError(f"store has schema {row['s']}, this code knows {SCHEMA_VERSION}")
        return row["v"], row["s"]

    def version(self) -> int:
        """The newest published version; 0 if there is none."""
        return self._newest()[0]

    def migrate(self) -> int:
        """Bring an older store to this schema; columns that it lacks read as null.

        Before schema 4 a fact's row had its sources as an array; they become edges.
        """
        version, found = self._newest()
        if found == SCHEMA_VERSION:
            return version
        append = {}
        if self._folders("facts", version):
            facts = self._read("facts", version, f"{FACTS}, source_event_ids array<string>")
            append["sources"] = facts.select("project", "fact_id", F.explode("source_event_ids").alias("event_id")).distinct()
        return self._write(version + 1, append, {}, None)

    def _parts(self, name: str, version: int) -> list[tuple[str, frozenset]]:
        """(folder, projects whose rows in it do not count) of a table.

        A folder of one project is out once that project's rows are replaced; one of several
        projects stays for the others.
        """
        rows = self._log().where((F.col("version") <= version) & (F.col("name") == name)).orderBy("version").collect()
        found: list = []
        for r in rows:  # a row for each write of the table
            own = r["project"]
            if r["replaces"]:
                found = [(p, f, out | {own}) for p, f, out in found if own is not None and p != own]
            found.append((own, f"{self.root}/{r['folder']}", frozenset()))
        return [(f, out if p is None else frozenset()) for p, f, out in found]

    def _folders(self, name: str, version: int) -> list[str]:
        return [f for f, _ in self._parts(name, version)]

    def _read(self, name: str, version: int, schema: str | None = None) -> DataFrame:
        """All rows of a table that has some, as they were written."""
        by_out: dict[frozenset, list[str]] = {}
        for folder, out in self._parts(name, version):
            by_out.setdefault(out, []).append(folder)
        frames = []
        for out, folders in by_out.items():
            df = self.spark.read.schema(T.StructType.fromDDL(schema or self.schemas[name])).parquet(*folders)
            frames.append(df.where(F.col("project").isNull() | ~F.col("project").isin(*sorted(out))) if out else df)
        return reduce(DataFrame.unionByName, frames)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest if none is given."""
        version = self.version() if version is None else version
        schema = T.StructType.fromDDL(self.schemas[name])
        if not version or not self._folders(name, version):
            return self.spark.createDataFrame([], schema)
        df = self._read(name, version)
        if name == "events":
            stamps = self.table("grades", version).groupBy("project", "id").agg(F.min("graded_at").alias("_stamp"))
            df = df.join(stamps, ["project", "id"], "left").withColumn("graded_at", F.coalesce("graded_at", "_stamp")).select(*schema.names)
        if name == "runs":
            last = F.max_by(F.struct(*schema.names), F.coalesce("finished_at", F.lit(""))).alias("r")
            df = df.groupBy("id").agg(last).select("r.*")
        return df

    def publish(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, project: str | None = None) -> int:
        """Write frames and log them as the next version.

        ``replace`` is for one project's rows, or with no project for the whole table.
        An older store is brought to this schema first.
        """
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        return self._write(self.migrate() + 1, append or {}, replace or {}, project)

    def _write(self, version: int, append: dict[str, DataFrame], replace: dict[str, DataFrame], project: str | None) -> int:
        rows = []
        for replaces, frames in ((False, append), (True, replace)):
            for name, df in frames.items():
                schema = T.StructType.fromDDL(self.schemas[name])
                columns = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
                folder = f"data/{name}/{uuid.uuid4().hex}"
                df.select(columns).write.parquet(f"{self.root}/{folder}")
                rows.append((version, SCHEMA_VERSION, name, project, folder, replaces))
        rows = rows or [(version, SCHEMA_VERSION, None, None, None, False)]
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return version

    def compact(self, name: str) -> int:
        """Rewrite a table that has many folders as one, for all projects together."""
        return self.publish(replace={name: self._read(name, self.version())})

    def vacuum(self) -> int:
        """Delete the folders that the newest version does not read; older versions can't be read after it.

        Returns how many there were.  What the log names stays until it is replaced, so a
        writer that is still running is safe as long as it is the only one.
        """
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        version = self.version()
        logged = self._log().where("folder IS NOT NULL").select("name", "folder").distinct().collect()  # a row for each write
        used = {f for name in {r["name"] for r in logged} for f in self._folders(name, version)}
        dead = [f"{self.root}/{r['folder']}" for r in logged if f"{self.root}/{r['folder']}" not in used]
        removed = 0
        for folder in dead:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            removed += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return removed
