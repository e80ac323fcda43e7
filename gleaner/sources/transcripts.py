"""Transcript sources: JSON lines in three dialects, as DataFrames of statements.

Files are read by byte ranges as lines with their numbers, each line becomes a VARIANT,
and a dialect is a projection of it; there is no row-wise Python.  Lines that are not JSON
objects are reported by number.  NaN and duplicate keys, which some parsers accept,
count as malformed.
"""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import strip
from gleaner.plans.scratch import ship

DIALECTS = ("claude", "codex", "droid")
#: Transcript folders under a home, and their dialects.
ROOTS = ((".claude/projects", "claude"), (".codex/sessions", "codex"), (".factory/sessions", "droid"))
HEAD_BYTES = 65536

#: User texts of dialect 2 that a machine pushed, by prefix.
CODEX_PREFIXES = (
    "<environment_context>",
    "<subagent_notification>",
    "<skill>",
    "<heartbeat>",
    "<turn_aborted>",
    "# AGENTS.md instructions",
    "# Files mentioned by the user:",
    "<recommended_plugins",
    "<codex_internal_context",
    "<image name=",
    "</image>",
    "<user_shell_command>",
    ">>> TRANSCRIPT START",
    ">>> TRANSCRIPT END",
    ">>> APPROVAL REQUEST START",
    "You are running ",
    "You are a skill ",
    "You are the skill ",
    "You are a Senior Code Reviewer",
    "You are a sidecar reviewer",
    "You are sidecar ",
    "You are a focused read-only",
    "You are a read-only docs/code",
    "You are doing code quality review",
    "You are doing the Spec axis",
    "You are doing the Standards axis",
    "You are helping on ",
    "You are implementing ",
    "You are reviewing ",
    "You are analyzing /Users",
    "You are in /Users",
    "We are in /Users",
    "You are the Benchmark Claims Auditor",
    "You are the Cloudflare Deploy Agent",
    "You are the Competitor Tone Researcher",
    "You are the Release Gate Agent",
    "You are the Repo Cartographer",
    "You are the Spec reviewer",
    "You are the Standards reviewer",
    "You are the Task 5 SPEC COMPLIANCE reviewer",
    "You are the npm Release Agent",
    "PLEASE IMPLEMENT THIS PLAN:",
    "Repo: ",
    "cwd: ",
    "Read-only ",
    "READ-ONLY ",
    "Spec compliance review",
    "Code quality review",
    "Validate external ",
    "Research task:",
    "Research-only task",
    "Docs proof task:",
    "ZoomInfo docs/code",
)
CODEX_PATTERNS = (r"(?U)^\[\d+\] (?:user|assistant|tool exec call|tool exec result):",)

#: The same for dialect 3.
DROID_PREFIXES = (
    "<system-reminder",
    "<system-notification",
    "Background task ",
    "# Task Tool Invocation",
    "Monitor the active ",
    "OPERATIONAL health check",
    "Request interrupted",
    "Request cancelled",
    "Interrupted",
    "Unable to reach ",
    "BYOK Error:",
    "The AI model timed out",
    "The model repeatedly issued",
    '{"type":"bash_result',
    "# Follow-up Instructions",
    "Reply with exactly: ",
    "You are implementing ",
)
DROID_PATTERNS = (r"(?U)^Bounded r\d+ [^\n]* monitoring check", r'^Skill "[^"]+" activated')


def machine_pushed(text: Column, prefixes: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | text.startswith(prefix)
    for pattern in patterns:
        out = out | text.rlike(pattern)
    return out


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line_no (from 1) and line of text files; any newline style.

    Files are read by byte ranges, many tasks a file.  A line's number is its place in its range
    and the lines of the ranges before it, of which there is a row each.
    """
    rows = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("id")
    )
    # rows of a range follow each other in one partition, so their ids do, too
    ranges = rows.groupBy("path", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("path", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.join(starts, ["path", "range"])
    return numbered.select("path", (F.col("before") + F.col("id") - F.col("first") + 1).cast("int").alias("line_no"), "line")


def write_packed(lines: DataFrame, folder: str, order: str) -> None:
    """Write transcripts (path, line, and their order) many a file: each line behind its transcript's name and a tab.

    A file system pays for every file, so small transcripts by the hundred thousand are kept like
    this.  Names have no tab, lines no line break; a transcript lies in one file, its lines together.
    """
    placed = lines.repartition("path").sortWithinPartitions("path", order)
    placed.select(F.concat("path", F.lit("\t"), "line")).write.text(folder)


def read_packed(spark: SparkSession, *folders: str) -> DataFrame:
    """path (the transcript's name), line_no and line of what write_packed wrote, as read_lines gives them of files."""
    rows = read_lines(spark, *folders)
    rows = rows.select(F.col("path").alias("_file"), F.expr("substring(line, 1, locate('\t', line) - 1)").alias("path"), "line_no", F.expr("substring(line, locate('\t', line) + 1)").alias("line"))
    first = rows.groupBy("_file", "path").agg(F.min("line_no").alias("_first"))
    joined = rows.join(first, ["_file", "path"])
    return joined.select("path", (F.col("line_no") - F.col("_first") + 1).cast("int").alias("line_no"), "line")


def _listed(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """path, modificationTime and length of files, whose contents are not read."""
    files = spark.read.format("binaryFile").options(**options).load(list(paths))
    return files.select(F.col("_metadata.file_path").alias("path"), "modificationTime", "length")


def arrivals(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, arrived): when each file was last written."""
    return _listed(spark, paths).select("path", F.col("modificationTime").alias("arrived")).distinct()


def _head(path: str, most: int) -> bytes:
    """The first bytes of a file, and no more of it."""
    url = urlsplit(path)
    if url.scheme in ("", "file"):
        with open(unquote(url.path), "rb") as f:
            return f.read(most)
    files, place = pa.fs.FileSystem.from_uri(path)
    with files.open_input_file(place) as f:
        return f.read(most)


def heads(files: DataFrame, most: int = HEAD_BYTES) -> DataFrame:
    """``files`` (path, ...) with ``head``, their first bytes."""
    ship(files.sparkSession)
    place, names = files.columns.index("path"), [*files.columns, "head"]

    def run(batches):
        for batch in batches:
            # a batch of paths is cut, so that its heads stay bounded
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = pa.array([_head(p, most) for p in part.column(place).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{types}, head binary")


def dialects_of(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The files of each dialect; a row for each file comes to the driver."""
    first = read_lines(spark, *paths).where("line_no = 1")
    rows = first.select("path", detect_source(F.col("path"), F.col("line")).alias("dialect")).orderBy("path").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["dialect"], []).append(r["path"])
    return out


def roots(spark: SparkSession, home: str) -> DataFrame:
    """(root, source): where each dialect's program keeps its transcripts."""
    return roots_of(spark.createDataFrame([(home,)], "home string"))


def roots_of(homes: DataFrame) -> DataFrame:
    """(root, source) of each home."""
    each = F.explode(F.array(*[F.struct(F.lit(folder).alias("folder"), F.lit(source).alias("source")) for folder, source in ROOTS])).alias("r")
    return homes.select("home", each).select(F.concat_ws("/", "home", "r.folder").alias("root"), "r.source")


def pinned(lines: DataFrame) -> DataFrame:
    """(path, dialect) of a list with a path and a dialect on each line; ``#`` starts a comment."""
    bare = strip(F.regexp_replace("line", "#.*$", ""))
    parts = F.split(bare, r"\s+")
    return lines.where(F.length(bare) > 0).select(parts[0].alias("path"), F.try_element_at(parts, F.lit(2)).alias("dialect")).where(F.col("dialect").isin(*DIALECTS))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-empty lines with ``record`` (VARIANT, null if malformed) and ``ok``."""
    rows = lines.where(F.length(strip(F.col("line"))) > 0).withColumn("record", F.try_parse_json(strip(F.col("line"))))
    is_object = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    return rows.withColumn("ok", is_object).withColumn("record", F.when(is_object, F.col("record")))


def _string(path: str, of: str = "record") -> Column:
    """A string member; null where it is missing or another type."""
    value = F.try_variant_get(of, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(of, path, "string"))


def _kind(path: str, of: str = "record") -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(of, path, "variant")), F.lit("VOID"))


def _texts(content: str, block_types: tuple[str, ...], string_too: bool) -> Column:
    """Stripped non-empty texts of a content member, in order."""
    listed = F.try_variant_get("record", content, "array<variant>")
    texts = F.transform(
        F.filter(listed, lambda b: F.try_variant_get(b, "$.type", "string").isin(*block_types)),
        lambda b: F.when(
            F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")) == "STRING", F.try_variant_get(b, "$.text", "string")
        ),
    )
    found = F.when(_kind(content).startswith("ARRAY"), texts)
    if string_too:
        found = found.when(_kind(content) == "STRING", F.array(F.try_variant_get("record", content, "string")))
    stripped = F.transform(found, strip)
    return F.filter(stripped, lambda t: t.isNotNull() & (F.length(t) > 0))


def _statements(rows: DataFrame, source: str, role: Column, texts: Column, session: Column) -> DataFrame:
    return rows.select(
        "path",
        F.lit(source).alias("source"),
        "line_no",
        _string("$.timestamp").alias("ts"),
        role.alias("role"),
        session.alias("session_id"),
        F.posexplode(texts).alias("index", "text"),
    )


def _with_file_value(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The first string seen in each file, joined to its rows."""
    first = rows.where(value.isNotNull()).groupBy("path").agg(F.min_by(value, "line_no").alias(name))
    return rows.join(first, "path", "left")


def claude_statements(parsed: DataFrame) -> DataFrame:
    """Dialect 1: user and assistant lines with a message object."""
    rows = _with_file_value(parsed, _string("$.sessionId"), "file_session").where("ok")
    kind = _string("$.type")
    user = kind == "user"
    meta = F.coalesce(F.try_variant_get("record", "$.isMeta", "boolean"), F.lit(False)) & (_kind("$.isMeta") == "BOOLEAN")
    pushed = meta | F.coalesce(_string("$.promptSource") == "system", F.lit(False))
    pushed = pushed | F.coalesce(_string("$.origin.kind") == "task-notification", F.lit(False))
    rows = rows.where(kind.isin("user", "assistant") & _kind("$.message").startswith("OBJECT") & ~(user & pushed))
    role = F.coalesce(_string("$.message.role"), kind)
    session = F.coalesce(_string("$.sessionId"), F.col("file_session"))
    return _statements(rows, "claude", role, _texts("$.message.content", ("text",), True), session)


def codex_statements(parsed: DataFrame) -> DataFrame:
    """Dialect 2: response items that are messages; the session is the file's."""
    meta = F.when(_string("$.type") == "session_meta", _string("$.payload.session_id"))
    rows = _with_file_value(parsed, meta, "file_session").where("ok")
    role = _string("$.payload.role")
    rows = rows.where((_string("$.type") == "response_item") & (_string("$.payload.type") == "message") & role.isin("user", "assistant"))
    out = _statements(rows, "codex", role, _texts("$.payload.content", ("input_text", "output_text"), False), F.col("file_session"))
    return _renumbered(out, CODEX_PREFIXES, CODEX_PATTERNS)


def droid_statements(parsed: DataFrame) -> DataFrame:
    """Dialect 3: message rows that no hook made."""
    meta = F.when(_string("$.type") == "session_start", _string("$.id"))
    rows = _with_file_value(parsed, meta, "file_session").where("ok")
    role = _string("$.message.role")
    by_hook = ~_kind("$.message.hookEventName").isin("VOID")
    rows = rows.where((_string("$.type") == "message") & _kind("$.message").startswith("OBJECT") & ~by_hook & role.isin("user", "assistant"))
    out = _statements(rows, "droid", role, _texts("$.message.content", ("text",), True), F.col("file_session"))
    return _renumbered(out, DROID_PREFIXES, DROID_PATTERNS)


def _renumbered(statements: DataFrame, prefixes, patterns) -> DataFrame:
    """Without machine-pushed user texts; ordinals count what is left of a line."""
    kept = statements.where(~((F.col("role") == "user") & machine_pushed(F.col("text"), prefixes, patterns)))
    line = Window.partitionBy("path", "line_no").orderBy("index")
    return kept.withColumn("index", F.row_number().over(line) - 1)


PARSERS = {"claude": claude_statements, "codex": codex_statements, "droid": droid_statements}


def file_meta(parsed: DataFrame, dialect: str) -> DataFrame:
    """path, session_id, cwd and skipped of each file: the first string seen, and the malformed lines' numbers."""
    rows = parsed.where("ok")
    if dialect == "claude":
        session, cwd, own = _string("$.sessionId"), _string("$.cwd"), F.lit(True)
    elif dialect == "codex":
        session, cwd, own = _string("$.payload.session_id"), _string("$.payload.cwd"), _string("$.type") == "session_meta"
    else:
        session, cwd, own = _string("$.id"), _string("$.cwd"), _string("$.type") == "session_start"
    first = lambda value: F.min_by(value, F.when(own & value.isNotNull(), F.col("line_no")))
    found = rows.groupBy("path").agg(first(session).alias("session_id"), first(cwd).alias("cwd"))
    none = F.array().cast("array<int>")
    all_files = parsed.select("path").distinct().join(found, "path", "left").join(skipped_lines(parsed), "path", "left")
    return all_files.withColumn("skipped", F.coalesce("skipped", none))


def skipped_lines(parsed: DataFrame) -> DataFrame:
    """Numbers of malformed lines of each file."""
    return parsed.where(~F.col("ok")).groupBy("path").agg(F.array_sort(F.collect_list("line_no")).alias("skipped"))


def detect_source(path: Column, first_line: Column) -> Column:
    """Dialect by path, else by the first line; an unknown one is an error."""
    return (
        F.when(F.contains(path, F.lit("/.codex/")), "codex")
        .when(F.contains(path, F.lit("/.factory/")), "droid")
        .when(F.contains(path, F.lit("/.claude/")), "claude")
        .when(F.contains(first_line, F.lit('"session_meta"')), "codex")
        .when(F.contains(first_line, F.lit('"session_start"')), "droid")
        .when(F.contains(first_line, F.lit('"sessionId"')) | F.contains(first_line, F.lit('"type"')), "claude")
        .otherwise(F.raise_error(F.concat(F.lit("unknown transcript dialect: "), path)))
    )


def discover(spark: SparkSession, roots: list[str], project: str) -> DataFrame:
    """Transcripts whose first 64 KiB name the project, newest first; no more of a file is read."""
    files = _listed(spark, roots, recursiveFileLookup="true", pathGlobFilter="*.jsonl")
    # few bytes a row, so that many tasks share the reading
    spread = files.repartition(F.xxhash64("path"))
    hit = heads(spread).where(F.contains("head", F.encode(F.lit(project), "UTF-8")))
    return hit.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")


def payload_field(payload: Column, *keys: str) -> Column:
    """The first of several spellings of a member that is a non-empty string."""
    record = F.try_parse_json(payload)
    found = [F.nullif(F.try_variant_get(record, f"$.{k}", "string"), F.lit("")) for k in keys]
    return F.coalesce(*found)
