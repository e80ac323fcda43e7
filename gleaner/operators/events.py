"""The event log and the work queue: identity, dedupe, context, candidates, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import chunking
from gleaner.functions.redaction import redact
from gleaner.functions.text import claim_norm, event_id

SPOKEN = ("user", "assistant")


def statements_of(conversations: DataFrame, projects: int = 4) -> DataFrame:
    """Turns as statements: project, session_id, seq, role, text."""
    return conversations.select(
        F.concat(F.lit("p"), F.pmod("conv_id", F.lit(projects)).cast("string")).alias("project"),
        F.col("conv_id").cast("string").alias("session_id"),
        (F.shiftleft(F.col("conv_id"), 20) + F.col("turn")).alias("seq"),
        "role",
        "text",
    )


def with_event_ids(statements: DataFrame) -> DataFrame:
    """Redacted text and the content hash that names the event."""
    safe = statements.withColumn("text", redact(F.col("text")))
    return safe.withColumn("id", event_id(F.col("session_id"), F.col("text")))


def dedupe_events(events: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """First row of each id, without the ids that the log has.

    A partial aggregate on the id keeps one row per task and id before the shuffle.
    """
    first = events.groupBy("id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "id"]), "seq").alias("row"))
    out = first.select("id", "row.*")
    return out if log is None else out.join(log.select("id"), "id", "left_anti")


def with_context(statements: DataFrame) -> DataFrame:
    """The two spoken turns before each one in its session, redacted and cut."""
    spoken = statements.where(F.col("role").isin(*SPOKEN))
    turn = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"))
    before = Window.partitionBy("project", F.coalesce("session_id", F.lit(""))).orderBy("seq")
    joined = F.concat_ws("\n\n", F.lag("_turn", 2).over(before), F.lag("_turn", 1).over(before))
    return spoken.withColumn("_turn", turn).withColumn("context", chunking.cut_context(redact(joined))).drop("_turn")


def candidates(statements: DataFrame) -> DataFrame:
    """Chunks of spoken turns with their context; ``ordinal`` is the chunk's place."""
    events = with_event_ids(with_context(statements))
    rows = events.select(
        "project",
        F.col("id").alias("event_id"),
        "session_id",
        "seq",
        "role",
        "context",
        F.posexplode(chunking.chunks(F.col("text"))).alias("ordinal", "text"),
    )
    return rows.where(chunking.keeps(F.col("text")))


def candidate_groups(found: DataFrame) -> DataFrame:
    """Candidates by normalised text and role; the first one represents a group.

    ``support`` is the number of its events; candidate_sources() names them.  Rows are combined by
    group and event first, so a sentence with a third of all rows is spread over its events.
    """
    place = F.struct("seq", "ordinal")
    group = ["project", "norm", "role"]
    by_event = (
        found.withColumn("norm", claim_norm(F.col("text")))
        .groupBy(*group, "event_id")
        .agg(F.min(place).alias("place"), F.min_by("text", place).alias("text"), F.min_by("context", place).alias("context"), F.count("*").alias("n"))
    )
    return by_event.groupBy(*group).agg(
        F.min_by("text", "place").alias("text"),
        F.min_by("event_id", "place").alias("event_id"),
        F.min_by("context", "place").alias("context"),
        F.min("place")["seq"].alias("first_seq"),
        F.min("place")["ordinal"].alias("first_ordinal"),
        F.sum("n").alias("occurrences"),
        F.count("*").alias("support"),
    )


def candidate_sources(found: DataFrame) -> DataFrame:
    """(project, norm, role, event_id): each event of each candidate group, a row an edge."""
    return found.select("project", claim_norm(F.col("text")).alias("norm"), "role", "event_id").distinct()


def queue_stops(found: DataFrame, cap: int) -> DataFrame:
    """(project, stop): the first event that the capped run of a project does not take.

    An event is taken while the groups covered before it plus its own new candidates stay
    within the cap.  The run stops at the event of the (cap + 1)-th group at the latest,
    so only the first cap + 1 groups of a project (a top-k that is taken per task first)
    and their events are looked at in order.
    """
    keyed = found.withColumn("norm", claim_norm(F.col("text")))
    group = ["project", "norm", "role"]
    firsts = keyed.groupBy(*group).agg(F.min("seq").alias("seq"))
    early = Window.partitionBy("project").orderBy("seq", "role", "norm")
    firsts = firsts.withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= cap + 1).drop("_n")
    fresh = keyed.select(*group, "seq").join(firsts, [*group, "seq"]).groupBy("project", "seq").agg(F.count("*").alias("fresh"))
    covers = firsts.groupBy("project", "seq").agg(F.count("*").alias("covers")).join(fresh, ["project", "seq"])
    before = Window.partitionBy("project").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.sum("covers").over(before), F.lit(0))
    return covers.withColumn("covered", covered).where(F.col("covered") + F.col("fresh") > cap).groupBy("project").agg(F.min("seq").alias("stop"))


def queue_selection(events: DataFrame, found: DataFrame, cap: int) -> DataFrame:
    """Events, and whether the capped run of their project takes them (see queue_stops)."""
    joined = events.join(queue_stops(found, cap), "project", "left")
    return joined.withColumn("selected", F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")


def session_closure(events: DataFrame) -> DataFrame:
    """Pending rows, and graded rows of sessions that have pending ones."""
    pending = events.where("graded_at IS NULL")
    busy = pending.where("session_id IS NOT NULL").select("project", "session_id").distinct()
    graded = events.where("graded_at IS NOT NULL").join(busy, ["project", "session_id"], "left_semi")
    return pending.unionByName(graded)


def graded(events: DataFrame, selected: DataFrame, now: str) -> DataFrame:
    """Stamp the selected events that have no stamp yet."""
    key = [c for c in ("project", "id") if c in events.columns and c in selected.columns]
    marked = events.join(selected.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    stamp = F.when(F.col("_hit"), F.coalesce("graded_at", F.lit(now))).otherwise(F.col("graded_at"))
    return marked.withColumn("graded_at", stamp).drop("_hit")
