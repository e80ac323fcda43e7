"""Streaming ingest of transcripts into an engine's store.

A file stream brings whole transcripts; each micro-batch goes the way of a batch ingest:
parsed, redacted, hashed and appended without the ids that the log has.  The log itself is
the dedupe state, so it is unbounded and survives restarts.  A batch that fails does not end
the stream: its files are noted, and ``retry_failed`` (or the next stream) takes them again.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.redaction import redact
from gleaner.functions.text import event_id

if TYPE_CHECKING:
    from gleaner.plans.engine import Engine

ERRORS = "batch bigint, error string, detail string, paths array<string>, done boolean"


def in_order_of_arrival(found: DataFrame, files: DataFrame, first: int) -> DataFrame:
    """Parsed statements with ``seq``, dense from ``first``: by file as it arrived, then line and index.

    files: path, arrived.  The sums before each file are over one row a file.
    """
    sizes = found.groupBy("path").agg(F.count("*").alias("n")).join(files, "path")
    before = Window.orderBy("arrived", "path").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("path").orderBy("line_no", "index")
    return found.join(starts, "path").withColumn("seq", F.lit(first) + F.col("_start") + F.row_number().over(inside) - 1).drop("_start")


def statements_to_events(found: DataFrame, project: str, now: str) -> DataFrame:
    """Parsed and ordered statements as event rows."""
    safe = found.withColumn("text", redact(F.col("text")))
    return safe.select(
        F.lit(project).alias("project"),
        event_id(F.col("session_id"), F.col("text")).alias("id"),
        "source",
        "session_id",
        F.col("seq").cast("bigint").alias("seq"),
        "ts",
        "role",
        "text",
        F.lit(now).alias("created_at"),
        F.lit(None).cast("string").alias("graded_at"),
    )


def _note(spark: SparkSession, error_path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, ERRORS).coalesce(1).write.mode("append").json(error_path)


def failed_paths(spark: SparkSession, error_path: str) -> list[str]:
    """Files of failed batches that no later retry has taken."""
    try:
        rows = spark.read.schema(ERRORS).json(error_path)
    except AnalysisException:
        return []
    each = rows.select(F.explode("paths").alias("path"), "done")
    open_ = each.groupBy("path").agg(F.count_if("done").alias("taken"), F.count_if(~F.col("done")).alias("failed")).where("failed > taken")
    return sorted(r["path"] for r in open_.collect())


def retry_failed(engine: "Engine", dialect: str | None, error_path: str, now: str) -> int:
    """Ingest the files of failed batches again; returns how many went in."""
    paths = failed_paths(engine.spark, error_path)
    for path in paths:
        try:
            engine.ingest([path], dialect, now)
            _note(engine.spark, error_path, [(None, None, None, [path], True)])
        except Exception as error:  # noqa: BLE001  it stays noted, once more
            row = (None, type(error).__name__, str(error)[:500], [path])
            _note(engine.spark, error_path, [(*row, False), (*row, True)])
    return len(paths) - len(failed_paths(engine.spark, error_path))


def ingest_stream(engine: "Engine", folder: str, dialect: str | None, error_path: str, checkpoint: str, now: str) -> StreamingQuery:
    """Drain the folder's new transcripts into the engine's store and stop (start again to go on)."""
    retry_failed(engine, dialect, error_path, now)
    files = (
        engine.spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", "*.jsonl")
        .schema("value string")
        .load(folder)
        .select(F.col("_metadata.file_path").alias("path"))
    )

    def take(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.distinct().collect())  # a row for each new file
        try:
            if paths:
                engine.ingest(paths, dialect, now)
        except Exception as error:  # noqa: BLE001  an ingest must not end the session that feeds it
            _note(engine.spark, error_path, [(number, type(error).__name__, str(error)[:500], paths, False)])

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
