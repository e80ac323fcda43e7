"""JSON-lines status logs: appended by jobs, read for the last ingest and error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(spark: SparkSession, path: str, **entry) -> bool:
    """Append one entry; a log that cannot be written is no reason to fail."""
    import json

    try:
        spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)
        return True
    except Exception:  # noqa: BLE001  logging must not stop the job that logs
        return False


def log_entries(lines: DataFrame) -> DataFrame:
    """ord, event, stamp and entry of well-formed lines (ord, line)."""
    record = F.try_parse_json("line")
    rows = lines.withColumn("entry", record).where(F.schema_of_variant("entry").startswith("OBJECT"))
    return rows.select(
        "ord",
        F.try_variant_get("entry", "$.event", "string").alias("event"),
        F.try_variant_get("entry", "$.ts", "string").alias("ts"),
        F.coalesce(F.try_variant_get("entry", "$.error", "string"), F.lit("")).alias("error"),
    )


def last_events(lines: DataFrame) -> DataFrame:
    """The newest ingest and the newest error of a log."""
    rows = log_entries(lines)
    return rows.agg(
        F.max_by("ts", F.when(F.col("event") == "ingest", F.col("ord"))).alias("last_ingest"),
        F.max_by("error", F.when(F.col("error") != "", F.col("ord"))).alias("last_error"),
    )


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """The newest ingest and error over one or more logs, by time and then by place in the file."""
    from pyspark.errors import AnalysisException

    lines = spark.createDataFrame([], "value string, path string")
    for path in paths:
        try:
            lines = lines.unionByName(spark.read.text(path).select("value", F.col("_metadata.file_modification_time").cast("string").alias("path")))
        except AnalysisException:  # no log yet
            continue
    record = F.try_parse_json("value")
    stamp = F.coalesce(F.try_variant_get(record, "$.ts", "string"), F.lit(""))
    return last_events(lines.select(F.struct(stamp.alias("ts"), "path").alias("ord"), F.col("value").alias("line")))


def first_object(candidates: list) -> dict | None:
    """The first JSON object among some texts (standard input, then arguments)."""
    import json

    for text in candidates:
        try:
            found = json.loads(text)
        except (TypeError, ValueError):
            continue
        if isinstance(found, dict):
            return found
    return None
