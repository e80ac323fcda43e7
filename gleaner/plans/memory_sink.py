"""The memory file written by Spark: lines rendered as columns, ordered by ranges, parts joined on disk.

No line passes through the driver's memory; it only moves the bytes of finished parts, a
buffer at a time, where a single file is wanted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators.lifecycle import category_place
from gleaner.plans.report import SENTINEL, SentinelError

#: What lines are ordered by: block (head, category, asks), category, heading before facts, then the facts' order.
ORDER = ("block", "category", "kind", "significance", "confidence", "fact_id")
_LINE = "block int, category string, kind int, significance double, confidence double, fact_id bigint, line string"
_HEAD, _UNKNOWN, _ASKS = 0, 99, 100


def hundredths(x: Column) -> Column:
    """A number from 0 to 1 with two decimals; exact halves go to the even one.

    Scaling by a power of two is exact, so the remainder tells halves from what is next to them.
    """
    whole = F.lit(2.0**60)
    at = (x * whole).cast("bigint").cast("decimal(19,0)") * 100
    one = F.lit(1 << 60).cast("decimal(19,0)")
    rest = at % one
    low = ((at - rest) / one).cast("int")
    up = (rest > F.lit(1 << 59)) | ((rest == F.lit(1 << 59)) & (low % 2 == 1))
    n = low + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def fact_line(now: str | None) -> Column:
    """A fact's line; ``sessions`` may be null, then its support is told."""
    said = F.coalesce("last_supported_at", "created_at")
    at = tx.parse_stamp(said)
    stale = F.lit(False) if now is None else tx.is_stale(tx.parse_stamp(F.lit(now)), at)
    mark = F.when(F.col("verified_at").isNull() | (F.col("verified_at") == ""), " · unverified").otherwise(
        F.concat(F.lit(" · audit mark "), tx.vintage(tx.parse_stamp(F.col("verified_at"))))
    )
    seen = F.coalesce(F.concat(F.lit("seen in "), tx.plural(F.col("sessions"), "session")), F.concat(F.lit("seen "), tx.plural(F.col("support_count"), "time")))
    return F.concat(
        F.lit('- "'), tx.one_line(F.col("claim")), F.lit('" (`'), "category", F.lit(" · "), tx.significance_word(F.col("significance")),
        F.lit("` · confidence "), hundredths(F.col("confidence")), F.lit(" · "), seen, F.lit(" · said "), tx.vintage(at),
        F.when(stale, " · stale").otherwise(""), mark, F.lit(")"),
    )


def memory_file_lines(facts: DataFrame, asks: DataFrame, now: str | None = None) -> DataFrame:
    """(ORDER columns, line) of the memory file of one project, headings as rows of their own.

    facts: as in FACTS, with ``sessions`` (null if unknown); asks: see open_asks.  A line may
    have newlines in front of a heading.
    """
    at = category_place(F.col("category"))
    rows = facts.where("status = 'active' AND category != 'none'").withColumn("block", F.when(at == 0, _UNKNOWN).otherwise(at).cast("int"))
    columns = lambda block, category, kind, s, c, i, line: [
        F.lit(x).cast(t).alias(n) if not isinstance(x, Column) else x.cast(t).alias(n) for x, (n, t) in zip((block, category, kind, s, c, i, line), (f.split() for f in _LINE.split(", ")))
    ]
    body = rows.select(*columns(F.col("block"), F.col("category"), 1, -F.col("significance"), -F.col("confidence"), F.col("fact_id"), fact_line(now)))
    titles = rows.select("block", "category").distinct()
    heads = titles.select(*columns(F.col("block"), F.col("category"), 0, 0, 0, 0, F.concat(F.lit("\n## "), F.initcap("category"))))
    # the blank line under the title is a heading's, or stands alone in a file without facts
    top = F.concat(F.lit(f"{SENTINEL}\n# Memory"), F.when(F.col("n") == 0, "\n").otherwise(""))
    title = titles.agg(F.count("*").alias("n")).select(*columns(_HEAD, "", 0, 0, 0, 0, top))
    clip = lambda c: tx.clip(tx.squeeze(c), 200)
    ask = F.concat(F.lit("- #"), F.col("fact_id").cast("string"), F.lit(": "), clip(F.col("claim")), F.lit(" / "), clip(F.coalesce(F.nullif("partner_claim", F.lit("")), F.lit("-"))))
    open_ = asks.select(*columns(_ASKS, "", 1, 0, 0, F.col("fact_id"), ask))
    decide = asks.agg(F.count("*").alias("n")).where("n > 0").select(*columns(_ASKS, "", 0, 0, 0, 0, "\n## Needs a decision"))
    return title.unionByName(heads).unionByName(body).unionByName(decide).unionByName(open_)


def write_parts(lines: DataFrame, folder: str) -> None:
    """Text parts whose names are in the order of the lines."""
    lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("line").write.text(folder)


def _files(spark: SparkSession, path: str):
    """(file system, path) of a name; local files without checksum files beside them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs.getRawFileSystem() if fs.getScheme() == "file" else fs), where


def write_file(lines: DataFrame, path: str, force: bool = False) -> None:
    """The lines as one file; a file that is not a memory file is kept unless forced.

    The parts are written beside the target, joined into one file and renamed to it at the end.
    """
    spark = lines.sparkSession
    fs, target = _files(spark, path)
    if fs.exists(target) and not force and spark.read.text(path).where(F.contains("value", F.lit(SENTINEL))).isEmpty():
        raise SentinelError(path)
    tag = uuid.uuid4().hex
    folder, whole = f"{path}.{tag}.parts", f"{path}.{tag}.tmp"
    try:
        write_parts(lines, folder)
        _, joined = _files(spark, whole)
        conf, out = spark._jsc.hadoopConfiguration(), fs.create(joined)
        try:
            names = sorted(s.getPath().toString() for s in fs.listStatus(_files(spark, folder)[1]) if s.getPath().getName().startswith("part-"))
            for name in names:
                part = fs.open(_files(spark, name)[1])
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
        finally:
            out.close()
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(joined, target):
            raise OSError(f"cannot write {path}")
    finally:
        fs.delete(_files(spark, folder)[1], True)
        fs.delete(_files(spark, whole)[1], False)
