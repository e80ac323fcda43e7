"""Markdown memory files: auditable lines with number, text and section."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import claim_text, strip
from gleaner.operators import scan
from gleaner.plans.scratch import Scratch
from gleaner.sources.transcripts import read_lines

#: Lines of a markdown file that make no claim.
HEADING = r"(?U)^ {0,3}#{1,6}(?:\s|$)"
RULE = r"^ {0,3}(?:[-*_][ \t]*){3,}$"
TABLE = r"(?U)^\s*\|.*\|\s*$"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
#: Line ends in the sense of a universal line splitter.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


#: The same without those that a reader of lines has taken already.
_OTHER_END = "[\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
#: Lines of a node, the part of a file that one task goes through.
NODE = 50_000


def memory_lines(files: DataFrame, put=None) -> DataFrame:
    """path, number, raw, text and section of the lines that make a claim.  files: path, text."""
    lines = files.select("path", F.posexplode(F.split("text", LINE_END)).alias("_at", "raw"))
    return claim_lines(lines.select("path", (F.col("_at") + 1).alias("number"), "raw"), put)


def read_memory_lines(spark: SparkSession, *paths: str, put=None) -> DataFrame:
    """The same of files, which are read by byte ranges."""
    put = put or Scratch(spark).put
    lines = read_lines(spark, *paths).withColumn("pieces", F.split("line", _OTHER_END))
    counted = scan.running(lines.withColumn("n", F.size("pieces").cast("bigint")), ["path"], ["line_no"], put, before="n")
    rows = counted.select("path", "before", F.posexplode("pieces").alias("at", "raw"))
    return claim_lines(rows.select("path", (F.col("before") + F.col("at") + 1).cast("int").alias("number"), "raw"), put)


def _fence_maps(table: pa.Table) -> pa.Table:
    """For each state that a node may be entered in, the state after its lines."""
    at, marks, closes = (x.tolist() for x in _fences(table))
    exits = [_after(state, marks, closes)[1] for state in range(3)]
    same = [pa.array([table.column(c)[0].as_py()] * 3, table.schema.field(c).type) for c in ("path", "node")]
    return pa.table([*same, pa.array([0, 1, 2]), pa.array(exits), pa.array([0, 0, 0])], ["path", "node", "entry", "exit", "count"])


def _fences(table: pa.Table):
    """(number, opening mark, closing mark) of lines that have one, in order; marks are 1 and 2, or 0."""
    order = np.argsort(table.column("number").to_numpy())
    return [table.column(c).to_numpy()[order] for c in ("number", "mark", "close")]


def _after(state: int, marks: list[int], closes: list[int]) -> tuple[list[int], int]:
    """The state after each line, and after all."""
    out = []
    for mark, close in zip(marks, closes):
        if state:
            state = 0 if close == state else state
        else:
            state = mark
        out.append(state)
    return out, state


def claim_lines(lines: DataFrame, put=None) -> DataFrame:
    """path, number, raw, text and section of the lines (path, number, raw) that make a claim.

    Whether a line is inside a code fence depends on all before it.  A node of lines maps the
    three states (outside, and inside a fence of either mark) to what they are after it; the maps
    are composed along the file (scan.follow), and then each node knows its own lines.  Only lines
    with a mark go through tasks.  The section is the last heading in the node or, a row a
    node, before it.
    """
    put = put or Scratch(lines.sparkSession).put
    bare = strip(F.col("raw"))
    mark = F.substring(F.regexp_extract("raw", FENCE, 1), 1, 1)
    rows = lines.withColumns(
        {
            "node": F.floor(F.col("number") / NODE),
            "mark": F.when(mark == "`", 1).when(mark == "~", 2).otherwise(0),
            "close": F.when(bare.rlike("^`+$"), 1).when(bare.rlike("^~+$"), 2).otherwise(0),
        }
    )
    rows = put(rows)
    fences = rows.where("mark > 0 OR close > 0").select("path", "node", "number", "mark", "close")
    # a node without marks is the map that changes nothing
    found = fences.groupBy("path", "node").applyInArrow(_fence_maps, "path string, node bigint, entry bigint, exit bigint, count bigint")
    nodes = rows.groupBy("path").agg(F.max("node").alias("last")).select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("node"))
    states = nodes.select("path", "node", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("entry"))
    maps = states.join(found, ["path", "node", "entry"], "left").select("path", "node", "entry", F.coalesce("exit", "entry").alias("exit"), F.lit(0).cast("bigint").alias("count"))
    starts = nodes.where("node = 0").select("path", F.lit(0).cast("bigint").alias("entry"))
    entries = put(scan.follow(put(maps), starts, ["path"], put).select("path", "node", "entry"))

    def inside(table: pa.Table) -> pa.Table:
        number, marks, closes = _fences(table)
        before = int(table.column("entry")[0].as_py())
        after, _ = _after(before, marks.tolist(), closes.tolist())
        path = pa.array([table.column("path")[0].as_py()] * len(number), table.schema.field("path").type)
        return pa.table([path, pa.array(number.astype(np.int64)), pa.array(np.array(after, np.int64))], ["path", "number", "after"])

    # lines between two marks have the state after the first one
    marked = fences.join(entries, ["path", "node"]).groupBy("path", "node").applyInArrow(inside, "path string, number bigint, after bigint")
    joined = rows.join(marked, ["path", "number"], "left").join(entries, ["path", "node"])
    in_node = Window.partitionBy("path", "node").orderBy("number")
    state = F.coalesce(F.last("after", ignorenulls=True).over(in_node.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "entry")
    earlier = F.coalesce(F.last("after", ignorenulls=True).over(in_node.rowsBetween(Window.unboundedPreceding, -1)), "entry")
    heading = F.col("raw").rlike(HEADING)
    title = F.nullif(strip(F.regexp_replace(bare, "^#+", "")), F.lit(""))
    placed = joined.withColumns({"state": state, "earlier": earlier}).where("state = 0 AND earlier = 0").where(F.length(bare) > 0)
    placed = placed.withColumn("head", F.when(heading, F.struct(title.alias("title"))))
    so_far = in_node.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = placed.where("head IS NOT NULL").groupBy("path", "node").agg(F.max_by("head", "number").alias("head"))
    along = Window.partitionBy("path").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    carried = nodes.join(heads, ["path", "node"], "left").select("path", "node", F.last("head", ignorenulls=True).over(along).alias("carried"))
    section = F.coalesce(F.last("head", ignorenulls=True).over(so_far), "carried")["title"]
    placed = placed.join(carried, ["path", "node"]).withColumn("section", section)
    claims = placed.where(~heading & ~F.col("raw").rlike(RULE) & ~F.col("raw").rlike(TABLE))
    return claims.withColumn("text", claim_text(F.col("raw"))).where("text != ''").select("path", "number", "raw", "text", "section")
