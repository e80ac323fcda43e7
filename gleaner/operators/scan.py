"""Things that go along an ordered group, without one task that sees the whole group.

``running`` gives prefix sums from range partitions and their totals.  ``follow`` takes
a group cut into numbered nodes, each a map from the state it is entered in to the state
it is left in, and finds the states of all nodes: maps of ``FAN`` neighbours are composed
into one, these again, and so on; then the states go down the same tree.  A task holds the
maps of ``FAN`` nodes, whatever the length of the group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Nodes that are composed in one task.
FAN = 64


def running(df: DataFrame, by: list[str], order: list[str], put, **totals: str) -> DataFrame:
    """``df`` with a column for each of ``totals`` (its name, and that of a value): the sum of the value over
    the rows before it in its group.

    Rows are dealt by ranges of ``by`` and ``order``, so that a large group lies in many partitions;
    a row for each partition and group carries the sums over.  ``put`` writes and rereads, as
    ranges are drawn anew otherwise.  No null in ``by``; ``order`` tells rows of a group apart.
    """
    placed = put(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    so_far = lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_{name}") for name, v in totals.items()])
    earlier, inside = Window.partitionBy(*by).orderBy("_part"), Window.partitionBy(*by, "_part").orderBy(*order)
    parts = parts.select(*by, "_part", *[so_far(f"_{name}", earlier).alias(f"_{name}") for name in totals])
    own = placed.withColumns({name: so_far(v, inside) for name, v in totals.items()}).join(parts, [*by, "_part"])
    return own.withColumns({name: F.col(name) + F.col(f"_{name}") for name in totals}).drop("_part", *[f"_{name}" for name in totals])


def _arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _step(entry: np.ndarray, exit_: np.ndarray, count: np.ndarray, state: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States and totals after a node; a state that is past the end (-1) stays there."""
    at = np.searchsorted(entry, state)
    live = state >= 0
    known = (at < len(entry)) & (entry[np.minimum(at, len(entry) - 1)] == state)
    if (live & ~known).any():
        raise ValueError("a node is entered in a state that its map does not have")
    at = np.where(live, at, 0)
    return np.where(live, exit_[at], -1), total + np.where(live, count[at], 0)


def _nodes(table: pa.Table):
    """(node, entry, exit, count) of each node of a table of maps, in order."""
    node, entry, exit_, count = _arrays(table, "node", "entry", "exit", "count")
    order = np.lexsort((entry, node))
    node, entry, exit_, count = node[order], entry[order], exit_[order], count[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield int(node[a]), entry[a:b], exit_[a:b], count[a:b]


def follow(maps: DataFrame, starts: DataFrame, by: list[str], put) -> DataFrame:
    """(by, node, entry, count): the state in which each node is entered, and the counts before it.

    maps: by, node (from 0, without a gap), entry, exit, count; states are from 0, and -1 is
    past the end.  starts: by, entry of node 0.  Nodes after the end are left out.
    """
    types = {f.name: f.dataType.simpleString() for f in maps.schema}
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    numbers = "node bigint, entry bigint, exit bigint, count bigint"
    columns = [*by, "node", "entry", "exit", "count"]

    def compose(table: pa.Table) -> pa.Table:
        state, total, first = None, None, 0
        for node, entry, exit_, count in _nodes(table):
            if state is None:
                first, begin = node, entry
                state, total = exit_, count
            else:
                state, total = _step(entry, exit_, count, state, total)
        same = [pa.array([table.column(c)[0].as_py()] * len(begin), table.schema.field(c).type) for c in by]
        return pa.table([*same, pa.array(np.full(len(begin), first // FAN)), pa.array(begin), pa.array(state), pa.array(total)], columns)

    def descend(above: pa.Table, below: pa.Table) -> pa.Table:
        rows = []
        if above.num_rows and below.num_rows:
            state, total = np.array([above.column("entry")[0].as_py()]), np.array([above.column("count")[0].as_py()])
            for node, entry, exit_, count in _nodes(below):
                if state[0] < 0:
                    break
                rows.append((node, int(state[0]), int(total[0])))
                state, total = _step(entry, exit_, count, state, total)
        same = [pa.array([below.column(c)[0].as_py()] * len(rows), below.schema.field(c).type) for c in by]
        return pa.table([*same, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], [*by, "node", "entry", "count"])

    levels = [maps.select(*by, *[F.col(c).cast("bigint").alias(c) for c in columns[len(by) :]])]
    last = maps.agg(F.max("node")).first()[0] or 0
    while last > 0:
        parent = F.floor(F.col("node") / FAN).alias("_parent")
        levels.append(put(levels[-1].groupBy(*by, parent).applyInArrow(compose, f"{keys}, {numbers}")))
        last //= FAN
    found = starts.select(*by, F.lit(0).cast("bigint").alias("node"), F.col("entry").cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("count"))
    for level in reversed(levels[:-1]):
        renamed = found.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("node").alias("_node"), F.col("entry").alias("entry"), F.col("count").alias("count"))
        upper = renamed.groupBy(*[f"_{c}" for c in by], "_node")
        lower = level.groupBy(*by, F.floor(F.col("node") / FAN).alias("_parent"))
        found = upper.cogroup(lower).applyInArrow(descend, f"{keys}, node bigint, entry bigint, count bigint")
    return found
