"""Greedy packing of judged items into request batches under a token budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import scan
from gleaner.plans.scratch import Scratch

BUDGET = 28_000
#: Budgets of a node, the part of a group that one task packs.
NODE = 16


def json_chars(text: Column) -> Column:
    """Length of a text as compact JSON with everything but printable ASCII escaped; null is ``null``.

    Two quotes, a character each, one more for a short escape, five more for a
    four-digit one and eleven more where that takes a surrogate pair.
    """
    more = lambda pattern, n: n * F.regexp_count(text, F.lit(pattern))
    short = more(r'["\\\x08\x0c\n\r\t]', 1)
    long_ = more(r"[\x00-\x07\x0b\x0e-\x1f\x7f-\x{ffff}]", 5)
    return F.coalesce(F.length(text) + 2 + short + long_ + more(r"[\x{10000}-\x{10ffff}]", 11), F.lit(4)).cast("bigint")


def entry_chars(**members: Column) -> Column:
    """Length of a compact JSON object with these string members."""
    keys = sum(len(k) + 4 for k in members) + 1  # quotes, colon, comma; the braces
    return sum((json_chars(v) for v in members.values()), F.lit(keys)).cast("bigint")


def tokens_of(chars: Column) -> Column:
    """Characters over four, rounded up."""
    return F.ceil(chars / 4).cast("bigint")


def _next_starts(size: np.ndarray, end: np.ndarray, most: int, facts: list | None, chars: list | None) -> np.ndarray:
    """For a batch that starts at each item, the item that the next one starts at.

    ``end`` are running sums of ``size``.  With ``facts``, lists of ids whose ``chars`` count
    once a batch, a window slides over the items: what fits from one item also fits from the next.
    """
    n = len(size)
    if facts is None:
        return np.searchsorted(end, end - size + most, side="right")
    out, used, held, j = np.zeros(n, np.int64), 0, {}, 0
    for i in range(n):
        while j < n:
            fresh = {f: c for f, c in zip(facts[j], chars[j]) if f not in held}
            if j > i and used + int(size[j]) + sum(fresh.values()) > most:
                break
            used += int(size[j]) + sum(fresh.values())
            for f in facts[j]:
                held[f] = held.get(f, 0) + 1
            j += 1
        out[i] = j
        used -= int(size[i])
        for f, c in zip(facts[i], chars[i]):
            held[f] -= 1
            if not held[f]:
                del held[f]
                used -= c
    return out


def _places(units: DataFrame, by: list[str], order: str, most: int, put=None) -> DataFrame:
    """batch_no and position of units (by, order, ``size``, and ``facts`` and ``fact_chars`` or nulls).

    A batch takes units in order while their sizes, and those of their distinct facts, stay
    within ``most``.  Where a batch starts depends on all before it, so running totals restart: a
    group is cut into nodes by its running size, each long enough that a batch that starts in
    one ends in the next at the latest; for every item that a batch might start at, a node says
    where the chain of batches leaves it and after how many (scan.follow).
    """
    put = put or Scratch(units.sparkSession).put
    types = {f.name: f.dataType.simpleString() for f in units.schema}
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    summed = put(scan.running(units, by, [order], put, before="size"))
    width = NODE * most
    node = F.floor(F.col("before") / width)
    own = summed.withColumns({"node": node, "ahead": F.lit(False)})
    # a node's first units are seen by the node before, too
    head = own.where((F.col("before") < F.col("node") * width + most) & (F.col("node") > 0)).withColumns({"node": F.col("node") - 1, "ahead": F.lit(True)})
    seen = put(own.unionByName(head))
    group = [*by, "node"]

    def chain(table: pa.Table):
        """(before, is ahead, next start) of a node's units in order; all numbers of the table."""
        table = table.sort_by("before")
        before, size, ahead = (table.column(c).to_numpy() for c in ("before", "size", "ahead"))
        lists = [None, None] if table.column("facts").null_count else [table.column(c).to_pylist() for c in ("facts", "fact_chars")]
        return table, before, int((~ahead).sum()), _next_starts(size, before + size, most, *lists)

    def maps(table: pa.Table) -> pa.Table:
        table, before, n, after = chain(table)
        at = table.column("node")[0].as_py()
        starts = before[:n]
        exit_, count = after[:n].copy(), np.ones(n, np.int64)
        while (inside := exit_ < n).any():  # pointers double until all leave the node
            count[inside] += count[exit_[inside]]
            exit_[inside] = exit_[exit_[inside]]
        state = np.append(before, -1)[exit_]
        use = starts < (at * width + most if at else 1)
        same = [pa.array([table.column(c)[0].as_py()] * int(use.sum()), table.schema.field(c).type) for c in by]
        rows = [np.full(int(use.sum()), at), starts[use], state[use], count[use]]
        return pa.table([*same, *map(pa.array, rows)], [*group, "entry", "exit", "count"])

    def place(table: pa.Table, entries: pa.Table) -> pa.Table:
        if not table.num_rows or not entries.num_rows:
            return table.slice(0, 0).select([*by, order]).append_column("batch_no", pa.array([], pa.int32())).append_column("position", pa.array([], pa.int32()))
        table, before, n, after = chain(table)
        i, number = int(np.searchsorted(before, entries.column("entry")[0].as_py())), entries.column("count")[0].as_py()
        first, batch, position = i, [], []
        while i < n:
            stop = int(after[i])
            batch.append(np.full(stop - i, number)), position.append(np.arange(stop - i))
            i, number = stop, number + 1
        taken = table.slice(first, i - first).select([*by, order])
        joined = lambda x: pa.array(np.concatenate(x).astype(np.int32))
        return taken.append_column("batch_no", joined(batch)).append_column("position", joined(position))

    made = put(seen.groupBy(*group).applyInArrow(maps, f"{keys}, node bigint, entry bigint, exit bigint, count bigint"))
    starts = summed.select(*by).distinct().withColumn("entry", F.lit(0).cast("bigint"))
    entries = scan.follow(made, starts, by, put)
    entries = entries.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("entry").alias("entry"), F.col("count").alias("count"))
    schema = f"{keys}, `{order}` {types[order]}, batch_no int, position int"
    return seen.groupBy(*group).cogroup(entries.groupBy(*[f"_{c}" for c in group])).applyInArrow(place, schema)


def _checked(units: DataFrame, size: Column, most: int) -> DataFrame:
    fine = F.when(size > most, F.raise_error(F.lit("an item is over the budget")).cast("boolean")).otherwise(F.lit(True))
    return units.where(fine)


def pack(items: DataFrame, by: list[str], order: str, chars: str, fixed_chars: int = 0, budget: int = BUDGET, put=None) -> DataFrame:
    """batch_no and position of each item, in order and within ``by``.

    A batch takes items while its characters (``fixed_chars`` and one more an item for
    the separator included) stay in the budget.  ``put`` writes and rereads intermediate
    tables (a Scratch of its own without it); so it is in pack_pairs.  A group that fits
    into one batch is that batch, and is numbered where it lies; only larger ones are cut into nodes.
    """
    most = budget * 4 - fixed_chars
    put = put or Scratch(items.sparkSession).put
    size = (F.col(chars) + 1).cast("bigint")
    totals = put(_checked(items, size, most).groupBy(*by).agg(F.sum(size).alias("_total")))
    place = Window.partitionBy(*by).orderBy(order)
    small = items.join(totals.where(F.col("_total") <= most).drop("_total"), by)
    small = small.withColumns({"batch_no": F.lit(0), "position": F.row_number().over(place) - 1})
    large = totals.where(F.col("_total") > most).drop("_total")
    if large.isEmpty():
        return small
    rest = items.join(large, by)
    none = F.lit(None).cast("array<bigint>")
    placed = _places(rest.select(*by, order, size.alias("size"), none.alias("facts"), none.alias("fact_chars")), by, order, most, put)
    return small.unionByName(rest.join(placed, [*by, order]).select(*small.columns))


def pack_pairs(plans: DataFrame, budget: int = BUDGET, put=None, fixed_chars: int = 0) -> DataFrame:
    """Batches of candidate-fact pairs that share one array of distinct facts.

    plans: project, ord, claim_chars, fact_id, fact_chars (a row for each pair).  Yields
    batch_no, i (candidate) and j (fact) positions; both start anew in each batch.
    """
    most = budget * 4 - fixed_chars
    put = put or Scratch(plans.sparkSession).put
    # read twice, and what gave the plans may have been a search
    pairs = put(plans.groupBy("project", "ord", "fact_id").agg(F.first("claim_chars").alias("claim_chars"), F.first("fact_chars").alias("fact_chars")))
    # a candidate has few pairs
    listed = F.array_sort(F.collect_list(F.struct("fact_id", F.col("fact_chars").cast("bigint").alias("chars"))))
    units = pairs.groupBy("project", "ord").agg(listed.alias("l"), F.first("claim_chars").alias("claim_chars"))
    size = (F.col("claim_chars") + F.size("l")).cast("bigint")
    units = units.select("project", "ord", size.alias("size"), F.col("l.fact_id").alias("facts"), F.col("l.chars").alias("fact_chars"))
    whole = F.col("size") + F.aggregate("fact_chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
    placed = _places(_checked(units, whole, most), ["project"], "ord", most, put)
    rows = pairs.select("project", "ord", "fact_id").join(placed, ["project", "ord"])
    # a batch lists its facts as they come up; it has no more of them than the budget holds
    batch = ["project", "batch_no"]
    known = rows.groupBy(*batch, "fact_id").agg(F.min("position").alias("_first"))
    known = known.withColumn("j", F.row_number().over(Window.partitionBy(*batch).orderBy("_first", "fact_id")) - 1)
    out = rows.join(known, [*batch, "fact_id"])
    return out.select("project", "ord", "fact_id", "batch_no", F.col("position").alias("i"), "j")


def spend(asked: DataFrame, batch: list[str], chars: str, fixed_chars: int = 0) -> DataFrame:
    """api_calls and usage: the batches, and the tokens sent in them and answered.

    asked: a row for each question, with ``chars`` of its state and an ``answer``.
    """
    sent = asked.groupBy(*batch).agg((F.sum(chars) + fixed_chars).alias("sent"), F.sum(json_chars(F.col("answer"))).alias("told"))
    return sent.agg(
        F.count("*").alias("api_calls"), F.coalesce(F.sum(tokens_of(F.col("sent")) + tokens_of(F.col("told"))), F.lit(0)).alias("usage")
    )
