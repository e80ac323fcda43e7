"""Mix sources to target weights by entropy balancing.

A document is given a rate, how often the mix takes it.  Among all rates that take a
source's target of words, those nearest to one copy each (least relative entropy, no rate
over ``CAP``) have the form ``min(CAP, exp(m * size))`` with one multiplier ``m`` a source:
documents tilted exponentially by their size.  The multipliers solve a convex dual, whose
gradient and curvature are sums over documents; Spark takes them in every Newton round.

1. sizes: a map counts the words of each text; documents of one source and size have the same
   rate, so all later sums run over cells (source, size, documents);
2. targets: sources share all words by weight; those that would pass ``CAP`` times their size
   stop there, and the excess is shared again until none is above;
3. Newton rounds on the log of the words taken, each a sum over cells and one row a source
   of state.  A multiplier stays inside its bracket: a step that leaves it halves it;
4. rounding: going through a source's sizes from the largest, each cell's copies are rounded with
   what is owed from larger ones, so what is left over is about half of the smallest size.  A source
   has at most sqrt(2 * its words) sizes, so this is a bounded group;
5. copies inside a cell are shared out evenly, one more to the documents of the least hashes.
   A large cell is cut by hash into parts of ``PART`` documents on average.

Defined edge cases: a null text has size 0; documents of size 0 are taken 0 times; the null
source is a source of its own, after all others; a source of size 0 has the target 0; rows
that repeat are documents of their own; an empty table gives an empty result; other columns are
not read.  The same rows give the same result, however they are partitioned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.kernels import give_back
from gleaner.llm.session import Tables, prepare, written

#: Weights of sources in the order of their names, repeated.
WEIGHTS = (1, 2, 3)
#: Copies of a document at most.
CAP = 3
#: Newton rounds at most, and the relative error of the words taken that ends them.
ROUNDS, TOLERANCE = 60, 1e-7
#: Parts of a copy in which rates are summed, for words and for their slope.
WORD_UNIT, SLOPE_UNIT = 1e12, 1e6
#: Documents of one window when copies are shared out.
PART = 20_000


def sizes(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """doc_id, source, size in words, and a hash that orders documents of one size."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
        F.xxhash64(F.col(key).cast("bigint"), body).alias("h"),
    )


def _numbered(names: DataFrame, tables: Tables) -> DataFrame:
    """``names`` (source first) with their rank from 0 by code point, null last, without gathering them."""
    order = F.col("source").asc_nulls_last()
    placed = tables.written(names.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    # a row for each range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return placed.withColumn("inside", inside).join(counts, "part").withColumn("place", F.col("before") + F.col("inside") - 1).drop("part", "before", "inside")


def targets(cells: DataFrame, tables: Tables, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target of each source."""
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = tables.written(_numbered(totals, tables).withColumn("weight", weight))
    # the level: a word of weight that the sources below their cap get
    top = F.col("source_size") * cap
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, closed = 0.0, -1
    while True:
        at_cap = F.col("weight") * level >= top if closed >= 0 else F.lit(False)
        n, taken, open_weight = sources.agg(
            F.count(F.when(at_cap, 1)), F.coalesce(F.sum(F.when(at_cap, top)), F.lit(0)), F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == closed or not open_weight:
            break
        closed, level = n, (total - taken) / open_weight
    return sources.select("source", "source_size", F.least(top.cast("double"), F.col("weight") * level).alias("target"))


def _rate(m: Column, z: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(m * z, F.lit(50.0))))


def solve(cells: DataFrame, goals: DataFrame, tables: Tables, cap: int = CAP) -> DataFrame:
    """source, mean, m: the rate of a document of a source is ``min(cap, exp(m * size / mean))``.

    Null where all documents are taken ``cap`` times, or none.
    """
    sums = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(sums.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap)
    nothing = F.lit(None).cast("double")
    state = state.where(open_).select("source", "target", "mean", F.lit(0.0).alias("m"), nothing.alias("low"), nothing.alias("high"), F.lit(False).alias("done"))
    state = tables.written(state)
    for _ in range(ROUNDS):
        z = F.col("size") / F.col("mean")
        rate = _rate(F.col("m"), z, cap)
        whole = lambda c, digits: c.cast(f"decimal({digits},0)")
        # sums of whole numbers: the same whatever the order, so reruns take the same steps
        words = whole(F.col("size") * F.col("n"), 20) * whole(F.round(rate * WORD_UNIT), 13)
        squares = whole(whole(F.col("size"), 10) * whole(F.col("size") * F.col("n"), 20), 28)
        slope = F.when(rate < cap, squares * whole(F.round(rate * SLOPE_UNIT), 7)).otherwise(F.lit(0).cast("decimal(36,0)"))
        active = state.where("NOT done").withColumnRenamed("source", "_source")
        step = cells.join(active, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(
            F.greatest(F.sum(words).cast("double") / WORD_UNIT, F.lit(1e-9)).alias("words"),
            (F.sum(slope).cast("double") / SLOPE_UNIT / F.first("mean")).alias("slope"),
        )
        # Newton on log(words) = log(target); words grow with m, so each side of the target is a bound
        off = F.log(F.col("words")) - F.log(F.col("target"))
        low = F.when(off < 0, F.col("m")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("m")).otherwise(F.col("high"))
        newton = F.col("m") - F.when(F.col("slope") > 0, off * F.col("words") / F.col("slope"))
        # without a bound on its side a step is held to a doubling, and with both it stays between them
        reach = 1 + 2 * F.abs(F.col("m"))
        held = F.greatest(F.least(F.coalesce(newton, F.col("m") - F.signum(off) * reach), F.col("m") + reach), F.col("m") - reach)
        half = (low + high) / 2
        moved = F.when(low.isNotNull() & high.isNotNull() & ((held <= low) | (held >= high)), half).otherwise(held)
        good = F.abs(off) <= TOLERANCE
        joined = active.join(step, F.col("_source").eqNullSafe(F.col("source"))).select(
            "source", "target", "mean", F.when(good, F.col("m")).otherwise(moved).alias("m"), low.alias("low"), high.alias("high"), good.alias("done")
        )
        fresh = tables.written(joined.unionByName(state.where("done")))
        tables.drop(state)
        state = fresh
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("source", "mean", "m")


_COPIES = "source string, size bigint, copies bigint"


def _diffuse(size: np.ndarray, n: np.ndarray, rate: np.ndarray, target: float, cap: int) -> np.ndarray:
    """Whole copies of each cell, sizes descending, whose words come as near to the target as the sizes allow."""
    wanted = rate * n
    # any error of the rates themselves is owed, too
    owed = target - float((wanted * size).sum())
    out = np.zeros(len(size), np.int64)
    for i, (s, k, most) in enumerate(zip(size.tolist(), wanted.tolist(), (n * cap).tolist())):
        exact = k + owed / s
        out[i] = min(most, max(0, int(np.floor(exact + 0.5))))
        owed += (k - int(out[i])) * s
    # what smaller sizes could not take up goes back to larger ones while that brings it nearer
    for i in range(len(size) - 1, -1, -1):
        s = int(size[i])
        change = int(np.floor(owed / s + 0.5))
        change = min(int(n[i]) * cap - int(out[i]), max(-int(out[i]), change))
        if change and abs(owed - change * s) < abs(owed):
            out[i] += change
            owed -= change * s
    return out


def cell_copies(cells: DataFrame, goals: DataFrame, rates: DataFrame, cap: int = CAP) -> DataFrame:
    """source, size, copies: whole copies of all documents of a cell together."""
    cells = cells.where("size > 0")
    all_ = cells.join(goals.withColumnRenamed("source", "_g"), F.col("source").eqNullSafe(F.col("_g")))
    all_ = all_.join(rates.withColumnRenamed("source", "_r"), F.col("source").eqNullSafe(F.col("_r")), "left")
    full = F.when(F.col("target") > 0, float(cap)).otherwise(0.0)
    rate = F.when(F.col("m").isNull(), full).otherwise(_rate(F.col("m"), F.col("size") / F.col("mean"), cap))
    rows = all_.select("source", "size", "n", rate.alias("rate"), "target")

    def share(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending")])
        columns = [table.column(c).to_numpy() for c in ("size", "n", "rate")]
        copies = _diffuse(*columns, table.column("target")[0].as_py(), cap)
        give_back()
        return pa.table([table.column("source"), table.column("size"), pa.array(copies)], ["source", "size", "copies"])

    return rows.groupBy("source").applyInArrow(share, _COPIES)


def mix_sources(
    df: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, text: str = "text", source: str = "source", key: str = "doc_id"
) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies * size) of each row."""
    tables = Tables(prepare(df.sparkSession))
    docs = tables.written(sizes(df, text, source, key))
    cells = tables.written(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = tables.written(targets(cells, tables, weights, cap))
    rates = solve(cells, goals, tables, cap)
    copies = cell_copies(cells, goals, rates, cap).withColumnsRenamed({"source": "_s", "size": "_z"})
    whole = tables.written(
        cells.join(goals.withColumnRenamed("source", "_g"), F.col("source").eqNullSafe(F.col("_g")))
        .join(copies, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
        .select("source", "size", "n", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))
    )
    # the documents of a large cell fall into parts by hash
    parts = F.ceil(F.col("n") / PART).cast("bigint")
    other = whole.withColumnsRenamed({"source": "_s", "size": "_z"})
    placed = docs.join(other, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("h"), parts))
    # documents of a part, and how many of the cell's spare copies the parts before it have room for
    large = placed.where(F.col("n") > PART).groupBy("source", "size", "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    large = large.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    large = large.withColumnsRenamed({"source": "_s", "size": "_z", "part": "_p"})
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("part") == F.col("_p"))
    placed = placed.join(large, same, "left").drop("_s", "_z", "_p")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    spare = F.col("copies") % F.col("n")
    each = F.floor(F.col("copies") / F.col("n")).cast("bigint")
    one_more = (F.coalesce("before", F.lit(0)) + F.col("rank") <= spare).cast("bigint")
    out = placed.withColumn("rank", rank).withColumn("own", each + one_more)
    found = written(out.select("doc_id", "size", "source_size", "target", F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken")))
    tables.drop()
    return found
