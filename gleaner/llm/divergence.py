"""Audit how sources of one language diverge: distances between sources, and the terms a source overuses.

A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased.  A language
keeps the terms that enough of its documents have.  A group (language, source) has a smoothed
share of each kept term in whole parts of ``UNIT``; so has the language.  All arithmetic is on
integers, products on decimals.

* Counts: a map finds each batch's distinct terms (compared by their bytes) and yields its
  counts and documents by group and term; Spark sums them before and after the shuffle.
* ``term``: the terms of a group by how far their share exceeds the language's.  That excess
  grows with the group's count and falls with the language's, and ties go to the earlier term.  So a
  term is out once ``k`` others have at least its group count, at most its language count, and
  stand earlier.  Partitions of the counts keep their terms that fewer than ``k`` others of the
  partition dominate (a skyband); skybands merge into fewer ones, and what is left is ranked exactly.
* ``pair``: the sum over kept terms of the difference of shares.  Terms that neither of two
  sources has add the same difference each; for the others, tasks hold a block of sources by
  a part of the terms as matrices and add up differences row against row.

Defined edge cases: null text, language and source count as empty strings; a group without
terms still has its pairs; a language that keeps no term has distances of 0 and no terms; rows that
repeat are documents of their own; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.kernels import frugal, gather, give_back, slices, text_bytes, words
from gleaner.llm.session import Tables, prepare, written

#: Documents of a language that a kept term has, words added to each count, parts of a share.
MIN_DOCS, SMOOTH, UNIT = 30, 5, 1_000_000_000
#: Terms reported for a group.
TOP = 50
#: Bytes of text that are counted at once.
BLOCK = 1 << 22
#: Cells of a matrix of shares, and sources of one of its blocks.
CELLS, SOURCES = 1 << 21, 256
#: Skybands are merged within so many parts of a group before they are ranked.
MERGES = 8

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _block_counts(langs: pa.Array, sources: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Counts and documents of each term of each group of one block of texts."""
    # both names are coded apart and joined as one number
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    n_source = max(1, len(source.dictionary))
    group = lang.indices.to_numpy().astype(np.int64) * n_source + source.indices.to_numpy()
    starts, ends, first = words(data, offsets, _SEPARATOR)
    lens = ends - starts
    body = _LOWER[gather(data, starts, lens)]
    at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)])
    coded = column.dictionary_encode()
    width = max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    keys, times = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
    doc, term = np.divmod(keys, width)
    keys, place = np.unique(group[doc] * width + term, return_inverse=True)
    n = np.bincount(place, times, len(keys)).astype(np.int64)
    docs = np.bincount(place, minlength=len(keys)).astype(np.int64)
    group, term = np.divmod(keys, width)
    take = lambda d, i: d.take(pa.array(i))
    terms = coded.dictionary.cast(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [take(lang.dictionary, group // n_source), take(source.dictionary, group % n_source), take(terms, term), pa.array(n), pa.array(docs)],
        ["lang", "source", "term", "n", "docs"],
    )


def term_counts(df: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of columns lang, source, text."""

    def run(batches):
        for batch in batches:
            langs, sources = (batch.column(i).cast(pa.string()) for i in (0, 1))
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, BLOCK):
                out = _block_counts(langs.slice(a, b - a), sources.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield from (out.slice(i, 50_000) for i in range(0, out.num_rows, 50_000))

    found = df.select("lang", "source", "text").mapInArrow(frugal(run), _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * v))."""
    above = (count + SMOOTH).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(12,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", above, (total + SMOOTH * v).cast("decimal(20,0)"))


def skyband(n: np.ndarray, total: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Places of the terms that fewer than ``k`` others dominate.

    One dominates another with at least its count ``n``, at most its ``total`` and an earlier
    place in ``term`` (ranks of the terms' bytes).  It is enough to count dominators among
    terms that are kept: of a term's dominators the first ``k``, in any order that puts
    dominators first, have fewer than ``k`` themselves.
    """
    order = np.lexsort((term, total, -n))
    n, total, term = n[order], total[order], term[order]
    kept_total, kept_term, out = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    size = 256
    for i in range(0, len(order), size):
        # all that can dominate a term stand before it; those of its own block are counted among each other
        t, w = total[i : i + size], term[i : i + size]
        by = np.zeros(len(t), np.int64)
        for j in range(0, len(kept_total), 1 << 14):
            a, b = kept_total[j : j + (1 << 14)], kept_term[j : j + (1 << 14)]
            by += ((a[None, :] <= t[:, None]) & (b[None, :] < w[:, None])).sum(axis=1)
        live = np.flatnonzero(by < k)
        t, w, by = t[live], w[live], by[live]
        beats = (t[None, :] <= t[:, None]) & (w[None, :] < w[:, None]) & (np.arange(len(t))[None, :] < np.arange(len(t))[:, None])
        by = by + beats.sum(axis=1)
        # a term counted here may itself be out; then its own k dominators stand for it
        good = by < k
        out.append(order[i : i + size][live[good]])
        kept_total, kept_term = np.concatenate([kept_total, t[good]]), np.concatenate([kept_term, w[good]])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _skyband_of(table: pa.Table, k: int) -> pa.Table:
    term = table.column("term").combine_chunks().cast(pa.binary())
    rank = np.empty(len(term), np.int64)
    rank[pc.sort_indices(term).to_numpy()] = np.arange(len(term))
    return table.take(pa.array(skyband(table.column("n").to_numpy(), table.column("total").to_numpy(), rank, k)))


_BAND = "lang string, source string, term string, n bigint, total bigint, p bigint, q bigint"


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """Rows of ``_BAND`` that may be among the ``k`` first of their group: skybands of
    each partition, by group, then of ``MERGES`` parts of each group."""

    def partition(batches):
        # parts of a partition have a bounded number of rows; a part's skyband holds for all of it
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 18:
                yield from bands(held)
                held, n = [], 0
        if held:
            yield from bands(held)

    def bands(held):
        table = pa.Table.from_batches(held)
        code = lambda c: table.column(c).combine_chunks().dictionary_encode()
        lang, source = code("lang"), code("source")
        group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            yield from _skyband_of(table.take(pa.array(own)), k).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        out = _skyband_of(table, k)
        give_back()
        return out

    found = rows.mapInArrow(frugal(partition), _BAND)
    part = F.pmod(F.xxhash64("term"), F.lit(MERGES)).alias("part")
    return found.groupBy("lang", "source", part).applyInArrow(merge, _BAND)


def _top_terms(rows: DataFrame, top: int) -> DataFrame:
    over = skybands(rows.where("p > q"), top)
    value = F.col("p") - F.col("q")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)


def _differences(held: pa.Table, base: pa.Table) -> pa.Table:
    """Sums of differences of shares over one part of the terms, of two blocks of sources.

    ``base`` has each source's place, block side and share of a term it doesn't have; ``held``
    has (place, term, p) of the terms.  Per pair: the sum over this part's terms of
    |p - p'| - |base - base'|, so that terms which neither has add nothing.
    """
    place, side, zero = (base.column(c).to_numpy() for c in ("place", "side", "zero"))
    at = np.argsort(place)
    place, side, zero = place[at], side[at], zero[at]
    row = np.searchsorted(place, held.column("place").to_numpy())
    _, col = np.unique(held.column("key").to_numpy(), return_inverse=True)
    shares = np.repeat(zero[:, None], int(col.max()) + 1 if len(col) else 0, axis=1)
    shares[row, col] = held.column("p").to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    a, b, total = [], [], []
    for i in left.tolist():
        others = right[right > i]
        if len(others):
            apart = np.abs(shares[others] - shares[i]).sum(axis=1) - shares.shape[1] * np.abs(zero[others] - zero[i])
            a.append(np.full(len(others), place[i])), b.append(place[others]), total.append(apart)
    joined = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
    langs = pa.array([base.column("lang")[0].as_py()] * sum(map(len, a)), pa.string())
    return pa.table([langs, joined(a), joined(b), joined(total)], ["lang", "a", "b", "apart"])


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair``: groups has lang, source, place, zero, v; shares has lang, place, term, p."""
    side = F.floor(F.col("place") / SOURCES).cast("int")
    blocks = F.floor((F.col("sources") - 1) / SOURCES).cast("int")
    # every part of a language's terms has so few that a matrix of two blocks stays small
    parts = F.greatest(F.lit(1), F.ceil(F.col("v") * F.least(F.col("sources"), F.lit(2 * SOURCES)) / CELLS)).cast("int")
    sized = groups.withColumns({"block": side, "blocks": blocks, "parts": parts})
    # a block meets itself and every other block of its language: once as the first (side 0), once as
    # the second (side 1); with itself it is both (side 2)
    met = F.explode(F.sequence(F.lit(0), F.col("blocks")))
    base = sized.withColumn("other", met).withColumn("of", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met_as = lambda d: d.select(
        "*",
        F.least("block", "other").alias("x"),
        F.greatest("block", "other").alias("y"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    base = met_as(base).select("lang", "x", "y", "of", "place", "side", "zero")
    terms = shares.withColumn("key", F.xxhash64("term")).withColumn("of", F.pmod("key", "parts").cast("int"))
    terms = terms.withColumns({"block": side, "other": F.explode(F.sequence(F.lit(0), blocks))})
    terms = met_as(terms).select(F.col("lang").alias("l"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("of").alias("o"), "place", "term", "p")

    def apart(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _differences(left.append_column("key", _codes(left)), right)
        give_back()
        return out

    sums = terms.groupBy("l", "bx", "by", "o").cogroup(base.groupBy("lang", "x", "y", "of")).applyInArrow(apart, "lang string, a bigint, b bigint, apart bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("apart").alias("apart"))
    named = lambda at: groups.select("lang", F.col("place").alias(at), *[F.col(c).alias(f"{c}_{at}") for c in ("source", "zero")])
    both = sums.join(named("a"), ["lang", "a"]).join(named("b"), ["lang", "b"]).join(groups.select("lang", "v").distinct(), "lang")
    both = both.withColumn("value", F.col("apart") + F.col("v") * F.abs(F.col("zero_a") - F.col("zero_b")))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    both = both.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _codes(table: pa.Table) -> pa.Array:
    """Numbers of the table's distinct terms."""
    return table.column("term").combine_chunks().dictionary_encode().indices.cast(pa.int64())


def audit_sources(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    tables = Tables(prepare(df.sparkSession))
    own = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = tables.written(term_counts(own))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = tables.written(kept.drop("docs"))
    used = tables.written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    groups = own.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["size", "v", "lang_size"])
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("size"), F.greatest("v", F.lit(1)))).otherwise(F.lit(0).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1
    groups = groups.withColumns({"zero": zero, "place": place, "sources": F.count("*").over(Window.partitionBy("lang"))})
    groups = tables.written(groups)
    rows = used.join(groups, ["lang", "source"])
    rows = rows.withColumns({"p": share(F.col("n"), F.col("size"), F.col("v")), "q": share(F.col("total"), F.col("lang_size"), F.col("v"))})
    rows = tables.written(rows.select("lang", "source", "term", "n", "total", "p", "q", "place", "sources", "v", "zero"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    parts = F.greatest(F.lit(1), F.ceil(F.col("v") * F.least(F.col("sources"), F.lit(2 * SOURCES)) / CELLS)).cast("int")
    pairs = _pairs(rows.select("lang", "place", "term", "p", "sources", parts.alias("parts")), groups)
    terms = _top_terms(rows.select(*[c.split()[0] for c in _BAND.split(", ")]), top)
    found = written(pairs.select(columns).unionByName(terms.select(columns)))
    tables.drop()
    return found
