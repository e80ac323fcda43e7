"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items are words (runs of letters, digits and apostrophes, A-Z
lower-cased).  A seed is a fixed mask laid over consecutive words; the words under its
ones are hashed and those under its zeros ignored, so a seed still hits where a word was
substituted there.  Any good window (see below) of 13 to 25 words is hit by a mask,
wherever its substitutions are, and a longer one has a good window of that size in it.
Items of fewer than ``LEAST_WORDS`` words have seeds of their own length, one for each
choice of the words that may be substituted.
Hashes of all places of a text are looked up among the items' seeds; every hit names a
diagonal (an item laid on a place of the text).  A text is contaminated by an item when
any window of a diagonal has at least ``LEAST_WORDS`` words (or the whole item, if it is
shorter) and at least ``LEAST_EQUAL`` of them are equal; the window with the most equal
words, and of those a shortest, is the verified overlap.

The items are a stated query set: they go to every task in blocks of at most
``BLOCK_BYTES`` of text, one pass over the documents for each block.  With more than one
block each pass is written before the next block is read and its broadcast freed, so
neither the driver nor an executor ever holds more than one.  Documents are only
mapped; nothing about them is shuffled.

Defined edge cases: null and empty texts and items hit nothing; items too short for
one substitution are whole word sequences that have to be equal; repeated rows are
judged alike; empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.kernels import frugal, lower_table, mix, prefix_hash, slices, span_hash, text_bytes, words
from gleaner.llm.session import prepare, written
from gleaner.llm.sketch import split_by_map

#: Seed masks over consecutive words.
MASKS = ("11101101", "1101011011", "1011100111", "110010010111", "1111101", "100110111", "111111")
LEAST_WORDS, LEAST_EQUAL = 13, 0.8
BLOCK_BYTES = 4 << 20

_GAP = np.zeros(256, bool)
_GAP[[b for b in range(128) if not (chr(b).isalnum() or chr(b) == "'")]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's first word number (and the total)."""
    starts, ends, first = words(data, offsets, _GAP)
    return span_hash(prefix_hash(data, lower_table()), starts, ends), first


def seed_hashes(stream: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of a mask at all places where it lies inside one text."""
    span = len(mask)
    if len(stream) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(stream) - span + 1
    h = np.full(n, span, np.uint64)
    for i, one in enumerate(mask):
        if one == "1":
            h = h * _STEP + stream[i : n + i] + np.uint64(i)
    inside = np.ones(n + span, bool)
    for edge in first[1:-1].tolist():
        inside[max(0, edge - span + 1) : edge] = False
    places = np.flatnonzero(inside[:n])
    return mix(h[places]), places


def whole_masks(n: int) -> list[str]:
    """Masks of n words, with a zero for each word that may be substituted."""
    zeros = n * (10 - round(10 * LEAST_EQUAL)) // 10
    return ["".join("0" if i in z else "1" for i in range(n)) for z in combinations(range(n), zeros)]


def best_window(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """(begin, stop) of a window of at least ``least`` places, LEAST_EQUAL of them equal.

    Of all such windows one with the most equal places, without others at its ends as
    far as ``least`` allows; None if there is none.
    """
    if len(equal) < least:
        return None
    # a window is good when the score does not fall over it (in whole tenths)
    score = np.concatenate([[0], np.cumsum(10 * equal.astype(np.int64) - round(10 * LEAST_EQUAL))])
    same = np.concatenate([[0], np.cumsum(equal)])
    # the farthest stop for each begin: the last score that is not lower
    ahead = np.maximum.accumulate(score[::-1])[::-1]
    stops = np.searchsorted(-ahead, -score, side="right") - 1
    begins = np.flatnonzero(stops - np.arange(len(score)) >= least)
    if not len(begins):
        return None
    begin = int(begins[(same[stops[begins]] - same[begins]).argmax()])
    stop = int(stops[begin])
    while stop - begin > least and not equal[stop - 1]:
        stop -= 1
    while stop - begin > least and not equal[begin]:
        begin += 1
    return begin, stop


class SeedIndex:
    """Seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list):
        data, offsets = text_bytes(pa.array(texts, pa.large_string()))
        self.ids = ids
        self.stream, self.first = word_stream(data, offsets)
        lens = np.diff(self.first)
        short = sorted({int(n) for n in lens if 0 < n < LEAST_WORDS})
        #: masks with the number of words that an item must have to be given them
        self.masks = [(m, None) for m in MASKS] + [(m, n) for n in short for m in whole_masks(n)]
        item = np.repeat(np.arange(len(lens)), lens)
        tables = []
        for mask, only in self.masks:
            h, at = seed_hashes(self.stream, self.first, mask)
            keep = lens[item[at]] == only if only else np.ones(len(at), bool)
            order = np.argsort(h[keep], kind="stable")
            tables.append((h[keep][order], at[keep][order]))
        self.tables, self.item = tables, item
        bits = np.zeros(1 << 22, bool)
        for h, _ in tables:
            bits[(h >> np.uint64(42)).astype(np.int64)] = True
        self.bits = bits

    def overlaps(self, data: np.ndarray, offsets: np.ndarray):
        """Verified (text, item, place in text, place in item, words, equal words)."""
        stream, first = word_stream(data, offsets)
        pairs = []
        for (mask, _), (hashes, places) in zip(self.masks, self.tables):
            if not len(hashes):
                continue
            h, at = seed_hashes(stream, first, mask)
            may = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
            low = np.searchsorted(hashes, h[may])
            count = np.searchsorted(hashes, h[may], side="right") - low
            hit = np.repeat(may, count)
            seed = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            item = self.item[places[seed]]
            text = np.searchsorted(first, at[hit], side="right") - 1
            pairs.append(np.stack([text, item, at[hit] - (places[seed] - self.first[item])], axis=1))
        if not pairs:
            return []
        out = []
        for text, item, start in np.unique(np.concatenate(pairs), axis=0).tolist():
            own = self.stream[self.first[item] : self.first[item + 1]]
            a = max(start, int(first[text]))
            b = min(start + len(own), int(first[text + 1]))
            equal = stream[a:b] == own[a - start : b - start]
            window = best_window(equal, min(len(own), LEAST_WORDS))
            if window:
                begin, stop = window
                out.append((text, item, a + begin - int(first[text]), a + begin - start, stop - begin, int(equal[begin:stop].sum())))
        return out


def _blocks(benchmark: DataFrame, item: str, text: str):
    """(broadcast seed index, whether there are others) of bounded blocks of the benchmark.

    With others, the caller writes what it makes of a block and destroys its broadcast.
    """
    items = benchmark.select(F.col(item).cast("bigint").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(SeedIndex([r["i"] for r in rows], [r["t"] for r in rows])), blocks > 1


_FOUND = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint, n_equal bigint"


def _scan(docs: DataFrame, index) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            found = []
            for a, b in slices(offsets):
                for text, item, *rest in index.value.overlaps(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    found.append((ids[a + text], index.value.ids[item], *rest))
            names = [x.split()[0] for x in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(6)], names)

    return docs.mapInArrow(run, _FOUND)


def overlaps(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """All verified overlaps of documents with benchmark items."""
    spark = prepare(df.sparkSession)
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], _FOUND)
    for index, others in _blocks(benchmark, item, text):
        found = _scan(docs, index)
        if others:
            found = written(found)
            index.destroy()
        out = out.unionByName(found)
    return out


def contaminated_pairs(df: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The longest overlap of each document and item that have one."""
    found = overlaps(df, benchmark, **names)
    best = F.max(F.struct("n_equal", "n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        (-F.col("best.d")).alias("doc_word"),
        (-F.col("best.i")).alias("item_word"),
        F.col("best.n_words").alias("n_words"),
        F.col("best.n_equal").alias("n_equal"),
    )


def _hit(index, column) -> np.ndarray:
    """Which texts of an Arrow column an item contaminates."""
    data, offsets = text_bytes(column)
    hit = np.zeros(len(offsets) - 1, bool)
    for a, b in slices(offsets):
        for text, *_ in index.overlaps(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
            hit[a + text] = True
    return hit


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that no benchmark item contaminates, with all columns."""
    prepare(df.sparkSession)
    place = df.columns.index(text)
    docs, gone = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), []
    for index, others in _blocks(benchmark, item, text):

        def clean(batches):
            for batch in batches:
                yield batch.filter(pa.array(~_hit(index.value, batch.column(place))))

        def hits(batches):
            for batch in batches:
                own = batch.filter(pa.array(_hit(index.value, batch.column(1))))
                sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in own.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sha, pa.string())], ["_id", "_sha"])

        if not others:
            return df.mapInArrow(frugal(clean), df.schema)
        gone.append(written(docs.mapInArrow(hits, "_id bigint, _sha string")))
        index.destroy()
    if not gone:
        return df
    found = reduce(DataFrame.unionByName, gone).distinct()
    own = F.col(key).cast("bigint")
    sure, unsure = split_by_map(df, F.xxhash64(own), found.select(F.xxhash64("_id").alias("place")))
    # the input's columns travel as one, so that none of their names can clash
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row")
    rows = unsure.select(row, own.alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("sha"))
    kept = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_anti")
    return sure.unionByName(kept.select("row.*"))
